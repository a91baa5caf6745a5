"""Token counts through a cache of content digests.

Content is identified by the digest of its normalised text, a tokenizer by the digest of
its file. Counts already stored for both are looked up; of the rest each distinct
content is encoded once and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microatlas.llm.common import col, in_one, others, out_of
from microatlas.runtime import scratch_path, scratch_root, settle

#: Digests a task remembers to leave out what it has already sent: about 100 bytes each.
REMEMBERED = 200_000
PER_CALL = 64


def session_cache(spark: SparkSession) -> str:
    """A cache in the shared folder that all counts of an application use."""
    return os.path.join(scratch_root(spark), f"microatlas-{spark.sparkContext.applicationId}", "token-counts")


def version(tokenizer: str) -> str:
    """The digest of the tokenizer's file."""
    with open(tokenizer, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def counter(tokenizer: str):
    """A function from texts to token counts as the library gives them by default:
    tokenizers for .json, sentencepiece for .model; nothing added at begin or end."""
    if tokenizer.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        library.no_truncation()
        library.no_padding()
        return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def read_cache(spark: SparkSession, cache: str, tokenizer_digest: str) -> DataFrame:
    """Stored ``digest`` and ``n_tokens`` of a tokenizer; a count stored twice is read once."""
    schema = "digest binary, n_tokens bigint, tokenizer string"
    try:
        stored = spark.read.schema(schema).parquet(cache).filter(F.col("tokenizer") == tokenizer_digest)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest this task has not sent yet, as far as it remembers."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                new.append(i)
                seen.add(d)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield batch.take(pa.array(new, pa.int64()))


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", limit: int = 4096, keep: list[str] | None = None
) -> DataFrame:
    """Every row with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Normalised content is the text itself, null being empty: both libraries normalise
    on their own, and nothing else leaves all counts as they are. ``cache`` is a folder
    that all executors share; without one the counts are stored in the scratch folder.
    Repeated rows and copies share one count; an empty table gives none. Input columns
    named like a result are replaced; the text is returned only if it is among ``keep``.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-counts")
    mark = version(tokenizer)
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in (keep if keep is not None else others(docs, [text])) if c not in new]
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")
    rows = docs.select(in_one(kept).alias("whole_row"), digest, F.octet_length(content).cast("bigint").alias("n_bytes"))
    rows = settle(rows, "content-digests")
    misses = settle(rows.select("digest").distinct().join(read_cache(spark, cache, mark), "digest", "left_anti"), "cache-misses")
    # A text that a third of all rows share leaves each task once, before the shuffle.
    texts = docs.select(digest, content.alias("text")).mapInArrow(_first_of_task, "digest binary, text string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, PER_CALL):
                part = batch.slice(at, PER_CALL)
                counts = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    # After a shuffled join the aggregate needs no shuffle of its own; after a broadcast of
    # few misses it moves only their texts.
    distinct = texts.join(misses, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    encoded = distinct.mapInArrow(encode, "digest binary, n_tokens bigint")
    encoded.withColumn("tokenizer", F.lit(mark)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # Settled, so that both sides of the join are plain shuffles and AQE can split a hot digest.
    counted = rows.join(settle(read_cache(spark, cache, mark), "counts"), "digest")
    return counted.select(*out_of("whole_row", kept), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
