"""Contiguous shards of nearly equal bytes by global prefix sums.

Rows are sorted by ranges; each partition sums its own sizes as it streams by, the
partitions' totals are summed up once, and a row's global byte place decides its shard.
No task holds more than a partition, and nothing but one row per partition meets in a
window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import col, in_one, numbered, others, out_of
from microatlas.runtime import settle

OVERHEAD = 16


def with_prefix_sums(rows: DataFrame, size: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``before`` (the sizes of all earlier rows) and ``place`` (how many
    they are), in a total order. ``size`` is a long without nulls."""
    source = rows.repartitionByRange(*[col(c) for c in order]).sortWithinPartitions(*[col(c) for c in order])
    schema = T.StructType([*source.schema.fields, *[T.StructField(c, T.LongType()) for c in ("part", "before", "place")]])
    at = source.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes, n = batch.column(at).to_numpy(), batch.num_rows
            ends = before + np.cumsum(sizes)
            new = [np.full(n, part, np.int64), ends - sizes, np.arange(place, place + n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=schema.names)
            if n:
                before, place = int(ends[-1]), place + n

    local = settle(source.mapInArrow(run, schema), "prefix-sums")
    totals = local.groupBy("part").agg(F.sum(col(size)).alias("bytes"), F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = settle(
        totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("bytes", "n")]), "part-starts"
    )
    return local.join(starts, "part").select(
        *[col(c) for c in source.columns], (F.col("before") + F.col("bytes")).alias("before"), (F.col("place") + F.col("n")).alias("place")
    )


def shards(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", n_shards: int = 40, keep: Sequence[str] | None = None
) -> DataFrame:
    """Every row with ``size`` (UTF-8 bytes of the text and 16 more), ``text_crc32``,
    ``shard`` (0 to ``n_shards - 1``) and ``slot`` (its place there).

    Shards are contiguous in the order of ids, nulls first, ties by text checksum and
    size. The middle byte of a row decides its shard, so a shard is off its equal
    share by no more than the rows at its two ends. A row longer than a share can leave
    a neighbour empty. Null and empty texts have size 16 and checksum 0; repeated
    rows are placed one by one; an empty table gives none. Input columns named like a
    result are replaced; the text is returned only if it is among ``keep``.
    """
    new = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in (keep if keep is not None else others(docs, [text])) if c not in new]
    raw = F.coalesce(col(text).cast("string"), F.lit(""))
    mine = docs.select(
        in_one(kept).alias("whole_row"), col(id_column).alias("id"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"),
    )
    rows, row = numbered(mine, "shard-rows")
    placed = with_prefix_sums(rows, "size", ["id", "text_crc32", "size", row])
    total = rows.agg(F.sum("size")).first()[0] or 1
    # Whole numbers: no rounding moves a row at any size.
    share = F.expr(f"(2 * before + size) * {int(n_shards)} div (2 * {int(total)})").cast("int")
    cut = placed.withColumn("shard", F.least(share, F.lit(n_shards - 1)))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))
    # One row per shard: the broadcast is bounded by n_shards.
    return cut.join(F.broadcast(first), "shard").select(
        *out_of("whole_row", kept), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
