"""Spelling variants: words one edit apart, led to their commonest form.

Words are joined by asymmetric chunks and grams. The shorter word of a pair (either, if
they are equally long) gives two disjoint chunks, its halves. One inserted, deleted or
replaced character leaves one of the halves whole, and the other word holds it as a
positional gram: the first half at the same place, the second half at the same place or,
in a word longer by one, shifted by one. Of all positional grams of a word only those
within shift one of a half's place can meet it, so only they are sent: for each of the
two lengths that its partner may have, one beginning and one end. Pairs that meet are
verified by their edit distance.

A half that very many words share (all with one beginning, say) is not compared pair
by pair: there the rest of the word, which holds the edit, is halved again, so that a
larger part of the word must agree, until the words that meet are few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microatlas.llm.common import col
from microatlas.runtime import settle

#: Letters of a word after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Pairs that a key may compare before its words are cut further.
CROWD = 1 << 14
HELD = 300_000  # distinct words a task counts before it sends them


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, drop: int | None = 97
) -> DataFrame:
    """``word`` and ``n``, how often it occurs in the texts, for words that occur often enough.

    Words are runs of letters, lower-cased from A to Z. Where ``drop`` divides the CRC-32 of
    "id:run", the run loses the character at that number modulo its length; a null id counts as
    the empty text.
    """
    source = docs.select(F.coalesce(col(id_column).cast("string"), F.lit("")).alias("id"), col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{least_length},}}")
        total: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body:
                    continue
                found = Counter(runs.findall(body.encode().lower().decode()))  # bytes lower-case A to Z only
                if drop:
                    start = zlib.crc32(f"{own}:".encode())
                    for word in [w for w in found if zlib.crc32(w.encode(), start) % drop == 0]:
                        n = found.pop(word)
                        at = zlib.crc32(word.encode(), start) % len(word)
                        if len(word) > least_length:
                            total[word[:at] + word[at + 1 :]] += n
                total.update(found)
                if len(total) > HELD:
                    yield sent()
        yield sent()

    counted = source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _key(word: Column, grown: Column) -> Column:
    """Hash of what must agree when the edit lies in [lo, hi) of the chunks' word, in a word
    that is ``grown`` characters longer."""
    start = F.expr("left(word, lo)")
    end = F.substring(word, F.col("hi") + grown + 1, F.length(word))
    return F.xxhash64("l", "lo", "hi", start, F.lit("\x00"), end)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first or the second half of its free part fixed."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    return rows.select("word", "n", "l", "grown", F.explode(halves).alias("free")).select("word", "n", "l", "grown", "free.lo", "free.hi")


def near_pairs(words: DataFrame, least_length: int = 5, crowd: int = CROWD) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct words exactly one edit apart, each once, with
    their counts ``a_n`` and ``b_n``.

    ``words`` holds distinct words of at least ``least_length`` characters with their
    counts ``n``.
    """
    size = F.length("word")
    whole = words.select("word", "n", size.alias("l"), F.lit(0).alias("grown"), F.lit(0).alias("lo"), size.alias("hi"))
    longer = whole.filter(size > least_length).select("word", "n", (F.col("l") - 1).alias("l"), F.lit(1).alias("grown"), "lo", (F.col("hi") - 1).alias("hi"))
    # A word of the same length is chunks and grams alike: grown 0. Grams for shorter words: grown 1.
    open_rows = whole.unionByName(longer)
    found = None
    while True:
        keyed = _cut(open_rows).withColumn("key", _key(F.col("word"), F.col("grown")))
        keyed = settle(keyed, "chunk-keys")
        same = F.count_if(F.col("grown") == 0)
        met = keyed.groupBy("key").agg(same.alias("chunks"), F.count(F.lit(1)).alias("rows")).filter("chunks > 0 AND rows > 1")
        met = settle(met.select("key", (F.col("chunks") * F.col("rows") > crowd).alias("crowded")), "chunk-meetings")
        placed = keyed.join(met, "key")
        # Where one character is free, there is nothing left to cut, and at most an alphabet of words.
        calm = placed.filter(~F.col("crowded") | (F.col("hi") - F.col("lo") <= 1))
        chunks = calm.filter("grown = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        grams = calm.select("key", "grown", F.col("word").alias("b"), F.col("n").alias("b_n"))
        once = (F.col("grown") == 1) | (F.col("a") < F.col("b"))
        pairs = chunks.join(grams, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        pairs = settle(pairs, "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        open_rows = settle(placed.filter(F.col("crowded") & (F.col("hi") - F.col("lo") > 1)).drop("key", "crowded"), "crowded-chunks")
        if open_rows.isEmpty():
            return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of the chain of ``form``s that begins at the word.

    Chains are halved in each round, and every round is written. A form occurs more often
    than its word, so chains end.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = settle(step, "roots")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def variants(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2,
    drop: int | None = 97, crowd: int = CROWD,
) -> DataFrame:
    """One row per word of the texts: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the commonest word one edit away (of equally common ones the first in
    code-point order) if it occurs at least ``ratio`` times as often, else null; ``root`` is
    where forms lead, the word itself without one; ``n_near`` counts all words one edit away.
    Null and empty texts have no words; a null id counts as the empty text; repeated rows
    count each time; a text or a word may have any length; an empty table gives no rows. Other
    columns of ``docs``, whatever their names, are not read.
    """
    words = settle(word_counts(docs, id_column, text, least_length, least_count, drop), "words")
    pairs = settle(near_pairs(words, least_length, crowd), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    led = (-F.col("best.less")) >= ratio * F.col("n")
    formed = settle(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
