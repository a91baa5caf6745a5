"""Mixing sources to target weights by nested hash thresholds.

Every row has a 60-bit hash, so the rows of a source have an order without being
sorted: summing words by source and leading hash digits finds the digits where a budget
is reached, and only rows with these digits are summed again by the next ones. A larger
budget always takes the rows of a smaller one and more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas.llm.common import WORD, col, in_one, numbered, out_of
from microatlas.runtime import settle

HASH_BITS = 60
DIGIT_BITS = 12


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(id_column: str, text: str) -> Column:
    """60 bits of the MD5 of id and text; equal for repeated rows only."""
    whole = F.concat(
        F.coalesce(col(id_column).cast("string"), F.lit("")), F.lit("|"), F.coalesce(col(text).cast("string"), F.lit(""))
    )
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``source`` and ``source_size`` with ``target``, and how to reach it: ``whole``
    passes over all rows and ``rest`` words more.

    Sources in code point order, null last, take the weights in turn and share the
    words of all sources; none gets more than ``most`` times its own. With sources in
    order of the level at which they are full, the level of the others has a closed
    form. One row per source enters these windows.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    full = (most * F.col("source_size")).cast("double")
    by_level = W.orderBy((F.col("full") / F.col("weight")), "place")
    rows = (
        sizes.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("full", full)
        .withColumn("fuller", F.coalesce(F.sum("full").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("others", F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("all") - F.col("fuller")) / F.col("others"))
        .withColumn("nth", F.row_number().over(by_level))
    )
    # The first source that its level does not fill, and all after it, stay at that level.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("nth", "level"))
    rows = rows.withColumn("level", F.min(fits).over(W.partitionBy()).getField("level"))
    target = F.least("full", F.col("level") * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return rows.withColumn("target", target).select(
        "source", "source_size", "target", whole.cast("int").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
    )


def _cuts(rows: DataFrame, plan: DataFrame, row: str) -> tuple[DataFrame, Column]:
    """The digits at which each source reaches its rest, and the column of digits.

    Narrows 12 bits at a time until one row is left there; repeated rows, whose hashes
    agree to the end, go on with the digits of their row numbers.
    """
    digits = [F.shiftrightunsigned("hash", HASH_BITS - i) for i in range(DIGIT_BITS, HASH_BITS + 1, DIGIT_BITS)]
    at = [F.struct(d.alias("d"), F.lit(0).cast("bigint").alias("r")) for d in digits]
    at += [F.struct(F.col("hash").alias("d"), F.shiftrightunsigned(row, s).alias("r")) for s in (44, 33, 22, 11, 0)]
    cut = None
    for level, key in enumerate(at):
        here = rows.select("source", "size", key.alias("key"), *([at[level - 1].alias("within")] if level else []))
        if cut is None:
            open_rows = here.join(plan.select(F.col("source").alias("own"), "rest", F.lit(0).cast("bigint").alias("base")), F.col("source").eqNullSafe(F.col("own")))
        else:
            open_rows = here.join(
                cut.select(F.col("source").alias("own"), F.col("key").alias("inside"), "rest", "base"),
                F.col("source").eqNullSafe(F.col("own")) & (F.col("within") == F.col("inside")),
            )
        sums = open_rows.groupBy("source", "rest", "base", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        # At most 4,096 digits of a source enter one window.
        order = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
        before = F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0))
        reached = sums.withColumn("base", before).filter((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("words") > F.col("rest")))
        cut = settle(reached, "mix-cuts")
        if not cut.filter("n > 1").take(1):
            return cut, key
    raise AssertionError("rows have distinct numbers")


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    id_column: str = "doc_id",
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row with ``size`` (its words), ``source_size``, ``target`` (of its source),
    ``repeats`` (how often the mix takes it, at most ``most`` times) and ``taken``.

    Which rows are taken depends on id and text only, so reruns agree. A source's taken
    words differ from its target by at most half the row at the cut. Null sources are
    one source; null texts have size 0; repeated rows are taken one by one; an empty
    table gives none. Input columns named like a result are replaced.
    """
    new = ["size", "source_size", "target", "repeats", "taken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    mine = docs.select(
        in_one(kept).alias("whole_row"), col(source).cast("string").alias("source"),
        n_words(text).alias("size"), row_hash(id_column, text).alias("hash"),
    )
    rows, row = numbered(mine, "mix-rows")
    plan = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    cut, key = _cuts(rows, plan, row)
    cut = cut.select(
        F.col("source").alias("cut_source"), F.col("key").alias("cut_key"),
        (2 * F.col("base") + F.col("words") <= 2 * F.col("rest")).alias("with_cut"),
    )
    ways = settle(plan.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "mix-plan")
    more = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & F.col("with_cut"))
    repeats = F.least(F.lit(most), F.col("whole") + F.coalesce(more, F.lit(False)).cast("int"))
    return (
        rows.withColumn("key", key)
        .join(ways.withColumnRenamed("source", "way"), F.col("source").eqNullSafe(F.col("way")))
        .withColumn("repeats", repeats)
        .select(
            *out_of("whole_row", kept),
            "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).cast("bigint").alias("taken"),
        )
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix, each as often as it is taken, all their columns unchanged.

    A null source is a source, the last one; null and empty texts weigh nothing; rows of
    equal id and text are taken one by one; an empty table gives none.
    """
    whole = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("whole"), *[col(c) for c in dict.fromkeys((settings.get("source", "source"), settings.get("text", "text"), settings.get("id_column", "doc_id")))])
    taken = mix(whole, keep=["whole"], **settings)
    return taken.select("whole", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select("whole.*")
