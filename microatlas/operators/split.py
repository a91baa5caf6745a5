"""Stratified hold-out and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas import config
from microatlas.runtime import settle

_HASH_DIGITS = 15  # hex digits, 60 bits
_RANGE_BITS = 44  # the top 16 bits name a range


def key_hash(keys: Sequence[str]) -> Column:
    """Order-free pseudo-random number of a row, from its key."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, _HASH_DIGITS), 16, 10).cast("bigint")


def stratified_holdout(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    fraction: float = config.TEST_FRACTION,
    name: str = "teste",
) -> DataFrame:
    """Mark round(fraction * n) rows of every class, the ones with the smallest hashes.

    Sizes are exact without ordering a class: counts per hash range find the range
    that holds each class's cut, and only the rows of that one range are ranked
    (1/65536 of a class). ``keys`` must identify a row.
    """
    hashed = df.filter(F.col(label).isNotNull()).withColumn("_h", key_hash(keys))
    return mark_smallest(hashed, label, fraction, name)


def mark_smallest(
    hashed: DataFrame, label: str, fraction: float = config.TEST_FRACTION, name: str = "teste"
) -> DataFrame:
    """The same for labelled rows that have their ``key_hash`` as ``_h``, which is dropped.

    They are read three times, so the caller may settle them.
    """
    ranged = hashed.select(label, "_h", F.shiftright("_h", _RANGE_BITS).alias("_r"))
    counts = ranged.groupBy(label, "_r").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(label).orderBy("_r"))
    of_class = F.sum("_n").over(W.partitionBy(label))
    cut = settle(
        counts.select(
            label,
            "_r",
            F.round(of_class * fraction).cast("bigint").alias("_want"),
            upto.alias("_upto"),
            (upto - F.col("_n")).alias("_before"),
        )
        .filter((F.col("_want") > F.col("_before")) & (F.col("_want") <= F.col("_upto")))
        .select(label, "_r", (F.col("_want") - F.col("_before")).alias("_left")),
        "holdout-ranges",
    )
    inside = ranged.join(cut, [label, "_r"])
    rank = F.row_number().over(W.partitionBy(label, "_r").orderBy("_h"))
    limits = settle(
        inside.withColumn("_i", rank)
        .filter(F.col("_i") == F.col("_left"))
        .select(label, F.col("_h").alias("_last")),
        "holdout-limits",
    )
    return (
        hashed.join(limits, label, "left")
        .withColumn(name, F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False)))
        .drop("_h", "_last")
    )


def class_weights(
    df: DataFrame, label: str, name: str = "peso", weight: str | None = None
) -> DataFrame:
    """n / (classes * n_c) per class: one row per class.

    ``weight`` names a column with how many equal rows each row stands for.
    """
    n = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(n.alias("n"))
    everything = W.partitionBy()
    return counts.select(
        label,
        "n",
        (
            F.sum("n").over(everything)
            / (F.count(F.lit(1)).over(everything) * F.col("n"))
        ).alias(name),
    )


def with_class_weight(
    df: DataFrame, label: str, name: str = "peso", weight: str | None = None
) -> DataFrame:
    weights = settle(class_weights(df, label, name, weight).drop("n"), "class-weights")
    return df.join(weights, label, "left")
