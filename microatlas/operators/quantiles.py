"""Exact quantiles by selection on the bits of the values, in a fixed number of passes.

A double has an order-preserving whole number of 64 bits. A pass counts rows by the
next 16 bits, among the values that share the bits found so far, so no count has more than
65,536 rows per column and wanted rank, whatever the number of rows or of distinct values.
The running total says which 16 bits hold the rank. After four passes the value is known.
The asked columns are settled before the first pass, so whatever makes them is done once; the
bits found so far are a range of values, so later passes take the bits of the values in
it only. Nulls and NaN are missing values; infinities are values at the ends.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas.runtime import owned_scratch, settle

DIGIT = 16  # bits found in a pass
_ONE = float(1 << 52)
_LEAST_NORMAL = 2.0**-1022


def order_bits(x: Column, let: Callable[[str, Column], Column] = lambda name, step: step) -> Column:
    """The bits of a double as a whole number, negative for negative values: in the order
    of the values. Both zeros are 0; not for nulls and NaN.

    ``let`` may name a step that is used several times, else it is written out each time.
    """
    size = let("_size", F.abs(x))
    normal = let("_normal", F.when((size >= _LEAST_NORMAL) & (size < math.inf), size).otherwise(1.0))
    near = let("_near", F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(normal)).cast("int"))))
    # The logarithm may be rounded over a power of two; powers of two are exact.
    exponent = let("_exponent", near + F.when(normal >= F.pow(F.lit(2.0), near + 1), 1).when(normal < F.pow(F.lit(2.0), near), -1).otherwise(0))
    fraction = ((normal / F.pow(F.lit(2.0), exponent) - 1) * _ONE).cast("bigint")
    small = F.when(size < _LEAST_NORMAL, size).otherwise(0.0) / 5e-324
    bits = (
        F.when(size == math.inf, F.lit(2047 << 52))
        .when(size < _LEAST_NORMAL, small.cast("bigint"))
        .otherwise((exponent + 1023).cast("bigint") * (1 << 52) + fraction)
    )
    return F.when(x < 0, -bits).otherwise(bits)


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the bits of a column, each step of them once per row."""
    steps: list[str] = []

    def let(step: str, e: Column) -> Column:
        nonlocal df
        df = df.withColumn(step, e)
        steps.append(step)
        return F.col(step)

    bits = order_bits(F.col(value), let)
    return df.withColumn(name, bits).drop(*steps)


def value_range(prefix: int, shift: int) -> tuple[float, float]:
    """The least and the greatest value whose bits, shifted, are ``prefix``."""
    most = 2047 << 52
    low, high = prefix << shift, ((prefix + 1) << shift) - 1
    return from_bits(max(low, -most)), from_bits(min(high, most))


def from_bits(bits: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -value if bits < 0 else value


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    weight: str | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; an empty column gives nulls.

    ``weight`` names a column with how many equal rows each row stands for.
    """
    columns = [c for c in wanted if wanted[c]]
    if not columns:
        return {c: [] for c in wanted}
    asked = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *([F.col(weight).cast("bigint").alias("times")] if weight else []))
    with owned_scratch(df.sparkSession):  # the answers are numbers: nothing outlives the passes
        return _selected(settle(asked, "quantiles"), columns, wanted, bool(weight))


def _selected(
    stored: DataFrame, columns: Sequence[str], wanted: Mapping[str, Sequence[float]], weighted: bool
) -> dict[str, list[float | None]]:
    spark = stored.sparkSession
    rows = (
        (stored if weighted else stored.withColumn("times", F.lit(1).cast("bigint")))
        .unpivot(["times"], columns, "column", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("times") > 0))
    )
    # A window holds the counts of one column and prefix: 65,536 rows at most.
    inside = W.partitionBy("column", "prefix")
    upto = F.sum("n").over(inside.orderBy("digit"))

    def counted(shift: int, within: DataFrame) -> DataFrame:
        digit = F.shiftright("bits", shift) if shift == 64 - DIGIT else F.shiftright("bits", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        hist = with_bits(within, "value", "bits").groupBy("column", "prefix", digit.alias("digit")).agg(F.sum("times").alias("n"))
        return hist.withColumn("before", upto - F.col("n"))

    def prefix_of(open_: set[tuple[str, int]], shift: int) -> Column:
        """The bits found so far, of the values that share them, by comparing values."""
        found = F.lit(None).cast("bigint")
        for c, prefix in sorted(open_):
            low, high = value_range(prefix, shift)
            found = F.when((F.col("column") == c) & (F.col("value") >= low) & (F.col("value") <= high), F.lit(prefix).cast("bigint")).otherwise(found)
        return found

    holds = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
    shift = 64 - DIGIT
    asked = spark.createDataFrame([(c, float(q)) for c in columns for q in sorted(set(wanted[c]))], "column string, q double")
    first = counted(shift, rows.withColumn("prefix", F.lit(0).cast("bigint"))).withColumn("total", F.sum("n").over(inside))
    at = (F.col("total") - 1) * F.col("q")
    ranked = first.join(F.broadcast(asked), "column").withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    # rank of a column -> (bits found, values before them); at most two per quantile
    found: dict[tuple[str, int], tuple[int, int]] = {}
    totals: dict[str, int] = {}
    for r in ranked.filter(holds).select("column", "rank", "digit", "before", "total").collect():
        found[r["column"], r["rank"]] = (r["digit"], r["before"])
        totals[r["column"]] = r["total"]
    while shift and found:
        state = [(c, rank, prefix, rank - before) for (c, rank), (prefix, before) in found.items()]
        open_ = spark.createDataFrame(state, "column string, whole_rank bigint, prefix bigint, rank bigint")
        within = rows.withColumn("prefix", prefix_of({(c, prefix) for c, _, prefix, _ in state}, shift)).filter(F.col("prefix").isNotNull())
        shift -= DIGIT
        hit = counted(shift, within).join(F.broadcast(open_), ["column", "prefix"]).filter(holds)
        for r in hit.select("column", "whole_rank", "prefix", "digit", "before").collect():
            key = r["column"], r["whole_rank"]
            found[key] = ((r["prefix"] << DIGIT) | r["digit"], found[key][1] + r["before"])
    at_rank = {key: from_bits(bits) for key, (bits, _) in found.items()}
    return {c: [_interpolate(totals[c], q, c, at_rank) if c in totals else None for q in wanted[c]] for c in wanted}


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    weight: str | None = None,
) -> dict[str, float | None]:
    found = exact_quantiles(df, {c: [0.5] for c in columns}, weight)
    return {c: v[0] for c, v in found.items()}


def _ranks(n: int, q: float) -> tuple[int, int]:
    at = (n - 1) * q
    return math.floor(at), math.ceil(at)


def _interpolate(n: int, q: float, column: str, at: Mapping[tuple[str, int], float]) -> float:
    low, high = _ranks(n, q)
    a, b = at[column, low], at[column, high]
    if a == b:  # also two equal infinities
        return a
    share = (n - 1) * q - low
    return (1 - share) * a + share * b
