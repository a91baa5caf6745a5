"""Normalised scores, bands and encodings: clean rows -> derived rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import band
from microatlas.operators.filters import require
from microatlas.operators.quantiles import exact_quantiles
from microatlas.runtime import settle
from microatlas.sources.positions import sorted_rank


def attach_group_stats(df: DataFrame, keys: Sequence[str], **stats) -> DataFrame:
    """Give every row its group's statistics.

    Partial aggregation makes one small row per group; joining those back moves
    the small side only, where a window would move every row of a hot group into
    one task. Null keys form no group.
    """
    groups = settle(
        require(df, *keys).groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()]),
        "group-stats",
    )
    return df.join(groups, list(keys), "left")


def normalise_within(
    df: DataFrame, score: str, group: str, name: str, digits: int | None = None
) -> DataFrame:
    """Min-max to 0..100 inside each group; a constant group gives 50."""
    with_range = attach_group_stats(df, [group], _lo=F.min(score), _hi=F.max(score))
    spread = F.col("_hi") - F.col("_lo")
    scaled = (F.col(score) - F.col("_lo")) / F.nullif(spread, F.lit(0.0)) * 100
    value = F.when(F.col(score).isNotNull() & (spread == 0), F.lit(50.0)).otherwise(scaled)
    value = value if digits is None else F.round(value, digits)
    return with_range.withColumn(name, value).drop("_lo", "_hi")


def quantile_bands(
    df: DataFrame,
    score: str,
    name: str,
    quantiles: Sequence[float] = config.BAND_QUANTILES,
    classes: tuple[str, str, str] = config.CLASSES,
    approximate: bool = False,
) -> DataFrame:
    """Three bands cut at global quantiles.

    ``approximate`` trades exact cuts for one pass with a bounded sketch.
    """
    if approximate:
        row = df.agg(F.percentile_approx(score, list(quantiles), 10_000).alias("q")).first()
        cuts = row.q or [None, None]
    else:
        cuts = exact_quantiles(df, {score: quantiles})[score]
    if cuts[0] is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, band(score, cuts[0], cuts[1], classes))


def category_codes(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null values of the columns in text order with 0-based codes.

    One pass collects the categories of all columns; only they are sorted.
    """
    names = list(columns)
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    pairs = require(texts.unpivot([], names, "coluna", "categoria"), "categoria").distinct()
    ranked = sorted_rank(pairs, ["coluna", "categoria"], "_place")
    first = ranked.groupBy("coluna").agg(F.min("_place").alias("_first"))
    return ranked.join(first, "coluna").select(
        "coluna", "categoria", (F.col("_place") - F.col("_first")).cast("int").alias("codigo")
    )


def encode_categories(
    df: DataFrame, columns: Sequence[str], suffix: str = "_code"
) -> DataFrame:
    """Add ``<col><suffix>``: the value's rank among the sorted categories, null kept."""
    codes = settle(category_codes(df, *columns), "codes")
    out = df
    for c in columns:
        of_column = codes.filter(F.col("coluna") == c).select(
            F.col("categoria").alias(f"_{c}"), F.col("codigo").alias(f"{c}{suffix}")
        )
        out = out.join(of_column, F.col(c).cast("string") == F.col(f"_{c}"), "left").drop(f"_{c}")
    return out
