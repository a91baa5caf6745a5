"""Straight-line trends on edition means, and their projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microatlas import config
from microatlas.operators.filters import reliable
from microatlas.operators.reshape import year_scaffold


def fit_line(
    points: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    min_points: int = config.MIN_TREND_POINTS,
) -> DataFrame:
    """Least squares per group, as unrounded intercept, slope and r2.

    Pairs with a null are skipped; groups with too few points drop out; a constant
    y counts as a perfect fit. ``points`` has one row per group and edition; the
    values are kept in ``_values``.
    """
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    fits = points.groupBy(*by).agg(
        F.count(F.when(xd.isNotNull() & yd.isNotNull(), 1)).alias("pontos"),
        F.regr_intercept(yd, xd).alias("_b0"),
        F.regr_slope(yd, xd).alias("_b1"),
        F.when(F.regr_syy(yd, xd) == 0, F.lit(1.0)).otherwise(F.regr_r2(yd, xd)).alias("_r2"),
        F.map_from_entries(
            F.collect_list(F.struct(F.col(x).cast("int"), F.col(y)))
        ).alias("_values"),
    )
    return fits.filter(F.col("pontos") >= min_points)


def coefficients(digits: int = 4) -> list[Column]:
    return [F.round(f"_{c}", digits).alias(c) for c in ("b0", "b1", "r2")]


def predict(x: Column, digits: int = 2) -> Column:
    """Value of the fitted line, from the unrounded coefficients."""
    return F.round(F.col("_b0") + F.col("_b1") * x, digits)


def trend(
    points: DataFrame,
    real: Sequence[int],
    projected: Sequence[int],
    by: Sequence[str] = (),
    year: str = "ano",
    value: str = "media",
    require_reliable: bool = False,
    min_points: int = config.MIN_TREND_POINTS,
) -> DataFrame:
    """Real and projected years per group, with the rounded coefficients.

    With ``require_reliable`` an unreliable group keeps its rows but loses its
    projections. The real values travel with the fit (one per edition), so the
    points are read once and nothing is joined back.
    """
    by = list(by)
    fits = fit_line(points.filter(F.col(year).isin(list(real))), year, value, by, min_points)
    sure = reliable(F.round("_r2", 4), [predict(F.lit(float(y))) for y in projected])
    rows = year_scaffold(fits.withColumn("confiavel", sure), real, projected, year)
    is_real = F.col("tipo") == F.lit("real")
    shown = ~is_real & F.col("confiavel") if require_reliable else ~is_real
    return rows.select(
        *by,
        year,
        "tipo",
        F.when(is_real, F.try_element_at("_values", F.col(year))).alias("media"),
        F.when(shown, predict(F.col(year))).alias("projecao"),
        *coefficients(),
        "confiavel",
    )
