"""Pivot, unpivot and densify, always over known lists of values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microatlas.functions.columns import mean


def pivot_value(
    groups: DataFrame, rows: Sequence[str], across: str, values: Sequence, value: str, prefix: str = ""
) -> DataFrame:
    """One column per known value; a missing cell is null, and values outside the list
    have no column: a new edition must be named to be shown."""
    return groups.groupBy(*rows).agg(
        *[
            F.max(F.when(F.col(across) == F.lit(v), F.col(value))).alias(f"{prefix}{v}")
            for v in values
        ]
    )


def pivot_count(
    df: DataFrame, rows: Sequence[str], across: str, values: Sequence, prefix: str = ""
) -> DataFrame:
    """Rows per known value; a missing cell is 0, and values outside the list are not
    counted anywhere. Counts straight from the rows."""
    return df.groupBy(*rows).agg(
        *[F.count_if(F.col(across) == F.lit(v)).alias(f"{prefix}{v}") for v in values]
    )


def two_sides(
    df: DataFrame,
    dims: Sequence[str],
    side: Column,
    sides: tuple[tuple[str, str, str], tuple[str, str, str]],
    measure: str,
    digits: int = 2,
) -> DataFrame:
    """Mean and count for two values of a column next to each other.

    ``sides`` holds (value, mean name, count name) twice. The mean is taken over
    all rows of a side, however many categories it was merged from.
    """
    return df.groupBy(*dims).agg(
        *[
            e
            for value, media, n in sides
            for e in (
                mean(F.when(side == F.lit(value), F.col(measure)), digits).alias(media),
                F.count_if(side == F.lit(value)).alias(n),
            )
        ]
    )


def nested_cells(
    groups: DataFrame, rows: Sequence[str], cells: Sequence[str], name: str, order: Column | None = None
) -> DataFrame:
    """One row per group with its cells as a list, sorted by ``order`` (nulls last) and
    then by the first cell column."""
    first = F.lit(None).cast("bigint") if order is None else order
    keyed = F.struct(first.isNull().alias("_late"), first.alias("_first"), F.struct(*cells).alias("cell"))
    listed = groups.groupBy(*rows).agg(F.sort_array(F.collect_list(keyed)).alias(name))
    return listed.withColumn(name, F.transform(name, lambda x: x["cell"]))


def stack_columns(
    df: DataFrame, keep: Sequence[str], columns: Sequence[str], variable: str = "variavel",
    value: str = "categoria",
) -> DataFrame:
    """Several columns as (variable, value) rows, as text, in one scan."""
    return df.select(
        *keep, *[F.col(c).cast("string").alias(c) for c in columns]
    ).unpivot(list(keep), list(columns), variable, value)


def stack_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Editions under each other by column name; a column some lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """All combinations of fixed lists: a scaffold that reports are laid on."""
    out = df.sparkSession.range(0, 1, 1, 1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def densify(
    groups: DataFrame, count: str | Sequence[str], **axes: Sequence
) -> DataFrame:
    """Every cell of the fixed grid, 0 where nothing was counted.

    Cells outside the grid are dropped: a new edition or bucket must be named to be shown.
    """
    counts = [count] if isinstance(count, str) else list(count)
    return grid(groups, **axes).join(groups, list(axes), "left").na.fill(0, counts)


def year_scaffold(
    fits: DataFrame, real: Sequence[int], projected: Sequence[int], year: str = "ano", kind: str = "tipo"
) -> DataFrame:
    """Each row once per real and projected year, flagged."""
    points = F.array(
        *[F.struct(F.lit(y).alias(year), F.lit("real").alias(kind)) for y in real],
        *[F.struct(F.lit(y).alias(year), F.lit("projecao").alias(kind)) for y in projected],
    )
    return fits.select("*", F.inline(points))
