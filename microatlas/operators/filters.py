"""Report filters and row predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import all_of, as_col


def report_predicate(
    filters: Mapping[str, object] | None,
    columns: Mapping[str, tuple[str, str]] = config.FILTER_COLUMNS,
) -> Column:
    """AND of the equality filters that were given; absent or empty ones are ignored."""
    given = {k: v for k, v in (filters or {}).items() if k in columns and v not in (None, "")}
    conditions = []
    for name, value in given.items():
        column, kind = columns[name]
        typed = str(value) if kind == "string" else int(value)
        conditions.append(F.col(column) == F.lit(typed).cast(kind))
    return all_of(conditions)


def with_filters(
    df: DataFrame,
    filters: Mapping[str, object] | None,
    columns: Mapping[str, tuple[str, str]] = config.FILTER_COLUMNS,
) -> DataFrame:
    return df.filter(report_predicate(filters, columns)) if filters else df


def members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all the columns are known; plain predicates, so scans can skip by them."""
    return df.filter(all_of(F.col(c).isNotNull() for c in columns))


def exclude(df: DataFrame, value, *columns: str) -> DataFrame:
    """Rows where none of the columns holds the value (null counts as no match for keeping)."""
    return df.filter(all_of(F.col(c) != F.lit(value) for c in columns))


def both_present(df: DataFrame, *columns: str) -> DataFrame:
    """Post-aggregate filter: every column above zero."""
    return df.filter(all_of(F.col(c) > 0 for c in columns))


def reliable(
    r2: Column | str,
    projections: Sequence[Column],
    min_r2: float = config.MIN_R2,
    plausible: tuple[float, float] = config.PLAUSIBLE_SCORES,
) -> Column:
    """A trend is kept when it fits well and all its projections are plausible."""
    low, high = plausible
    return (as_col(r2) >= F.lit(min_r2)) & all_of(
        (p >= F.lit(low)) & (p <= F.lit(high)) for p in projections
    )


def visible_courses(
    courses: DataFrame,
    teaching_type: str | None,
    course_column: str = "co_grupo",
    types: Mapping = config.COURSE_TEACHING_TYPE,
) -> DataFrame:
    """Course options left once a teaching type is chosen."""
    if not teaching_type:
        return courses
    return members(courses, course_column, [c for c, t in types.items() if t == teaching_type])


def visible_states(states: DataFrame, region, region_column: str = "co_regiao") -> DataFrame:
    """State options of the chosen region; none before a region is chosen."""
    if region in (None, ""):
        return states.filter(F.lit(False))
    return states.filter(F.col(region_column) == F.lit(int(region)))
