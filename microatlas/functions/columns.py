"""Scalar expressions: rounding, labels, cleaning, shares and clamps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from microatlas import config

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int | None) -> Column:
    """Round half away from zero; ``None`` leaves the value alone."""
    c = as_col(c)
    return c if digits is None else F.round(c, digits)


def rounded_half_even(c: Column | str, digits: int) -> Column:
    return F.bround(as_col(c), digits)


def mean(c: Column | str, digits: int | None = 2) -> Column:
    return rounded(F.avg(as_col(c)), digits)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def percent_of(fraction: Column | str, digits: int = 1) -> Column:
    return F.round(as_col(fraction) * 100, digits)


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null: ``least`` and ``greatest`` alone would skip it."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def point_radius(total: Column | str, shape: tuple[float, float, float] = config.POINT_RADIUS) -> Column:
    low, high, factor = shape
    return clamp(F.sqrt(as_col(total)) * F.lit(factor), low, high)


def to_ceiling(c: Column | str, ceiling: float = config.RELATIVE_CEILING, scale: float = 100.0) -> Column:
    """A value relative to a ceiling, never above ``scale``."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(c / F.lit(ceiling) * F.lit(scale), F.lit(scale)))


def direction(c: Column | str) -> Column:
    return F.when(as_col(c) > 0, F.lit("↑")).otherwise(F.lit("↓"))


def label(
    code: Column | str,
    names: Mapping,
    fallback: Column | str | None = None,
) -> Column:
    """Name of a code from a small fixed map; a miss gives the fallback or null."""
    code = as_col(code)
    literal = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    key_type = "bigint" if isinstance(next(iter(names)), int) else "string"
    found = F.try_element_at(literal, code.cast(key_type))
    if fallback is None:
        return found
    return F.coalesce(found, fallback if isinstance(fallback, Column) else F.lit(fallback))


def network(
    kind: Column | str, pattern: str = config.PUBLIC_PATTERN, words: Iterable[str] = ()
) -> Column:
    """Public or private, from the institution type: by a pattern, or by words it contains."""
    public = reduce(lambda a, w: a | as_col(kind).contains(w), words, as_col(kind).like(pattern))
    return F.when(public, F.lit("Pública")).otherwise(F.lit("Privada"))


def code_order(c: Column | str) -> list[Column]:
    """Codes that became text in their own order: numbers by value, then the rest."""
    c = as_col(c)
    return [c.try_cast("bigint").asc_nulls_last(), c.asc_nulls_last()]


def one_of_or_rest(c: Column | str, value: str, yes: str, rest: str) -> Column:
    """Two classes; nulls belong to the rest."""
    return F.when(as_col(c) == F.lit(value), F.lit(yes)).otherwise(F.lit(rest))


def null_tokens(c: Column | str, tokens: Iterable[str] = config.NA_TOKENS) -> Column:
    c = as_col(c)
    return F.when(~c.isin(list(tokens)), c)


def number(c: Column | str) -> Column:
    """Tolerant text to double: whatever is not a plain finite number is null."""
    c = as_col(c).cast("string")
    parsed = F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)


def whole_number(c: Column | str) -> Column:
    """Tolerant text to bigint; accepts ``72.0``, rejects ``72.5``."""
    value = number(c)
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def is_token(c: Column | str, token: str) -> Column:
    return F.trim(as_col(c).cast("string")) == F.lit(token)


def bucket(c: Column | str, width: int = config.BUCKET_WIDTH, last: int | None = config.BUCKETS[-1]) -> Column:
    """Lower edge of a fixed-width bucket; the top score joins the last bucket."""
    edge = (F.floor(as_col(c) / width) * width).cast("int")
    return edge if last is None else F.when(edge.isNotNull(), F.least(edge, F.lit(last)))


def bucket_name(edge: Column | str, width: int = config.BUCKET_WIDTH) -> Column:
    edge = as_col(edge)
    return F.concat_ws("–", edge.cast("string"), (edge + (width - 1)).cast("string"))


def band(c: Column | str, low: float, high: float, classes: tuple[str, str, str] = config.CLASSES) -> Column:
    """Three bands closed on the right; null stays null."""
    c = as_col(c)
    return (
        F.when(c <= F.lit(low), F.lit(classes[0]))
        .when(c <= F.lit(high), F.lit(classes[1]))
        .when(c.isNotNull(), F.lit(classes[2]))
    )


def class_order(c: Column | str, classes: tuple[str, ...] = config.CLASSES) -> Column:
    """1-based place in the fixed class list; null for other values."""
    place = F.array_position(F.array(*[F.lit(x) for x in classes]), as_col(c))
    return F.nullif(place, F.lit(0))


def all_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)
