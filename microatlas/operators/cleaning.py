"""Raw strings -> typed, present, valid rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import is_token, null_tokens, number, whole_number


def blank_to_null(df: DataFrame, tokens: Iterable[str] = config.NA_TOKENS) -> DataFrame:
    """Whole-value missing tokens to null, for every string column in one projection."""
    tokens = list(tokens)
    return df.select(
        *[
            null_tokens(c, tokens).alias(c) if kind == "string" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def to_numbers(
    df: DataFrame,
    doubles: Sequence[str] = config.SCORE_COLUMNS,
    longs: Sequence[str] = config.CODE_COLUMNS,
) -> DataFrame:
    """Tolerant casts; columns that are absent are skipped."""
    casts = {c: number(c) for c in doubles if c in df.columns}
    casts.update({c: whole_number(c) for c in longs if c in df.columns})
    return df.withColumns(casts)


def present_with_score(
    df: DataFrame,
    score: str = "NT_GER",
    presence: str = config.PRESENCE_COLUMN,
    token: str = config.PRESENT,
) -> DataFrame:
    """Rows with a valid score whose presence mark (when the column exists) says so."""
    kept = df.filter(F.col(score).isNotNull())
    return kept.filter(is_token(presence, token)) if presence in df.columns else kept


def rename_existing(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Project the columns that exist under their serving names."""
    return df.select(*[F.col(k).alias(v) for k, v in names.items() if k in df.columns])


def drop_control(df: DataFrame, columns: Sequence[str] = config.CONTROL_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def clean(df: DataFrame) -> DataFrame:
    """Tokens, types, then the presence and score filter."""
    return present_with_score(to_numbers(blank_to_null(df)))
