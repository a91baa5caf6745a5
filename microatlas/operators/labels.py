"""Labels by dimension join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dimension(spark: SparkSession, names: Mapping, key: str, value: str, order: str | None = None) -> DataFrame:
    """A fixed code table as a DataFrame; ``order`` adds the position in the table."""
    rows = F.array(
        *[
            F.struct(F.lit(k).alias(key), F.lit(v).alias(value), F.lit(i).alias("_i"))
            for i, (k, v) in enumerate(names.items())
        ]
    )
    table = spark.range(0, 1, 1, 1).select(F.inline(rows))
    if order:
        return table.withColumnRenamed("_i", order)
    return table.drop("_i")


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: str,
    key: str,
    name: str,
    value: str,
    fallback: Column | str | None = None,
) -> DataFrame:
    """Left join to a dimension; a miss gives the fallback (a column or text) or null.

    Left to Catalyst: it broadcasts a dimension by its known size.
    """
    side = dim.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    found = F.col("_v")
    if fallback is not None:
        found = F.coalesce(found, fallback if isinstance(fallback, Column) else F.lit(fallback))
    joined = df.join(side, F.col(on) == F.col("_k"), "left").withColumn(name, found)
    return joined.drop("_k", "_v")


def keep_known(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Label rows and drop those whose code is not in the dimension."""
    return df.join(dim, list(on), "inner")
