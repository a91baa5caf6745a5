"""Table layers: Parquet in, Parquet / CSV / JDBC out.

The served tables, fact and metrics, are replaced as ``sources.versions`` says: a write that
fails leaves the last whole table in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas import config
from microatlas.operators.cleaning import rename_existing
from microatlas.runtime import settle
from microatlas.sources import versions

ID_BUCKET = 1 << 16


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """The served fact table; filters on the edition prune folders."""
    return versions.read(spark, path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path).orderBy("id")


def with_dense_id(
    df: DataFrame, year: str = "nu_ano", position: str = "pos", name: str = "id"
) -> DataFrame:
    """Consecutive ids from 0 in (edition, position) order.

    Positions are cut into fixed ranges. A range holds at most its width in rows,
    so the numbering window inside it is bounded, and only one count per range
    enters the running sum over ranges.
    """
    cut = df.withColumn("_range", F.floor(F.col(position) / ID_BUCKET).cast("bigint"))
    counts = cut.groupBy(year, "_range").agg(F.count(F.lit(1)).alias("_n"))
    per_year = settle(counts, "id-ranges")
    years_before = (
        per_year.groupBy(year)
        .agg(F.sum("_n").alias("_year_n"))
        .select(
            year,
            (F.sum("_year_n").over(W.orderBy(year)) - F.col("_year_n")).alias("_years_before"),
        )
    )
    upto = F.sum("_n").over(W.partitionBy(year).orderBy("_range"))
    starts = (
        per_year.withColumn("_upto", upto)
        .join(years_before, year)
        .select(
            year, "_range", (F.col("_years_before") + F.col("_upto") - F.col("_n")).alias("_start")
        )
    )
    within = F.row_number().over(W.partitionBy(year, "_range").orderBy(position)) - 1
    return (
        cut.withColumn("_within", within)
        .join(starts, [year, "_range"])
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_range", "_within", "_start")
    )


def fact_layout(df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Only the mapped columns that exist, under their serving names."""
    extra = {c: c for c in keep if c in df.columns}
    return rename_existing(df, {**extra, **config.FACT_COLUMNS})


def write_fact(
    df: DataFrame,
    path: str,
    cluster_by: Sequence[str] = ("co_uf", "co_grupo"),
    spread_by: Sequence[str] = ("id",),
    partitions: int | None = None,
) -> None:
    """Replace the fact table: a folder per edition, files cut by ranges.

    Rows are dealt by ranges of (edition, state, course, id), so a file holds a narrow
    range of states and courses and its statistics prune filters on them; ``spread_by``
    cuts a course that fills more than one file. An edition has no more files than
    ranges that touch it. ``partitions`` fixes their number; by default AQE sizes them.
    """
    order = ["nu_ano", *[c for c in (*cluster_by, *spread_by) if c in df.columns]]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order)
    placed = ranged.sortWithinPartitions(*order)
    versions.replace(df.sparkSession, path, lambda folder: placed.write.partitionBy("nu_ano").parquet(folder))


def write_metrics(df: DataFrame, path: str) -> None:
    versions.replace(df.sparkSession, path, df.write.parquet)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 5000) -> None:
    """The same table into a database: one connection per partition, batched inserts."""
    df.write.mode("overwrite").option("batchsize", batch).jdbc(url, table, properties=properties)
