"""Tables kept in the order in which they are shown, read page by page.

Rows are sorted by ranges into files once, when the table is written, and a small index
says which positions each file holds. A page opens the files that hold its
positions, the first page one file, and nothing is sorted but the page itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas.sources import versions
from microatlas.sources.positions import file_order


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column], rows_per_file: int = 1_000_000) -> None:
    """Replace the ordered table. ``order`` may hold collated columns; rows that are equal in
    it stand in any order, so name a unique column last."""
    spark = df.sparkSession

    def write(folder: str) -> None:
        df.orderBy(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/rows")
        stored = spark.read.parquet(f"{folder}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        # One row per file enters this window.
        upto = F.sum("n").over(W.orderBy(*file_order("file")))
        name = F.regexp_extract("file", "[^/]*$", 0)
        stored.select(name.alias("file"), (upto - F.col("n")).alias("first"), upto.alias("end")).coalesce(1).write.parquet(f"{folder}/files")

    versions.replace(spark, path, write, last="files")


def read_page(spark: SparkSession, path: str, first: int, rows: int, position: str = "posicao") -> DataFrame:
    """``rows`` rows from position ``first`` (from 0) on, in order, with their position."""
    folder = versions.current(spark, path)
    index = spark.read.parquet(f"{folder}/files")
    # As many files as the page touches.
    held = index.filter((F.col("first") < first + rows) & (F.col("end") > first)).collect()
    schema = spark.read.parquet(f"{folder}/rows").schema
    if not held:
        return spark.createDataFrame([], schema).withColumn(position, F.lit(0).cast("bigint"))
    table = spark.read.schema(schema).parquet(*[f"{folder}/rows/{r.file}" for r in held])
    starts = F.create_map(*[F.lit(x) for r in held for x in (r.file, r["first"])])
    at = starts[F.col("_metadata.file_name")] + F.col("_metadata.row_index")
    return table.withColumn(position, at).filter(F.col(position).between(first, first + rows - 1)).orderBy(position)


def count(spark: SparkSession, path: str) -> int:
    """Rows of the table, from the index."""
    return spark.read.parquet(f"{versions.current(spark, path)}/files").agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
