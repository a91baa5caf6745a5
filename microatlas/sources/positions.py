"""Row positions of Parquet tables, and ranks read off sorted files.

A Parquet scan knows each row's index in its file. Adding the rows of all earlier
files (in path order) gives the position in the table, for any number of files and
without sorting or a window over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas.runtime import scratch_path, settle
from microatlas.sources.zipping import RANGE, range_width, write_bucketed


def file_order(file: str = "_file") -> list[Column]:
    """Folder, then part number (beyond five digits names no longer sort), then name."""
    return [
        F.regexp_replace(file, "[^/]*$", ""),
        F.regexp_extract(file, "/part-([0-9]+)[^/]*$", 1).try_cast("bigint"),
        F.col(file),
    ]


def parquet_rows(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, position: str = "pos"
) -> DataFrame:
    """Columns of a Parquet table with each row's 0-based position."""
    table = spark.read.parquet(path)
    rows = table.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
        *(columns if columns is not None else table.columns),
    )
    counts = settle(rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows")), "file-rows")
    # One row per file enters this window.
    earlier = W.orderBy(*file_order()).rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.join(before, "_file")
    return placed.withColumn(position, F.col("_row") + F.col("_before")).drop("_file", "_row", "_before")


def aligned(
    spark: SparkSession, pieces: Sequence[tuple[str, Sequence[str]]], position: str | None = None
) -> DataFrame:
    """Columns of several tables side by side, row i with row i.

    Shorter tables are filled with nulls. Pieces meet in a layer bucketed by ranges of
    positions, each as one value of its own, and are grouped without a shuffle.
    """
    own = [f"_piece{i}" for i in range(len(pieces))]
    narrow = [
        parquet_rows(spark, path, columns, "_i").select("_i", F.struct(*columns).alias(name))
        for name, (path, columns) in zip(own, pieces)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), narrow)
    longest = max(spark.read.parquet(path).count() for path, _ in pieces)  # from the files' footers
    width = range_width(spark, longest)
    ranged = stacked.withColumn(RANGE, F.floor(F.col("_i") / width).cast("bigint"))
    layer = write_bucketed(ranged, longest // width + 1, "aligned", "_i")
    rows = layer.groupBy(RANGE, "_i").agg(*[F.any_value(c, True).alias(c) for c in own])
    values = [F.col(name)[c].alias(c) for name, (_, columns) in zip(own, pieces) for c in columns]
    return rows.select(*([F.col("_i").alias(position)] if position else []), *values)


def sorted_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """0-based place of every row in a total order.

    Spark sorts by ranges into files; the place is the position in those files. No
    task ever holds more than one range, unlike a window without partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    df.orderBy(*order).write.parquet(path)
    return parquet_rows(spark, path, df.columns, name)
