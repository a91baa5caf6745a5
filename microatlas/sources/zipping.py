"""Rows of several sources side by side by position, without a shuffle.

Positions are dense, so ranges of them are the natural unit to meet in. Sources are
written into one layer that is bucketed by range: every task writes the few
ranges its split covers, and a bucket is read by one task whatever source its rows come
from. Grouping by range and position then needs no exchange; the layer takes the place
of the shuffle's files, and outlives executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from microatlas.runtime import scratch_path

RANGE = "_range"
LEAST = 1 << 12
MOST = 1 << 18


def range_width(spark: SparkSession, positions: int) -> int:
    """Positions per range, a power of two: enough ranges for all cores, none longer than MOST."""
    wanted = positions // (2 * spark.sparkContext.defaultParallelism)
    width = LEAST
    while width < MOST and width < wanted:
        width *= 2
    return width


def write_bucketed(rows: DataFrame, ranges: int, name: str, order: str) -> DataFrame:
    """The rows from a layer bucketed by ``RANGE``, each file in ``order``.

    The catalog knows the layer only while the frame is made: the frame keeps what it
    needs, and nothing is left to drop.
    """
    spark = rows.sparkSession
    table = f"layer_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    buckets = max(1, min(ranges, 50_000))
    writer = rows.write.format("parquet").option("path", path).bucketBy(buckets, RANGE).sortBy(order)
    writer.saveAsTable(table)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")
