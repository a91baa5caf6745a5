"""Session, shared scratch folder and settled tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_roots: dict[str, str] = {}
_owners: list[list[str]] = []


def local_session(app: str = "microatlas", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or an own one for a local session."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="microatlas-")
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused between calls.

    Inside ``owned_scratch`` it is deleted at the end of the block.
    """
    app = spark.sparkContext.applicationId
    path = os.path.join(scratch_root(spark), f"microatlas-{app}", f"{name}-{uuid.uuid4().hex}")
    if _owners:
        _owners[-1].append(path)
    return path


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what the block has settled when it ends, also when it fails.

    For callers that have written their result by then; a frame that is still lazy would
    lose its source. Blocks may be nested; paths belong to the innermost one.
    """
    _owners.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _owners.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives Catalyst
    the true size of the table: a join with it broadcasts only while it is
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles (with AQE skew
    splitting) beyond.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class SettledParts:
    """A settled table in one folder per value of an integer column.

    A part is read from its own folder, so Catalyst sizes it by itself, not by the
    whole table.
    """

    spark: SparkSession
    path: str
    column: str
    schema: T.StructType

    def table(self) -> DataFrame:
        """All parts."""
        whole = T.StructType([*self.schema.fields, T.StructField(self.column, T.IntegerType())])
        return self.spark.read.schema(whole).parquet(self.path)

    def part(self, value: int) -> DataFrame:
        """One part, without rows when nothing has that value."""
        folder = f"{self.path}/{self.column}={value}"
        own = self.spark.read.schema(self.schema)
        try:
            return own.parquet(folder)
        except AnalysisException:  # no such folder
            return self.table().filter(F.lit(False)).drop(self.column)


def settle_parts(df: DataFrame, column: str, name: str = "settled") -> SettledParts:
    path = scratch_path(df.sparkSession, name)
    df.withColumn(column, F.col(column).cast("int")).write.partitionBy(column).parquet(path)
    fields = [f for f in df.schema.fields if f.name != column]
    return SettledParts(df.sparkSession, path, column, T.StructType(fields))
