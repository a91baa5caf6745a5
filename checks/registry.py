"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """A query on the given tables; ``sql`` may use any of them."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = build
    if sql:
        ORACLE[name] = sql.strip()


def in_place(report: DataFrame) -> DataFrame:
    """A report with the place (from 1) each row has in it: its order as a column."""
    at = W.orderBy("_at")  # report rows are few
    numbered = report.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("ordem", F.row_number().over(at)).drop("_at")


def add_in_order(name: str, order: str) -> None:
    """The registered query again, with the place of each row checked against ``order``."""
    build = QUERIES[name]
    sql = f"select t.*, cast(row_number() over (order by {order}) as int) as ordem from ({ORACLE[name]}) t"
    add(f"{name}_in_order", lambda spark, sf: in_place(build(spark, sf)), sql)


def on_fact(
    name: str, columns: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None
) -> None:
    """A query on the fact-shaped view; ``sql`` may use ``fact`` and starts with SELECT
    or with further common table expressions."""
    text = None
    if sql:
        body = sql.strip()
        text = f"WITH {star.fact_sql()} {body}" if body[:6].upper() == "SELECT" else f"WITH {star.fact_sql()}, {body}"
    add(name, lambda spark, sf: build(star.fact(spark, sf, *columns.split())), text)
