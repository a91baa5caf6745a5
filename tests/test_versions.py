"""Served tables are replaced whole or not at all."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from microatlas.sources import tables, versions


def fact(spark, n, year=2014):
    return spark.range(n).select((F.col("id") % 3 + year).cast("int").alias("nu_ano"), (F.col("id") % 27).cast("int").alias("co_uf"), (F.col("id") % 5).cast("int").alias("co_grupo"), "id")


def broken(spark, n):
    """Fails in its last task, after the others have written."""
    bad = F.when(F.col("id") < n - 1, F.col("id")).otherwise(F.raise_error(F.lit("killed half way")).cast("bigint"))
    return fact(spark, n).withColumn("id", bad)


def test_a_write_that_fails_half_way_keeps_the_served_table(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_fact(fact(spark, 300), path)
    opened = tables.read_fact(spark, path)
    before = {p.name for p in (tmp_path / "fact").iterdir()}
    with pytest.raises(Exception, match="killed half way"):
        versions.replace(spark, path, broken(spark, 500).repartitionByRange(4, "id").write.partitionBy("nu_ano").parquet)
    left = {p.name for p in (tmp_path / "fact").iterdir()} - before
    assert opened.count() == tables.read_fact(spark, path).count() == 300
    assert len(versions.published(spark, path)) == 1 and len(left) <= 1
    with pytest.raises(Exception, match="killed half way"):
        tables.write_fact(broken(spark, 500), path)
    assert tables.read_fact(spark, path).count() == 300


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_fact(fact(spark, 100), path)
    opened = tables.read_fact(spark, path)
    tables.write_fact(fact(spark, 200, 2017), path)
    assert opened.count() == 100 and tables.read_fact(spark, path).count() == 200
    assert versions.read(spark, path, 1).count() == 100
    assert [n for n, _ in versions.published(spark, path)] == [1, 2]
    pruned = tables.read_fact(spark, path).filter("nu_ano = 2018")
    assert "PartitionFilters: [isnotnull(nu_ano" in pruned._jdf.queryExecution().executedPlan().toString()


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")

    def slow(folder):
        versions.replace(spark, path, fact(spark, 5).write.parquet)
        fact(spark, 7).write.parquet(folder)

    with pytest.raises(versions.LostRace):
        versions.replace(spark, path, slow)
    assert versions.read(spark, path).count() == 5
    with ThreadPoolExecutor(4) as pool:
        done = [pool.submit(versions.replace, spark, path, fact(spark, 10 + i).write.parquet) for i in range(4)]
    won = [f for f in done if f.exception() is None]
    assert won and all(isinstance(f.exception(), versions.LostRace) for f in done if f not in won)
    assert len(versions.published(spark, path)) == 1 + len(won)


def test_uncommitted_folders_are_not_published(spark, tmp_path):
    with pytest.raises(RuntimeError, match="not committed"):
        versions.replace(spark, str(tmp_path / "t"), lambda folder: None)
    assert versions.published(spark, str(tmp_path / "t")) == []


def test_old_versions_are_cleared(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3, 4):
        versions.replace(spark, path, fact(spark, n).write.parquet)
    with pytest.raises(Exception, match="killed"):
        versions.replace(spark, path, broken(spark, 50).write.parquet)
    assert len(versions.clear(spark, path, keep=2)) == 2
    assert [n for n, _ in versions.published(spark, path)] == [3, 4] and versions.read(spark, path).count() == 4
    versions.replace(spark, path, fact(spark, 6).write.parquet)
    gone = versions.clear(spark, path, keep=1)
    assert versions.read(spark, path).count() == 6 and len(gone) >= 2
    assert sum(p.name.startswith("version-") for p in (tmp_path / "t").iterdir()) == 1


def test_tables_without_versions_are_read_as_they_are(spark, tmp_path):
    fact(spark, 9).write.parquet(str(tmp_path / "plain"))
    assert tables.read_fact(spark, str(tmp_path / "plain")).count() == 9
