"""Ordered tables are read page by page without sorting them."""

from pyspark.sql import functions as F

from microatlas.sources import ordered

NAMES = ["Ávila", "avila", "Zebu", "Éden", "eden", "Eden", "Çam", "cama", "Água", "agua"]


def test_pages_follow_the_collation(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"{n} {i:03d}", i) for i in range(60) for n in NAMES], "nome string, i int").repartition(5)
    order = [F.collate("nome", "UNICODE"), "i"]
    ordered.write_ordered(rows, path, order, rows_per_file=70)
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    got = []
    for first in range(0, 600, 45):
        page = ordered.read_page(spark, path, first, 45)
        got += [(r.nome, r.i) for r in page.collect()]
        assert page.columns == ["nome", "i", "posicao"]
    assert got == want and ordered.count(spark, path) == 600
    assert [r.posicao for r in ordered.read_page(spark, path, 130, 20).collect()] == list(range(130, 150))


def test_a_page_opens_only_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    ordered.write_ordered(spark.range(5000).select((5000 - F.col("id")).alias("v")).repartition(6), path, ["v"], rows_per_file=500)
    first = ordered.read_page(spark, path, 0, 20)
    assert len(first.inputFiles()) == 1 and [r.v for r in first.collect()] == list(range(1, 21))
    assert 2 <= len(ordered.read_page(spark, path, 450, 600).inputFiles()) <= 5
    assert ordered.read_page(spark, path, 5000, 10).collect() == []
    assert [r.v for r in ordered.read_page(spark, path, 4995, 10).collect()] == list(range(4996, 5001))


def test_replacing_keeps_the_old_pages_until_the_new_ones_are_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    ordered.write_ordered(spark.range(30), path, ["id"])
    bad = spark.range(9).withColumn("id", F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("bigint")))
    try:
        ordered.write_ordered(bad, path, ["id"])
        raise AssertionError("the write should fail")
    except Exception as error:
        assert "broken" in str(error)
    assert ordered.count(spark, path) == 30
    ordered.write_ordered(spark.range(0), path, ["id"])
    assert ordered.count(spark, path) == 0 and ordered.read_page(spark, path, 0, 5).collect() == []
