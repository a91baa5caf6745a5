from pyspark.sql import functions as F

from microatlas.sources.positions import aligned, file_order, parquet_rows, sorted_rank


def test_part_numbers_order_files(spark):
    names = ["d/part-99999-a-c000", "d/part-100000-a-c000", "d/part-00000-a-c001", "d/part-00000-a-c000", "c/part-5-x", "d/x.parquet"]
    df = spark.createDataFrame([(f"/{n}",) for n in names], "_file string")
    got = [r[0][1:] for r in df.orderBy(*file_order()).collect()]
    assert got == ["c/part-5-x", "d/x.parquet", "d/part-00000-a-c000", "d/part-00000-a-c001", "d/part-99999-a-c000", "d/part-100000-a-c000"]


def test_positions_over_many_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "t"))
    rows = parquet_rows(spark, str(tmp_path / "t"), ["id"])
    assert rows.filter("id <> pos").count() == 0 and rows.count() == 1000


def test_shorter_pieces_are_filled(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    spark.range(3).select((F.col("id") * 10).alias("x")).coalesce(1).write.parquet(str(tmp_path / "b"))
    rows = aligned(spark, [(str(tmp_path / "a"), ["id"]), (str(tmp_path / "b"), ["x"])], "i")
    got = sorted((r.i, r.x) for r in rows.collect())
    assert got == [(0, 0), (1, 10), (2, 20), (3, None), (4, None)]


def test_sorted_rank_is_a_total_order(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("v")).repartition(5)
    out = sorted_rank(df, ["v"], "place").orderBy("v").collect()
    assert [r.place for r in out] == list(range(2000))


def test_pieces_meet_without_a_shuffle(spark, tmp_path):
    spark.range(20_000).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "a"))
    spark.range(15_000).select((F.col("id") * 10).alias("x")).coalesce(1).write.parquet(str(tmp_path / "b"))
    rows = aligned(spark, [(str(tmp_path / "a"), ["id"]), (str(tmp_path / "b"), ["x"])], "i")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    wrong = rows.filter("i <> id OR (i < 15000 AND x <> 10 * i) OR (i < 15000) <> (x IS NOT NULL)")
    assert rows.count() == 20_000 and wrong.count() == 0
