"""Plans: what reaches the scan, what is shuffled, and what must never appear."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from microatlas.operators import scores
from microatlas.operators.filters import require, with_filters
from microatlas.plans import reports as r
from microatlas.runtime import scratch_root, settle

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups")
LAZY = (
    "r06_by_region r18_habits r20_study_against_work r27_municipality_options r31_by_region_of_state r32_coverage "
    "r36_score_histogram r37_confusion r40_race_by_income_nested r44_course_trends r46_trend_summary r49_race_performance "
    "evl4_class_report evl6_metrics_table lbl1_dimension_join lbl3_keep_known jn6_align_by_rank den1_dense_grid den2_class_matrix "
    "agg12_null_profile ml12_corr_matrix ml7_class_weights set1_stack_editions"
).split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_no_cross_join_and_no_python_anywhere(spark, sf, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = {n: [x for x in FORBIDDEN if x in plan(entry.queries()[n](spark, sf))] for n in LAZY}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {n: x for n, x in found.items() if x} == {}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact") / "t")
    spark.range(1000).select(
        (F.col("id") % 3 + 2014).cast("int").alias("nu_ano"), (F.col("id") % 5).cast("int").alias("co_regiao"),
        (F.col("id") % 4).cast("int").alias("qe_renda"), F.lit("x").alias("renda_nome"), F.rand(1).alias("nt_ger"),
        F.lit("unused").alias("no_ies"),
    ).write.partitionBy("nu_ano").parquet(path)
    return spark.read.parquet(path)


def test_filters_prune_and_push_down(stored):
    text = plan(r.income(stored, {"ano": "2015", "regiao": "2"}))
    assert "nu_ano" in text.split("PartitionFilters: [")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(co_regiao,2)" in pushed and "IsNotNull(nt_ger)" in pushed
    assert "no_ies" not in text


def test_null_guards_push_down(stored):
    text = plan(require(with_filters(stored, None), "qe_renda", "nt_ger").select("nt_ger"))
    assert "IsNotNull(qe_renda)" in text and "IsNotNull(nt_ger)" in text


def test_group_means_shuffle_only_partials(stored):
    text = plan(r.income_over_time(stored))
    scan_side = text[text.index("Exchange hashpartitioning"):]
    assert "partial_avg" in scan_side


def test_one_scan_for_many_groupings(stored):
    text = plan(r.statistics_in_one_scan(stored.withColumns({c: F.lit("a") for c in ("co_grupo", "curso_nome", "regiao_nome", "tipo_ies", "faixa_nota")})))
    assert text.count("FileScan") == 1


def test_trends_read_the_rows_once(stored):
    rows = stored.withColumn("curso_nome", F.col("renda_nome"))
    for df in (r.course_trends(rows), r.trend_summary(rows), r.overall_trend(rows)):
        assert plan(df).count("FileScan") == 1


def test_group_statistics_come_back_without_moving_the_rows(stored):
    text = plan(scores.normalise_within(stored, "nt_ger", "co_regiao", "n"))
    assert "BroadcastHashJoin" in text and "Window" not in text and "Exchange hashpartitioning" not in text


def test_settled_tables_broadcast_by_size_only(spark, stored):
    small = settle(stored.groupBy("qe_renda").agg(F.max("nt_ger").alias("m")))
    assert "BroadcastHashJoin" in plan(stored.join(small, "qe_renda"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "SortMergeJoin" in plan(stored.join(small, "qe_renda"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_is_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_root(spark) == named.rstrip("/")
