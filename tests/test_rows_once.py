"""Model queries read the rows that they are given once: what makes them may be a join of large tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from checks import model_queries as q

ROWS = 600


@pytest.fixture
def rows(spark):
    """Rows of which one column counts how often it is made."""
    made = spark.sparkContext.accumulator(0)

    def code(x):
        made.add(1)
        return x % 4

    i = F.col("id")
    none = lambda every, value: F.when(i % every != 0, value.cast("int"))
    return made, spark.range(ROWS).select(
        i.alias("l_orderkey"), (i % 7).cast("int").alias("l_linenumber"), (i % 11).alias("l_partkey"), (i % 13).alias("l_suppkey"),
        none(5, i % 4).alias("qe_renda"), none(6, i % 5).alias("qe_escola_em"), none(7, i % 6).alias("qe_financiamento"), (i % 7).cast("int").alias("qe_raca_cor"),
        F.udf(code, IntegerType())(i).alias("qe_trabalha"), (F.floor(i / 4) % 4).cast("int").alias("qe_horas_estudo"), (i % 3).cast("int").alias("qe_horas_trabalho"),
        (i % 5 + 1).cast("int").alias("co_categad"), none(9, i % 101).cast("double").alias("nt_ger"),
    )


def test_standardising(spark, rows):
    made, f = rows
    small = f.withColumn("qe_renda", F.col("qe_trabalha"))
    found = q._standard(small).select(*q.SMALL).agg(*[F.avg(c) for c in q.SMALL], *[F.var_pop(c) for c in q.SMALL]).first()
    assert list(found) == pytest.approx([0, 0, 0, 1, 1, 1], abs=1e-9)
    assert made.value == ROWS


@pytest.mark.parametrize("query", [q._forest_holdout, q._block_forest, q._all_models])
def test_models(spark, rows, query):
    made, f = rows
    known = f.drop("qe_trabalha").filter("nt_ger is not null").count() if query is q._all_models else ROWS
    found = query(f).collect()
    assert found[0].total == (round(ROWS * 0.2) if query is q._forest_holdout else known)
    assert known <= made.value <= ROWS


def test_scores_are_looked_up_by_distinct_points(spark, monkeypatch):
    """Nulls, both zeros and NaN find their score; beyond the bound rows are scored one by one."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from microatlas.operators import models

    f = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("a"),
        F.expr("case id % 5 when 0 then null when 1 then double('nan') when 2 then -0.0d when 3 then 0.0d else 1.5d end").alias("b"),
    )
    pipeline = PipelineModel([SQLTransformer(statement="SELECT *, coalesce(a, 7) * 10 + coalesce(nullif(b, double('nan')), 3) AS s FROM __THIS__")])
    alone = sorted(pipeline.transform(f).select("id", "a", "s").collect(), key=lambda x: x.id)
    for most in (models.MOST_POINTS, 2):
        monkeypatch.setattr(models, "MOST_POINTS", most)
        scored = models.score_rows(pipeline, f, ["a", "b"], {"s": "found"})
        assert scored.columns == ["id", "a", "b", "found"]
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (most > 2) and "NestedLoop" not in plan
        assert sorted(scored.select("id", "a", "found").collect(), key=lambda x: x.id) == [tuple(x) for x in alone]
