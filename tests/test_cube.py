"""The stored cube: its size where municipalities are many, its answers, and the joins that feed it."""

import os
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import star
from microatlas.plans import cube, endpoints

YEARS, COURSES = 3, 2


def _fact(spark, rows: int, places: int):
    i = F.col("id")
    none = lambda every, value: F.when(i % every != 0, value)
    return spark.range(rows).select(
        (2014 + i % YEARS).cast("int").alias("nu_ano"), (70 + i % COURSES).alias("co_grupo"), (i % COURSES).cast("string").alias("curso_nome"),
        F.lit("Bacharelado").alias("tipo_ensino"), none(11, (i % 2).cast("int")).alias("co_regiao"), (i % 2).cast("string").alias("regiao_nome"),
        (i % 2 * 10).alias("co_uf"), none(13, F.pmod(F.xxhash64(i), F.lit(places))).alias("co_municipio"), none(7, F.lit("Privada")).alias("tipo_ies"),
        none(5, F.lit("alto")).alias("faixa_nota"), none(3, (i % 4).cast("int")).alias("qe_renda"), none(3, (i % 4).cast("string")).alias("renda_nome"),
        (i % 3).cast("int").alias("qe_escola_em"), (i % 3).cast("string").alias("escola_em_nome"), (i % 2).cast("int").alias("qe_trabalha"),
        (i % 4).cast("int").alias("qe_horas_estudo"), none(9, (i % 5).cast("int")).alias("qe_financiamento"), F.lit("A").alias("qe_estado_civil"),
        none(5, (i % 97) / 2).alias("nt_ger"), none(4, (i % 89) * 1.0).alias("nt_fg"), (i % 83).cast("int").alias("nt_ce"),
    )


@pytest.mark.parametrize(("rows", "places", "folds"), [(3000, 100_000, False), (30_000, 2, True)])
@pytest.mark.parametrize("chosen", [None, {"ano": "2015", "regiao": "1"}, {"municipio": "1"}, {"municipio": "1", "curso": "71", "uf": "10"}])
def test_answers_with_many_and_with_few_municipalities(spark, tmp_path, rows, places, folds, chosen):
    fact = _fact(spark, rows, places)
    if not folds:  # some rows for the one that is asked for
        fact = fact.withColumn("co_municipio", F.when(F.col("co_municipio") % 9 == 0, 1).otherwise(F.col("co_municipio")).cast("bigint"))
    cube.write(fact, str(tmp_path / "cube"))
    stored = cube.read(spark, str(tmp_path / "cube"))
    by_place = stored.filter(F.col(cube.CUT) == cube.BY_PLACE)
    assert (by_place.count() < rows) == folds and by_place.agg(F.sum("n")).first()[0] == rows
    from_rows = endpoints.socioeconomico(fact, chosen) | endpoints.estatisticas(fact, chosen)
    from_cube = endpoints.socioeconomico(None, chosen, stored) | endpoints.estatisticas(None, chosen, stored)
    for name, expected in from_rows.items():
        assert from_cube[name].dtypes == expected.dtypes, name
        a, b = from_cube[name].collect(), expected.collect()
        assert len(a) == len(b) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for p, q in zip(a, b) for x, y in zip(p, q)), name


def test_municipalities_are_stored_once(spark, tmp_path):
    """With a municipality for nearly every row each cut had nearly as many cells as rows."""
    rows = 3000
    cube.write(_fact(spark, rows, 10**9), str(tmp_path / "cube"))
    stored = cube.read(spark, str(tmp_path / "cube"))
    assert stored.count() < 2 * rows
    assert stored.filter("co_municipio is not null").select(cube.CUT).distinct().count() == 1
    assert not [name for folder in os.listdir(tmp_path / "cube") if folder.startswith("version-") for name in os.listdir(tmp_path / "cube" / folder) if name == "_cells"]


def test_scores_keep_their_types(spark, tmp_path):
    fact = _fact(spark, 500, 3).withColumn("nt_ger", F.col("nt_ger").cast("decimal(7,2)"))
    cube.write(fact, str(tmp_path / "cube"))
    for chosen in (None, {"municipio": "1"}):
        own = fact.filter("co_municipio = 1") if chosen else fact
        found = cube.statistics(cube.read(spark, str(tmp_path / "cube")), chosen)["media_notas"].first()
        low, high = own.agg(F.min("nt_ger"), F.max("nt_ger")).first()
        assert isinstance(found["min_nt_ger"], Decimal) and (found["min_nt_ger"], found["max_nt_ger"]) == (low, high)


@pytest.fixture
def odd_star(spark, tmp_path):
    """Star tables in which keys are null, come twice or find no partner."""
    rows = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
                     [(o, p, 1, n, 13.0 + n, 1000.0 * n, 0.1, 0.02, "A", "O") for n, (o, p) in enumerate([(1, 1), (1, 2), (2, None), (3, 9), (None, 1), (8, 1), (4, 2)])]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(o, c, "F", 1.0, __import__("datetime").datetime(1995 + (o or 0) % 5, 2, 1), "1-URGENT") for o, c in [(1, 1), (1, 2), (2, None), (3, 7), (4, 3), (None, 1)]]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(c, "x", n, 1.0, s) for c, n, s in [(1, 0, "BUILDING"), (1, 1, "MACHINERY"), (2, None, "FURNITURE"), (3, 5, "BUILDING"), (None, 0, "BUILDING")]]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "NATION_0", 0), (1, "NATION_1", 4), (1, "NATION_9", 0), (None, "NATION_2", 0)]),
        "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (0, "EUROPE"), (None, "AFRICA")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "x", "x", "PROMO", 7, 1.0), (2, "x", "x", "LARGE", 3, 1.0), (2, "x", "x", "SMALL", 4, 1.0), (None, "x", "x", "ECONOMY", 5, 1.0)]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).createOrReplaceTempView(name)
    return str(tmp_path)


def test_the_view_is_that_of_its_sql(spark, odd_star):
    expected = spark.sql(f"WITH {star.fact_sql()} SELECT * FROM fact").collect()
    assert Counter(star.fact(spark, odd_star).collect()) == Counter(expected)


def test_line_items_are_not_shuffled_by_customer(spark, odd_star):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = star.fact(spark, odd_star)._jdf.queryExecution().sparkPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "Join [o_custkey" in line)
    below = [line for d, line in zip(depth[at + 1 :], lines[at + 1 :]) if d > depth[at]]
    assert any("c_custkey" in line for line in below) and not any("l_orderkey" in line for line in below)
