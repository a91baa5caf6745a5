"""Quirks on tiny frames: nulls, ties, constant groups, orders, denominators."""

import math

import pytest
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions import columns as fc
from microatlas.operators import aggregates as agg
from microatlas.operators import cleaning, filters, labels, reshape, scores, split, trend


def one(spark, expr, value=None, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("12.5", 12.5), (" 12.5 ", 12.5), ("12,5", None), ("12.5d", None), ("NaN", None), ("Infinity", None),
     ("1e3", 1000.0), ("-.5", -0.5), ("", None), (None, None), ("abc", None), ("1e999", None)],
)
def test_tolerant_number(spark, text, want):
    assert one(spark, fc.number("x"), text, "string") == want


@pytest.mark.parametrize("text,want", [("72", 72), ("72.0", 72), ("72.5", None), ("x", None), ("1e30", None)])
def test_tolerant_whole_number(spark, text, want):
    assert one(spark, fc.whole_number("x"), text, "string") == want


@pytest.mark.parametrize("value,want", [(0.0, 0), (9.99, 0), (10.0, 10), (99.9, 90), (100.0, 90), (None, None)])
def test_bucket_clamps_the_top_and_keeps_null(spark, value, want):
    assert one(spark, fc.bucket("x"), value) == want


def test_clamps_keep_null(spark):
    assert one(spark, fc.to_ceiling("x"), None) is None
    assert one(spark, fc.to_ceiling("x"), 120.0) == 100.0
    assert one(spark, fc.point_radius("x"), None) is None
    assert one(spark, fc.point_radius("x"), 1.0) == 4.0
    assert one(spark, fc.point_radius("x"), 1e6) == 30.0


def test_rounding_modes(spark):
    assert one(spark, fc.rounded("x", 2), 2.675) == 2.68
    assert one(spark, fc.rounded("x", 2), 0.125) == 0.13
    assert one(spark, fc.rounded_half_even("x", 2), 0.125) == 0.12


def test_share_of_nothing_is_zero(spark):
    assert one(spark, fc.percent(F.lit(3), F.lit(0)), 1.0) == 0.0
    assert one(spark, fc.ratio(F.lit(3), F.lit(0)), 1.0) == 0.0


def test_band_edges(spark):
    got = [one(spark, fc.band("x", 33.0, 66.0), v) for v in (33.0, 33.1, 66.0, 66.1, None)]
    assert got == ["baixo", "medio", "medio", "alto", None]


def test_label_miss_and_fallback(spark):
    assert one(spark, fc.label("x", config.CATEGORY_NAMES), 6, "int") is None
    assert one(spark, fc.label("x", config.RACE_NAMES, F.col("x").cast("string")), 9, "int") == "9"
    assert one(spark, fc.label("x", config.RACE_NAMES), None, "int") is None


def test_missing_tokens_only_as_whole_values(spark):
    df = spark.createDataFrame([(".", 1), ("", 2), (" ", 3), ("NA", 4), ("NAO", 5), ("1.", 6)], "a string, b int")
    assert [r.a for r in cleaning.blank_to_null(df).orderBy("b").collect()] == [None] * 4 + ["NAO", "1."]


def test_presence_filter_only_when_the_column_exists(spark):
    df = spark.createDataFrame([(1.0, " 555 "), (2.0, "222"), (None, "555"), (3.0, None)], "NT_GER double, TP_PRES string")
    assert [r.NT_GER for r in cleaning.present_with_score(df).collect()] == [1.0]
    assert cleaning.present_with_score(df.drop("TP_PRES")).count() == 3


def test_null_group_counts_zero(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0), (None, 5.0)], "g string, x double")
    got = {r.g: (r.total, r.media) for r in agg.count_present(df, ["g"], "g", {"media": "x"}).collect()}
    assert got == {"a": (1, 1.0), None: (0, 4.0)}


def test_normalise_constant_and_null(spark):
    rows = [(1, 10.0), (1, 20.0), (1, None), (2, 7.0), (2, 7.0), (None, 5.0)]
    out = scores.normalise_within(spark.createDataFrame(rows, "g int, x double"), "x", "g", "n")
    got = sorted((r.g or 0, -1 if r.x is None else r.x, r.n) for r in out.collect())
    assert got == [(0, 5.0, None), (1, -1, None), (1, 10.0, 0.0), (1, 20.0, 100.0), (2, 7.0, 50.0), (2, 7.0, 50.0)]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_group_statistics_with_and_without_broadcast(spark, threshold):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, threshold)
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
        out = scores.attach_group_stats(df, ["g"], n=F.count("id"), lo=F.min("id"))
        assert out.count() == 3000 and out.filter("g = 'hot' and (n <> 1000 or lo <> 0)").count() == 0
        assert out.filter("g <> 'hot' and (n <> 1 or lo <> id)").count() == 0
    finally:
        for n in names:
            spark.conf.unset(n)


def test_codes_follow_text_order_and_keep_null(spark):
    df = spark.createDataFrame([(10, "b"), (9, None), (2, "a"), (None, "b")], "n int, s string")
    out = scores.encode_categories(df, ["n", "s"])
    got = {(r.n, r.s): (r.n_code, r.s_code) for r in out.collect()}
    assert got == {(10, "b"): (0, 1), (2, "a"): (1, 0), (9, None): (2, None), (None, "b"): (None, 1)}


def test_bands_of_an_empty_score(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert scores.quantile_bands(df, "x", "b").first().b is None
    assert scores.quantile_bands(spark.createDataFrame([(float(i),) for i in range(100)], "x double"), "x", "b", approximate=True).filter("b is null").count() == 0


def test_filters_ignore_absent_and_empty(spark):
    df = spark.createDataFrame([(2014, 72, 0), (2017, 72, 1)], "nu_ano int, co_grupo bigint, co_regiao int")
    assert filters.with_filters(df, {"ano": "", "curso": None, "outro": 1}).count() == 2
    assert filters.with_filters(df, {"regiao": 0}).count() == 1
    assert filters.with_filters(df, {"ano": "2017", "curso": "72"}).count() == 1
    assert filters.with_filters(df, None).count() == 2


def test_network_mean_is_over_all_merged_categories(spark):
    rows = [("A", "Pública Federal", 10.0), ("A", "Pública Estadual", 20.0), ("A", "Pública Estadual", 30.0), ("A", "Especial", 5.0)]
    df = spark.createDataFrame(rows, "d string, t string, x double")
    got = reshape.two_sides(df, ["d"], fc.network("t"), (("Pública", "a", "n_a"), ("Privada", "b", "n_b")), "x").first()
    assert (got.a, got.n_a, got.b, got.n_b) == (20.0, 3, 5.0, 1)


def test_dense_grid_fills_zero_and_drops_unknown(spark):
    df = spark.createDataFrame([("a", 1, 5), ("z", 1, 9)], "k string, y int, n bigint")
    got = {(r.k, r.y): r.n for r in reshape.densify(df, "n", k=["a", "b"], y=[1, 2]).collect()}
    assert got == {("a", 1): 5, ("a", 2): 0, ("b", 1): 0, ("b", 2): 0}


def test_share_of_shown_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, total bigint")
    assert {r.k: r.pct for r in agg.share_of_total(df).collect()} == {"a": 33.3, "b": 66.7}


def test_first_last_and_extremes(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("b", 2, None), ("c", 3, 25.0), ("d", None, 99.0)], "k string, o int, m double")
    got = agg.last_over_first(df, "m", "o").first()
    assert (got.primeiro, got.ultimo, got.fator) == (10.0, 25.0, 2.5)
    e = agg.extremes(df, "k", "m").first()
    assert (e.menor_nome, e.maior_nome, e.maior_valor) == ("a", "d", 99.0)


def brute_line(xs, ys):
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    b1 = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    b0 = my - b1 * mx
    tot = sum((y - my) ** 2 for y in ys)
    res = sum((y - b0 - b1 * x) ** 2 for x, y in zip(xs, ys))
    return b0, b1, 1 - res / tot if tot > 0 else 1.0


def test_trend_projects_and_judges(spark):
    years = (2014, 2017, 2021)
    data = {"down": (47.2, 44.7, 41.3), "flat": (50.0, 50.0, 50.0), "steep": (90.0, 50.0, 5.0), "noisy": (40.0, 60.0, 41.0)}
    rows = [(k, y, v) for k, vs in data.items() for y, v in zip(years, vs)] + [("few", 2014, 1.0), ("few", 2017, 2.0)]
    points = spark.createDataFrame(rows, "k string, ano int, media double")
    out = trend.trend(points, years, (2024, 2027), ["k"], require_reliable=True).collect()
    by = {(r.k, r.ano): r for r in out}
    assert {r.k for r in out} == set(data)
    for k, vs in data.items():
        b0, b1, r2 = brute_line(years, vs)
        got = by[k, 2024]
        assert math.isclose(got.b1, round(b1, 4), abs_tol=1e-9) and math.isclose(got.r2, round(r2, 4), abs_tol=1e-9)
        sure = r2 >= 0.75 and all(20 <= b0 + b1 * y <= 100 for y in (2024, 2027))
        assert got.confiavel == sure
        assert got.projecao == (pytest.approx(round(b0 + b1 * 2024, 2)) if sure else None)
        assert by[k, 2017].media == vs[1] and by[k, 2017].projecao is None
    # The published projections come from unrounded means; these come from one decimal.
    assert by["down", 2024].projecao == pytest.approx(38.9, abs=0.2)
    assert by["down", 2027].projecao == pytest.approx(36.4, abs=0.2)
    assert by["flat", 2024].r2 == 1.0


def test_grouping_sets_equal_separate_reports(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 6.0), (2, None, None)], "y int, k string, x double")
    out = agg.group_sets(df, {"ano": ["y"], "par": ["y", "k"], "k": ["k"]}, {"media": "x"}, known=["k"]).collect()
    got = {(r.relatorio, r.y, r.k): (r.total, r.media) for r in out}
    assert got["ano", 1, None] == (2, 1.5) and got["ano", 2, None] == (2, 6.0)
    assert got["par", 2, None] == (1, None) and got["k", None, "a"] == (2, 3.5)
    assert len(got) == 2 + 4 + 2


def test_holdout_is_exact_per_class_even_when_one_is_hot(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 9 < 7, "hot").when(F.col("id") % 9 == 7, "b").otherwise("c").alias("y"))
    marked = split.stratified_holdout(df.union(spark.createDataFrame([(-1, None)], "id bigint, y string")), "y", ["id"])
    got = {(r.y, r.teste): r.n for r in marked.groupBy("y", "teste").agg(F.count("*").alias("n")).collect()}
    assert got == {("hot", True): 1400, ("hot", False): 5600, ("b", True): 200, ("b", False): 800, ("c", True): 200, ("c", False): 800}
    again = split.stratified_holdout(df.repartition(7), "y", ["id"]).filter("teste")
    assert marked.filter("teste").select("id").exceptAll(again.select("id")).count() == 0


def test_tiny_class_without_test_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")] + [(i, "c") for i in range(10, 20)], "id int, y string")
    got = {r.y: r.n for r in split.stratified_holdout(df, "y", ["id"]).groupBy("y").agg(F.count_if("teste").alias("n")).collect()}
    assert got == {"a": 0, "b": 0, "c": 2}


def test_lookup_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), (None,), ("x",)], "k string")
    dim = labels.dimension(spark, {"a": "Um"}, "k", "v")
    got = {r.k: r.nome for r in labels.lookup(df, dim, "k", "k", "nome", "v", "?").collect()}
    assert got == {"a": "Um", None: "?", "x": "?"}


def test_public_by_pattern_or_by_words(spark):
    from microatlas import config
    from microatlas.functions.columns import network

    kinds = ["Pública Federal", "Federal", "Estadual", "Municipal", "Privada sem fins lucrativos", "Especial"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    narrow = {r.k: r.n for r in df.select("k", network("k").alias("n")).collect()}
    wide = {r.k: r.n for r in df.select("k", network("k", words=config.PUBLIC_WORDS).alias("n")).collect()}
    assert [k for k in kinds if narrow[k] == "Pública"] == kinds[:1]
    assert [k for k in kinds if wide[k] == "Pública"] == kinds[:4]


def test_codes_that_became_text_keep_their_order(spark):
    from microatlas.functions.columns import code_order
    from microatlas.operators.reshape import nested_cells

    df = spark.createDataFrame([("g", c) for c in ["10", "9", "B", "1", None, "A", "0"]], "g string, codigo string")
    want = ["0", "1", "9", "10", "A", "B", None]
    assert [r.codigo for r in df.orderBy(*code_order("codigo")).collect()] == want
    cells = nested_cells(df.dropna(), ["g"], ["codigo"], "lista", F.col("codigo").try_cast("bigint")).first()
    assert [c.codigo for c in cells.lista] == want[:-1]


def test_every_state_has_one_region():
    from microatlas import config

    assert set(config.REGION_OF_STATE) == set(config.STATE_INITIALS.values())
    assert set(config.REGION_OF_STATE.values()) == set(config.REGION_NAMES.values())
