"""The whole job on hand-made fragments, stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

from microatlas import config
from microatlas.plans import endpoints, job
from microatlas.plans import reports as r
from microatlas.sources.tables import read_fact, read_metrics
from tests.test_fragments import write


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    rng = random.Random(1)
    for year in config.EDITIONS:
        n, folder = 240, root / f"e{year}"
        income = [rng.choice("ABCDEFG") for _ in range(n)]
        score = [f"{10 * 'ABCDEFG'.index(i) + rng.randint(0, 29)}.0" if rng.random() > 0.1 else "." for i in income]
        states = [rng.choice(["35", "33", "52", "99"]) for _ in range(n)]
        write(folder / "a.txt", ["NU_ANO", "CO_CURSO", "CO_GRUPO", "CO_REGIAO_CURSO", "CO_CATEGAD", "CO_ORGACAD", "CO_MODALIDADE", "CO_UF_CURSO", "CO_MUNIC_CURSO", "NO_IES"],
              [("0", "1", rng.choice(["72", "4004", "4005", "5"]), rng.choice("12345"), rng.choice("123457"), "1", rng.choice("12"), s, "35" + s, "Inst ção") for s in states])
        write(folder / "b.txt", ["CO_CURSO", "TP_PRES", "NT_GER", "NT_FG", "NT_CE"], [("1", rng.choice(["555", " 555", "555", "222"]), s, "50", "40,5") for s in score])
        for q in ("QE_I01", "QE_I02", "QE_I04", "QE_I08", "QE_I17", "QE_I18", "QE_I19", "QE_I21", "QE_I23"):
            write(folder / f"q_{q}.txt", ["CO_CURSO", q], [("1", rng.choice(["A", "B", "C", "D", "."])) for _ in range(n)])
        write(folder / "q_QE_I05.txt", ["CO_CURSO", "QE_I05"], [("1", i) for i in income])
    return job.Settings(
        {y: str(root / f"e{y}") for y in config.EDITIONS}, str(root / "out"), save_csv=True,
        seeds=(42, 43), iterations=20, trees=10, depth=6,
    )


@pytest.fixture(scope="module")
def done(spark, settings):
    job.run(spark, settings)
    return settings


def test_layers_and_ids(spark, done):
    raw = spark.read.parquet(done.path("raw"))
    ids = sorted(x.id for x in raw.select("id").collect())
    assert ids == list(range(len(ids)))
    assert raw.filter(~F.col("CO_GRUPO").isin("72", "4004", "4005")).count() == 0
    report = spark.read.parquet(done.path("load_report"))
    assert {x.ano for x in report.collect() if x.alinhado} == set(config.EDITIONS)
    fact = read_fact(spark, done.path("fact"))
    kept = raw.filter((F.trim("TP_PRES") == "555") & F.col("NT_GER").rlike("^[0-9]"))
    assert {x.id for x in fact.select("id").collect()} == {x.id for x in kept.select("id").collect()}
    assert set(fact.columns) == {"id", *config.FACT_COLUMNS.values()}


def test_derived_columns(spark, done):
    fact = read_fact(spark, done.path("fact"))
    spread = fact.groupBy("nu_ano").agg(F.min("nt_ger_norm").alias("lo"), F.max("nt_ger_norm").alias("hi")).collect()
    assert all((x.lo, x.hi) == (0.0, 100.0) for x in spread)
    assert {x.faixa_nota for x in fact.select("faixa_nota").distinct().collect()} == set(config.CLASSES)
    assert fact.filter("nt_ce is not null").count() == 0  # decimal commas are not numbers
    assert fact.filter("uf_sigla = 'SP' and uf_nome <> 'São Paulo'").count() == 0
    assert fact.filter("co_uf = 99 and uf_sigla is not null").count() == 0
    pairs = {(x.qe_renda, x.renda_nome) for x in fact.select("qe_renda", "renda_nome").distinct().collect()}
    assert pairs == set(enumerate(config.INCOME_NAMES.values()))


def test_model_columns_and_metrics(spark, done):
    fact = read_fact(spark, done.path("fact"))
    for c in ("cluster_id", "pca_x", "pca_y", "faixa_prevista"):
        assert fact.filter(F.col(c).isNull()).count() == 0
    metrics = read_metrics(spark, done.path("metrics"))
    bundle = endpoints.ml_metricas(metrics)
    assert bundle["acuracia"].first().acuracia > 0.6
    assert bundle["importancias_nomeadas"].first().nome == "Renda familiar"
    assert bundle["importancias"].count() == len(config.FEATURES)
    held = bundle["matriz_confusao"].agg(F.sum("total")).first()[0]
    sizes = [x.total for x in fact.groupBy("faixa_nota").agg(F.count("*").alias("total")).collect()]
    assert held == sum(int(n * 0.2 + 0.5) for n in sizes)


def test_stages_restart_alone(spark, done):
    before = read_fact(spark, done.path("fact")).count()
    job.run(spark, job.Settings(done.folders, done.base, stages=("load",)))
    assert read_fact(spark, done.path("fact")).count() == before
    assert spark.read.option("header", True).csv(done.path("clean_csv")).count() == before


def test_every_report_of_every_bundle_runs(spark, done):
    fact, raw = read_fact(spark, done.path("fact")), spark.read.parquet(done.path("raw"))
    places = spark.createDataFrame([(3535, "São Paulo")], "co_municipio bigint, nome string")
    chosen = {"ano": "2017", "tipo": "Bacharelado"}
    bundles = {
        "estatisticas": endpoints.estatisticas(fact, chosen),
        "socioeconomico": endpoints.socioeconomico(fact, chosen),
        "clusters": endpoints.clusters(fact, chosen),
        "filtros": endpoints.filtros(fact),
        "estados": endpoints.filtros(fact, regiao="0"),
        "municipios": endpoints.filtros(fact, places, uf="35"),
        "habitos": endpoints.habitos(fact, chosen),
        "raca": endpoints.raca(fact, chosen),
        "visao_geral": endpoints.visao_geral(fact, raw, "NU_ANO"),
        "analise": endpoints.analise(fact),
        "bivariado": endpoints.bivariado(fact),
        "previsao": endpoints.previsao(fact),
        "genero": endpoints.genero(fact, "qe_estado_civil", ("A", "B")),
    }
    empty = [f"{b}.{n}" for b, reports in bundles.items() for n, df in reports.items() if not df.collect()]
    assert empty == []
    regions = {x.regiao for x in r.by_state(fact).collect()}
    assert regions == {"Sudeste", "Centro-Oeste"}
    rows = raw.groupBy(F.col("NU_ANO").cast("int").alias("ano")).count().collect()
    assert {x.ano: x.total for x in r.coverage(fact, raw, "NU_ANO").collect()} == {x.ano: x["count"] for x in rows}


def test_bundles_equal_separate_reports(spark, done):
    fact, chosen = read_fact(spark, done.path("fact")), {"ano": "2017"}
    single = {
        "renda": r.income, "escola": r.school, "trabalha": r.works, "estudo": r.study_hours, "tipo_ies": r.institution_type,
        "evolucao_renda": r.income_over_time, "financiamento": r.funding, "estado_civil": r.marital_status,
        "nt_por_tipo": r.scores_by_teaching_type, "comparativo_habitos": r.study_against_work, "desigualdade": r.inequality_cards,
        "total_estudantes": r.total_students, "media_notas": r.score_overview, "distribuicao_faixa": r.by_band, "distribuicao_ano": r.by_year,
        "distribuicao_curso": r.by_course, "distribuicao_regiao": r.by_region, "distribuicao_tipo_ies": r.by_institution_type,
    }
    bundles = endpoints.socioeconomico(fact, chosen) | endpoints.estatisticas(fact, chosen)
    assert set(bundles) == set(single)
    for name, build in single.items():
        alone = build(fact, chosen)
        assert bundles[name].columns == alone.columns, name
        a, b = bundles[name].collect(), alone.collect()
        assert len(a) == len(b) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for p, q in zip(a, b) for x, y in zip(p, q)), name


@pytest.mark.parametrize("chosen", [None, {"ano": "2017"}, {"regiao": "3", "curso": "72"}, {"tipo": "Bacharelado", "uf": "35", "municipio": "3535", "ano": "2021"}, {"uf": "11"}])
def test_the_stored_cube_answers_as_the_rows_do(spark, done, chosen):
    from microatlas.plans import cube

    fact, stored = read_fact(spark, done.path("fact")), cube.read(spark, done.path("cube"))
    from_rows = endpoints.socioeconomico(fact, chosen) | endpoints.estatisticas(fact, chosen)
    from_cube = endpoints.socioeconomico(None, chosen, stored) | endpoints.estatisticas(None, chosen, stored)
    assert set(from_rows) == set(from_cube)
    for name, rows in from_rows.items():
        plan = from_cube[name]._jdf.queryExecution().executedPlan().toString()
        assert "/fact" not in plan and "corte" in plan.split("PartitionFilters: [")[1].split("]")[0], name
        assert from_cube[name].dtypes == rows.dtypes, name
        a, b = from_cube[name].collect(), rows.collect()
        assert len(a) == len(b) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for p, q in zip(a, b) for x, y in zip(p, q)), name


def test_a_bundle_reads_the_rows_once(spark, done):
    from microatlas.plans import reports

    fact = read_fact(spark, done.path("fact"))
    for rows in (reports.statistics_cube(fact), reports.socioeconomic_in_one_scan(fact)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for bundle in (endpoints.estatisticas(fact), endpoints.socioeconomico(fact)):
        for rows in bundle.values():
            assert "/fact" not in rows._jdf.queryExecution().executedPlan().toString()


def test_scratch_ends_with_the_stage_and_the_profile_is_written(spark, done):
    from microatlas.runtime import owned_scratch, settle

    with owned_scratch(spark):
        inside = settle(spark.range(3)).inputFiles()
    assert inside and not any(__import__("os").path.exists(f.removeprefix("file://")) for f in inside)
    clean = spark.read.parquet(done.path("clean"))
    by_year = {x[0]: x.total for x in spark.read.parquet(done.path("profile/rows_by_year")).collect()}
    assert sum(by_year.values()) == clean.count() and len(by_year) == len(config.EDITIONS)
    nulls = {x.coluna: x.nulos for x in spark.read.parquet(done.path("profile/nulls_by_column")).collect()}
    assert nulls["NT_CE"] == clean.count()


def test_state_filters_prune_files(spark, tmp_path):
    from microatlas.sources.tables import write_fact

    rows = spark.range(20_000).select(
        "id", (F.col("id") % 2 + 2014).cast("int").alias("nu_ano"), (F.col("id") * 7 % 27).alias("co_uf"), (F.col("id") % 8).alias("co_grupo")
    )
    write_fact(rows, str(tmp_path / "fact"), partitions=12)
    fact = read_fact(spark, str(tmp_path / "fact"))
    assert fact.count() == 20_000
    files = fact.filter("nu_ano = 2014").select(F.input_file_name().alias("f"), "co_uf").groupBy("f").agg(F.min("co_uf").alias("a"), F.max("co_uf").alias("b")).collect()
    assert 4 <= len(files) <= 8
    assert sum(x.a <= 13 <= x.b for x in files) <= 2  # the statistics of all other files exclude the state


def test_year_filter_prunes_folders(spark, done):
    plan = read_fact(spark, done.path("fact")).filter("nu_ano = 2017").select("nt_ger")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(nu_ano" in text
    assert "ReadSchema: struct<nt_ger:double>" in text
