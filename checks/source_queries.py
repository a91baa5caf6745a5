"""Sources and sinks, on text fragments and tables that Spark writes from the orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import star
from checks.registry import add
from checks.report_queries import CLASS_REPORT
from microatlas import config
from microatlas.operators import evaluate
from microatlas.runtime import scratch_path, settle
from microatlas.sources import fragments as fr
from microatlas.sources import ordered, tables, versions

YEARS = (2014, 2017, 2021)
_EDITION = "case when year(o_orderdate) <= 1996 then 2014 when year(o_orderdate) <= 1999 then 2017 else 2021 end"
_GROUP = "case o_custkey % 5 when 0 then '72' when 1 then '79' when 2 then '4004' when 3 then '4005' else '9999' end"
# fragment -> (number of part files, column -> expression)
_FRAGMENTS = {
    "arq01": (5, {
        "NU_ANO": "'1900'", "CO_CURSO": "cast(o_custkey as string)", "CO_GRUPO": _GROUP,
        "NO_IES": "concat('Instituição ', cast(o_orderkey as string))",
    }),
    "arq02": (3, {"NU_ANO": "'1900'", "CO_CURSO": "'x'", "NT_GER": "cast(o_totalprice as string)", "TP_PRES": "'555'"}),
    "arq03": (7, {"CO_CURSO": "'x'", "QE_I01": "o_orderstatus", "QE_I02": "substr(o_orderpriority, 1, 1)"}),
    "arq04": (2, {"CO_CURSO": "'x'", "QE_I01": "'later'", "CO_UF_CURSO": "cast(o_custkey % 27 as string)"}),
    "arq05": (1, {"CO_CURSO": "'x'", "OUTRA": "'nada'"}),
}
_written: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession, sf: str) -> str:
    """Fragments in order-key order: every fragment has its own part files."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        base = scratch_path(spark, "fragments")
        orders = star.table(spark, sf, "orders").withColumn("edition", F.expr(_EDITION))
        for name, (parts, columns) in _FRAGMENTS.items():
            (
                orders.repartitionByRange(parts, "edition", "o_orderkey")
                .sortWithinPartitions("edition", "o_orderkey")
                .select("edition", *[F.expr(e).alias(c) for c, e in columns.items()])
                .write.partitionBy("edition")
                .option("sep", ";").option("encoding", "ISO-8859-1").option("header", True)
                .option("extension", "txt").csv(f"{base}/{name}")
            )
        _written[key] = base
    return _written[key]


def prepare(spark: SparkSession, sf: str) -> None:
    """Write the text fragments, if they are not there yet."""
    _folder(spark, sf)


def _folders(spark: SparkSession, sf: str) -> dict[int, str]:
    base = _folder(spark, sf)
    return {y: f"{base}/*/edition={y}" for y in YEARS}


def _fragment_name(fragment: fr.Fragment) -> str:
    return fragment.name.rsplit("/", 2)[1]


_NUMBERED = f"""o as (select *, {_EDITION} as edition, row_number() over (partition by {_EDITION} order by o_orderkey) - 1 as pos,
    {_GROUP} as grupo from orders)"""

add(
    "src1_text_scan",
    lambda s, d: fr.read_text(s, fr.discover(s, f"{_folder(s, d)}/arq01")).select("NU_ANO", "CO_CURSO", "CO_GRUPO", "NO_IES"),
    f"select '1900' as NU_ANO, cast(o_custkey as varchar) as CO_CURSO, {_GROUP} as CO_GRUPO, 'Instituição ' || o_orderkey as NO_IES from orders",
)


def _discovered(spark, sf) -> DataFrame:
    rows = [
        (year, _fragment_name(f), len(f.columns))
        for year, folder in _folders(spark, sf).items()
        for f in fr.fragments_of(spark, fr.discover(spark, folder))
    ]
    return spark.createDataFrame(rows, "ano int, fragmento string, colunas int")


add(
    "src2_discovery", _discovered,
    f"""select distinct {_EDITION} as ano, f.fragmento, f.colunas from orders, (values ('arq01', 4), ('arq02', 4), ('arq03', 3), ('arq04', 3), ('arq05', 2)) f(fragmento, colunas)""",
)


def _chosen(spark, sf) -> DataFrame:
    rows = []
    for year, folder in _folders(spark, sf).items():
        found = fr.fragments_of(spark, fr.discover(spark, folder))
        names = {f.name: _fragment_name(f) for f in found}
        choice = fr.choose_columns(year, found)
        rows += [(year, c, names[n]) for n, taken in choice.taken.items() for c in taken]
    return spark.createDataFrame(rows, "ano int, coluna string, fragmento string")


add(
    "src3_column_choice", _chosen,
    f"""select distinct {_EDITION} as ano, f.coluna, f.fragmento from orders, (values ('NU_ANO', 'arq01'), ('CO_CURSO', 'arq01'), ('CO_GRUPO', 'arq01'),
    ('NO_IES', 'arq01'), ('NT_GER', 'arq02'), ('TP_PRES', 'arq02'), ('QE_I01', 'arq03'), ('QE_I02', 'arq03'), ('CO_UF_CURSO', 'arq04')) f(coluna, fragmento)""",
)


def _assembled(spark, sf, codes=None, with_id=False) -> DataFrame:
    return fr.load_editions(spark, _folders(spark, sf), codes, with_id=with_id)[0]


add(
    "src4_positional_assembly",
    lambda s, d: _assembled(s, d).select("pos", "NU_ANO", "NO_IES", "NT_GER", "QE_I01", "QE_I02", "CO_UF_CURSO"),
    f"""with {_NUMBERED} select pos, cast(edition as varchar) as NU_ANO, 'Instituição ' || o_orderkey as NO_IES, cast(o_totalprice as varchar) as NT_GER,
    o_orderstatus as QE_I01, substr(o_orderpriority, 1, 1) as QE_I02, cast(o_custkey % 27 as varchar) as CO_UF_CURSO from o""",
)
add(
    "src4_assembly_of_kept_courses",
    lambda s, d: _assembled(s, d, tuple(config.COURSE_NAMES)).select("pos", "NU_ANO", "CO_GRUPO", "NT_GER", "QE_I02", "CO_UF_CURSO"),
    f"""with {_NUMBERED} select pos, cast(edition as varchar) as NU_ANO, grupo as CO_GRUPO, cast(o_totalprice as varchar) as NT_GER,
    substr(o_orderpriority, 1, 1) as QE_I02, cast(o_custkey % 27 as varchar) as CO_UF_CURSO from o where grupo <> '9999'""",
)


def _parquet_positions(spark, sf) -> DataFrame:
    """Tables of different lengths and file counts, row i with row i."""
    from microatlas.sources.positions import aligned

    path = f"{sf}/orders.parquet"
    many = scratch_path(spark, "customers")
    # The customers again as several files, still in key order.
    star.table(spark, sf, "customer").repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(many)
    return aligned(spark, [(path, ["o_orderkey", "o_custkey"]), (path, ["o_orderstatus"]), (many, ["c_custkey"])])


add(
    "jn2_positional_outer_join", _parquet_positions,
    """select a.o_orderkey, a.o_custkey, a.o_orderstatus, c.c_custkey from (select row_number() over () as i, o_orderkey, o_custkey, o_orderstatus from orders) a
    full join (select row_number() over (order by c_custkey) as i, c_custkey from customer) c on a.i = c.i""",
)
def _counted_and_assembled(spark, sf) -> DataFrame:
    """Rows of the longest fragment of an edition, as counted, next to the assembled ones."""
    rows, report = fr.load_editions(spark, _folders(spark, sf), None)
    counted = report.select("ano", F.col("maior_fragmento").alias("contadas"))
    found = rows.groupBy(F.col("NU_ANO").cast("int").alias("ano")).agg(
        F.count(F.lit(1)).alias("montadas"), F.count_distinct("pos").alias("posicoes"), F.max("pos").alias("ultima")
    )
    return counted.join(found, "ano")


add(
    "src4_counted_and_assembled", _counted_and_assembled,
    f"select {_EDITION} as ano, count(*) as contadas, count(*) as montadas, count(*) as posicoes, count(*) - 1 as ultima from orders group by 1",
)
add(
    "src5_identification_override",
    lambda s, d: _assembled(s, d).groupBy("NU_ANO", "CO_CURSO", "CO_GRUPO").agg(F.count(F.lit(1)).alias("total")),
    f"select cast({_EDITION} as varchar) as NU_ANO, cast(o_custkey as varchar) as CO_CURSO, {_GROUP} as CO_GRUPO, count(*) as total from orders group by 1, 2, 3",
)
add(
    "src6_edition_stamp",
    lambda s, d: _assembled(s, d).groupBy("NU_ANO").agg(F.count(F.lit(1)).alias("total")),
    f"select cast({_EDITION} as varchar) as NU_ANO, count(*) as total from orders group by 1",
)
add(
    "src7_optional_columns",
    lambda s, d: _assembled(s, d).groupBy("QI_1", "QI_7", "CO_MODALIDADE").agg(F.count(F.lit(1)).alias("total"), F.count("NO_IES").alias("com_nome")),
    "select cast(null as varchar) as QI_1, cast(null as varchar) as QI_7, cast(null as varchar) as CO_MODALIDADE, count(*) as total, count(*) as com_nome from orders",
)
add(
    "src8_load_report",
    lambda s, d: fr.load_editions(s, {**_folders(s, d), 2011: f"{_folder(s, d)}/ausente"}, None, on_error="skip")[1],
    f"""select {_EDITION} as ano, 'ok' as situacao, 5 as fragmentos, 4 as fragmentos_lidos, 0 as fragmentos_com_erro, count(*) as menor_fragmento, count(*) as maior_fragmento, 0 as linhas_malformadas, true as alinhado from orders group by 1
    union all select 2011, 'AnalysisException', 0, 0, 0, null, null, null, null""",
)

# --- fragments with faults: lines of other lengths than the header, and a file of another header ---------------
_LINE = """concat('x;', o_orderstatus, ';', substr(o_orderpriority, 1, 1), case when o_orderkey % 100 = 7 then ';mais' else '' end)"""
_SHORT = "case when o_orderkey % 100 = 38 then 'x' else {} end"
_faulty: dict[tuple[str, str], str] = {}


def _faulty_folder(spark: SparkSession, sf: str) -> str:
    """Identification in good order; ``arq02`` with long and short lines, one file an edition;
    ``arq03`` with a second file of another header; ``arq04`` with the column ``arq03`` offers."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _faulty:
        return _faulty[key]
    base = scratch_path(spark, "faulty-fragments")
    orders = star.table(spark, sf, "orders").withColumn("edition", F.expr(_EDITION))
    ordered = orders.repartitionByRange(3, "edition", "o_orderkey").sortWithinPartitions("edition", "o_orderkey")

    def write(name: str, rows: DataFrame, columns: dict[str, str]) -> None:
        (
            rows.select("edition", *[F.expr(e).alias(c) for c, e in columns.items()]).write.mode("append").partitionBy("edition")
            .option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).option("extension", "txt").csv(f"{base}/{name}")
        )

    write("arq01", ordered, _FRAGMENTS["arq01"][1])
    heads = orders.select("edition").distinct().select("edition", F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("CO_CURSO;QE_I01;QE_I02").alias("value"))
    lines = orders.select("edition", "o_orderkey", F.expr(_SHORT.format(_LINE)).alias("value")).unionByName(heads)
    in_files = lines.repartitionByRange(3, "edition").sortWithinPartitions("edition", "o_orderkey")
    in_files.select("edition", "value").write.partitionBy("edition").text(f"{base}/arq02")
    write("arq03", ordered, {"CO_CURSO": "'x'", "QE_I04": "'nunca'"})
    write("arq03", ordered, {"QE_I04": "'nunca'", "CO_CURSO": "'x'"})
    write("arq04", ordered, {"CO_CURSO": "'x'", "QE_I04": "substr(o_orderpriority, 1, 1)"})
    _faulty[key] = base
    return base


def _with_faults(spark, sf) -> fr.Load:
    base = _faulty_folder(spark, sf)
    return fr.load(spark, {y: f"{base}/*/edition={y}" for y in YEARS}, None, on_error="skip")


def _short_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fragmento", F.regexp_extract("fragmento", "/(arq[0-9]+)/", 1))


add(
    "src1_malformed_lines_by_fragment", lambda s, d: _short_names(_with_faults(s, d).fragments),
    f"""select {_EDITION} as ano, f.fragmento, case when f.fragmento = 'arq03' then 'erro' else 'ok' end as situacao,
    case when f.fragmento <> 'arq03' then count(*) end as linhas,
    case f.fragmento when 'arq02' then count(*) filter (where o_orderkey % 100 in (7, 38)) when 'arq03' then null else 0 end as linhas_malformadas
    from orders, (values ('arq01'), ('arq02'), ('arq03'), ('arq04')) f(fragmento) group by 1, 2""",
)
add(
    "src1_rejects", lambda s, d: _short_names(_with_faults(s, d).rejects),
    f"""with {_NUMBERED} select edition as ano, 'arq02' as fragmento, pos,
    case when o_orderkey % 100 = 38 then 'x' else 'x;' || o_orderstatus || ';' || substr(o_orderpriority, 1, 1) || ';mais' end as linha from o where o_orderkey % 100 in (7, 38)""",
)
add(
    "src8_load_with_faults", lambda s, d: _with_faults(s, d).rows.select("pos", "NU_ANO", "CO_CURSO", "QE_I01", "QE_I02", "QE_I04"),
    f"""with {_NUMBERED} select pos, cast(edition as varchar) as NU_ANO, cast(o_custkey as varchar) as CO_CURSO, case when o_orderkey % 100 <> 38 then o_orderstatus end as QE_I01,
    case when o_orderkey % 100 <> 38 then substr(o_orderpriority, 1, 1) end as QE_I02, substr(o_orderpriority, 1, 1) as QE_I04 from o""",
)
add(
    "src8_report_of_faults", lambda s, d: _with_faults(s, d).report,
    f"""select {_EDITION} as ano, 'ok' as situacao, 3 as fragmentos, 3 as fragmentos_lidos, 1 as fragmentos_com_erro, count(*) as menor_fragmento, count(*) as maior_fragmento,
    count(*) filter (where o_orderkey % 100 in (7, 38)) as linhas_malformadas, true as alinhado from orders group by 1""",
)

# --- tables -----------------------------------------------------------------------------------------------
_FACT = "l_orderkey l_linenumber l_partkey l_suppkey nu_ano co_uf co_grupo nt_ger tipo_ies".split()


def _stored_fact(spark, sf) -> DataFrame:
    path = scratch_path(spark, "fact")
    tables.write_fact(star.fact(spark, sf, *_FACT), path)
    return tables.read_fact(spark, path)


_STORED = f"with {star.fact_sql()} select {', '.join(_FACT)} from fact"
add("src9_snk1_fact_round_trip", _stored_fact, _STORED)
add(
    "src9_fact_scan_pruned", lambda s, d: _stored_fact(s, d).filter("nu_ano = 1998 and co_uf = 3").groupBy("co_grupo").agg(F.count(F.lit(1)).alias("total")),
    f"with {star.fact_sql()} select co_grupo, count(*) as total from fact where nu_ano = 1998 and co_uf = 3 group by 1",
)


def _replaced(spark, sf) -> DataFrame:
    """Rows by edition of the served table: first written, after a write that fails in its
    last rows, after a whole one; and of the first version, which readers may still hold."""
    path = scratch_path(spark, "replaced")
    rows = star.fact(spark, sf, *_FACT)
    tables.write_fact(rows.filter("nu_ano < 1996"), path)
    last = F.when(F.col("nu_ano") < 1998, F.col("co_uf")).otherwise(F.raise_error(F.lit("half way")).cast("int"))
    seen = [("escrita", settle(tables.read_fact(spark, path), "served"))]
    try:
        tables.write_fact(rows.withColumn("co_uf", last), path)
    except Exception as error:
        if "half way" not in str(error):
            raise
    seen.append(("falha", settle(tables.read_fact(spark, path), "served")))
    tables.write_fact(rows.filter("nu_ano >= 1996"), path)
    seen += [("nova", tables.read_fact(spark, path)), ("primeira", versions.read(spark, path, 1))]
    counted = [r.groupBy("nu_ano").agg(F.count(F.lit(1)).alias("total"), F.sum("l_partkey").alias("soma")).select(F.lit(n).alias("leitura"), "*") for n, r in seen]
    return reduce(DataFrame.unionByName, counted)


add(
    "snk1_replace_is_whole_or_not_at_all", _replaced,
    f"""with {star.fact_sql()} select leitura, nu_ano, count(*) as total, cast(sum(l_partkey) as bigint) as soma
    from fact, (values ('escrita', false), ('falha', false), ('nova', true), ('primeira', false)) v(leitura, later) where (nu_ano >= 1996) = later group by 1, 2""",
)


def _stored_metrics(spark, sf) -> DataFrame:
    f = star.fact(spark, sf, "faixa_nota", "faixa_prevista", "nt_fg", "nt_ce", "nt_ger")
    importances = f.agg(*[F.abs(F.corr(c, "nt_ger")).alias(c) for c in ("nt_fg", "nt_ce")]).unpivot([], ["nt_fg", "nt_ce"], "feature", "valor")
    path = scratch_path(spark, "metrics")
    tables.write_metrics(evaluate.metrics_table(importances, evaluate.confusion_counts(f, "faixa_nota", "faixa_prevista")), path)
    return tables.read_metrics(spark, path)


def _unfolded(metrics: DataFrame) -> DataFrame:
    """All stored columns, the detail parsed into its figures."""
    detail = F.from_json("detalhe", evaluate.DETAIL)
    matrix = F.from_json("detalhe", evaluate.MATRIX_DETAIL)
    own = F.col("metrica") == "metricas_classe"
    figures = {n: F.round(F.when(own, detail[n]), 6) for n in ("precision", "recall", "f1-score")}
    return metrics.select(
        "id", "metrica", "chave", F.round("valor", 6).alias("valor"), *[e.alias(n.replace("f1-score", "f1")) for n, e in figures.items()],
        F.when(own, detail["support"]).alias("support"),
        F.when(F.col("metrica") == "matriz_confusao", F.concat_ws(";", F.transform(matrix["matrix"], lambda x: F.concat_ws(",", x)))).alias("matriz"),
    )


UNFOLDED_SQL = """, parts as (
    select 0 as o, -v as w, 'importancia_feature' as metrica, k as chave, v as valor, null::double as p, null::double as rc, null::double as f, null::bigint as s, null::varchar as matriz
    from (select 'nt_fg' as k, abs(corr(nt_fg, nt_ger)) as v from fact{second})
    union all select 1, 0, 'acuracia_geral', 'random_forest', sum(total) filter (where real = previsto) / sum(total), null, null, null, null, null from cells
    union all select 2, case classe when 'baixo' then 1 when 'medio' then 2 else 3 end, 'metricas_classe', classe, f1, precision, recall, f1, support, null from per_class
    union all select 2, 4, 'metricas_classe', 'macro avg', avg(f1), avg(precision), avg(recall), avg(f1), sum(support), null from per_class
    union all select 2, 5, 'metricas_classe', 'weighted avg', sum(f1 * support) / sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support), null from per_class
    union all select 3, 0, 'matriz_confusao', 'teste', sum(total), null, null, null, null, (select string_agg(line, ';' order by i) from (
        select case real when 'baixo' then 1 when 'medio' then 2 else 3 end as i, string_agg(total, ',' order by case previsto when 'baixo' then 1 when 'medio' then 2 else 3 end) as line from cells group by 1)) from cells)
    select row_number() over (order by o, w) - 1 as id, metrica, chave, round(valor, 6) as valor, round(p, 6) as precision, round(rc, 6) as recall, round(f, 6) as f1, cast(s as bigint) as support, matriz from parts"""
_SECOND = " union all select 'nt_ce', abs(corr(nt_ce, nt_ger)) from fact"

add(
    "src10_snk2_metrics_round_trip", lambda s, d: _unfolded(_stored_metrics(s, d)),
    f"with {star.fact_sql()}, {CLASS_REPORT}{UNFOLDED_SQL.format(second=_SECOND)}",
)


def _csv(spark, sf) -> DataFrame:
    path = scratch_path(spark, "csv")
    rows = star.fact(spark, sf, *_FACT)
    tables.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


add("snk3_csv_round_trip", _csv, _STORED)
add(
    "snk5_dense_id_of_lines",
    lambda s, d: tables.with_dense_id(
        s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_linenumber") % 3).alias("nu_ano"), F.col("_metadata.row_index").alias("pos"))
    ),
    """with r as (select l_linenumber % 3 as nu_ano, row_number() over () - 1 as pos from lineitem)
    select nu_ano, pos, row_number() over (order by nu_ano, pos) - 1 as id from r""",
)
add(
    "snk5_dense_id",
    lambda s, d: _assembled(s, d, tuple(config.COURSE_NAMES), True).select("pos", "NU_ANO", "NO_IES", "id"),
    f"""with {_NUMBERED}, k as (select * from o where grupo <> '9999') select pos, cast(edition as varchar) as NU_ANO, 'Instituição ' || o_orderkey as NO_IES,
    row_number() over (order by edition, pos) - 1 as id from k""",
)


def _pages(spark, sf) -> DataFrame:
    """The first page and a later one of the customers in the order of their names."""
    path = scratch_path(spark, "ordered")
    rows = star.table(spark, sf, "customer").select(F.col("c_name").alias("nome"), "c_custkey", "c_mktsegment")
    ordered.write_ordered(rows, path, [F.collate("nome", "UNICODE"), "c_custkey"], rows_per_file=400)
    return ordered.read_page(spark, path, 0, 50).unionByName(ordered.read_page(spark, path, 380, 50))


add(
    "srt5_pages_in_serving_order", _pages,
    """select nome, c_custkey, c_mktsegment, posicao from (select c_name as nome, c_custkey, c_mktsegment, row_number() over (order by c_name, c_custkey) - 1 as posicao from customer)
    where posicao < 50 or posicao between 380 and 429""",
)
