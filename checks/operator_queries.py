"""Operators on the fact-shaped view and on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import star
from checks.registry import add, in_place, on_fact
from microatlas import config
from microatlas.functions import columns as fc
from microatlas.operators import aggregates as agg
from microatlas.operators import cleaning, filters, labels, reshape, scores, trend
from microatlas.operators.reshape import stack_rows
from microatlas.plans import reports
from microatlas.sources.positions import sorted_rank

PUB = star.PATTERN
REAL, PROJ = star.REAL_YEARS, star.PROJECTED_YEARS
KEYS = "l_orderkey l_linenumber l_partkey l_suppkey"

# --- cleaning: dirty text made from the line items -------------------------------------------
_RAW = (
    "case l_linenumber when 1 then '.' when 2 then ' ' when 3 then 'NA' when 4 then replace(cast(l_quantity as {t}), '.', ',')"
    " when 5 then concat(' ', cast(l_quantity as {t}), ' ') when 6 then case when l_tax < 0.02 then 'abc' when l_tax < 0.04 then '12.5d'"
    " when l_tax < 0.06 then 'NaN' else '-1.5e2' end else cast(l_tax as {t}) end"
)
_PRESENCE = "case l_returnflag when 'A' then '555' when 'N' then ' 555 ' else '222' end"
_CODE = "case when l_linenumber = 1 then '' when l_linenumber = 2 then '72.0' when l_linenumber = 3 then '7.5' else cast(l_suppkey as {t}) end"


def _dirty(spark, sf) -> DataFrame:
    rows = star.table(spark, sf, "lineitem")
    return rows.select(
        *KEYS.split(),
        F.expr(_RAW.format(t="string")).alias("NT_GER"),
        F.expr(_PRESENCE).alias("TP_PRES"),
        F.expr(_CODE.format(t="string")).alias("CO_GRUPO"),
    )


_DIRTY = f"""with dirty as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_RAW.format(t='varchar')} as NT_GER, {_PRESENCE} as TP_PRES,
    {_CODE.format(t='varchar')} as CO_GRUPO from lineitem), clean as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    case when NT_GER in ('.', '', ' ', 'NA', 'NaN') then null else NT_GER end as NT_GER, TP_PRES, case when CO_GRUPO = '' then null else CO_GRUPO end as CO_GRUPO from dirty),
    typed as (select * exclude (NT_GER, CO_GRUPO), case when NT_GER like '%d' then null else try_cast(trim(NT_GER) as double) end as NT_GER,
    case when try_cast(CO_GRUPO as double) = floor(try_cast(CO_GRUPO as double)) then cast(try_cast(CO_GRUPO as double) as bigint) end as CO_GRUPO from clean) """
add("cln1_blank_to_null", lambda s, d: cleaning.blank_to_null(_dirty(s, d)), _DIRTY + "select * from clean")
add(
    "cln2_to_numbers", lambda s, d: cleaning.to_numbers(cleaning.blank_to_null(_dirty(s, d))),
    _DIRTY + "select * from typed",
)
add(
    "cln3_presence_mark",
    lambda s, d: _dirty(s, d).filter(fc.is_token("TP_PRES", config.PRESENT)).groupBy("TP_PRES").agg(F.count(F.lit(1)).alias("total")),
    _DIRTY + "select TP_PRES, count(*) as total from dirty where trim(TP_PRES) = '555' group by 1",
)
add(
    "cln4_rename_existing",
    lambda s, d: cleaning.rename_existing(cleaning.clean(_dirty(s, d)), config.FACT_COLUMNS),
    _DIRTY + "select CO_GRUPO as co_grupo, NT_GER as nt_ger from typed where NT_GER is not null and trim(TP_PRES) = '555'",
)
add(
    "cln5_drop_control", lambda s, d: cleaning.drop_control(cleaning.clean(_dirty(s, d))),
    _DIRTY + "select * exclude (TP_PRES) from typed where NT_GER is not null and trim(TP_PRES) = '555'",
)
add(
    "flt4_present_with_score", lambda s, d: cleaning.clean(_dirty(s, d)),
    _DIRTY + "select * from typed where NT_GER is not null and trim(TP_PRES) = '555'",
)

# --- labels -------------------------------------------------------------------------------------
on_fact(
    "lbl1_code_to_label", f"{KEYS} co_grupo qe_escola_em",
    lambda f: f.select(
        *KEYS.split(),
        fc.label("co_grupo", config.COURSE_NAMES).alias("curso"),
        fc.label("co_grupo", config.COURSE_TEACHING_TYPE).alias("tipo"),
        fc.label(F.col("co_grupo") % 54, config.STATE_INITIALS).alias("uf"),
        fc.label(F.col("qe_escola_em"), config.REGION_NAMES).alias("regiao"),
    ),
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case co_grupo when 72 then 'Tecnologia em Análise e Desenvolvimento de Sistemas' when 79 then 'Tecnologia em Redes de Computadores'
    when 4003 then 'Engenharia da Computação' when 4004 then 'Ciência da Computação (Bacharelado)' when 4005 then 'Ciência da Computação (Licenciatura)' when 4006 then 'Sistemas de Informação' end as curso,
    case when co_grupo in (72, 79) then 'Tecnologia' when co_grupo = 4005 then 'Licenciatura' else 'Bacharelado' end as tipo,
    case co_grupo % 54 when 18 then null when 25 then 'PB' when 7 then null when 8 then null when 9 then null when 10 then null end as uf,
    case qe_escola_em when 1 then 'Norte' when 2 then 'Nordeste' when 3 then 'Centro-Oeste' when 4 then 'Sudeste' end as regiao from fact""",
)
add(
    "lbl1_dimension_join",
    lambda s, d: labels.lookup(
        star.table(s, d, "documents").select("doc_id", "lang"), star.table(s, d, "labels"), "doc_id", "doc_id", "quality", "quality"
    ),
    "select d.doc_id, d.lang, l.quality from documents d left join labels l on l.doc_id = d.doc_id",
)
add(
    "lbl2_label_or_code",
    lambda s, d: labels.lookup(
        star.table(s, d, "documents").select("doc_id"), star.table(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("q")),
        "doc_id", "doc_id", "nome", "q", F.col("doc_id").cast("string"),
    ),
    "select d.doc_id, coalesce(cast(l.quality as varchar), cast(d.doc_id as varchar)) as nome from documents d left join labels l on l.doc_id = d.doc_id",
)
add(
    "lbl3_keep_known",
    lambda s, d: labels.keep_known(star.table(s, d, "documents").select("doc_id", "source"), star.table(s, d, "labels"), ["doc_id"]),
    "select d.doc_id, source, quality, toxic from documents d join labels l on l.doc_id = d.doc_id",
)
on_fact(
    "lbl4_network", "tipo_ies",
    lambda f: agg.value_counts(f.select("tipo_ies", fc.network("tipo_ies", PUB).alias("rede")), "tipo_ies", "rede"),
    f"select tipo_ies, case when tipo_ies like '{PUB}' then 'Pública' else 'Privada' end as rede, count(*) as total from fact group by 1, 2",
)
on_fact(
    "lbl5_one_or_rest", "modalidade",
    lambda f: agg.value_counts(f.select(fc.one_of_or_rest("modalidade", "F", "Presencial", "EAD/ND").alias("lado")), "lado"),
    "select case when modalidade = 'F' then 'Presencial' else 'EAD/ND' end as lado, count(*) as total from fact group by 1",
)
add(
    "lbl6_region_of_state",
    lambda s, d: labels.lookup(
        star.fact(s, d, "uf_sigla").distinct(),
        star.table(s, d, "nation").filter("n_regionkey <> 2").select(F.regexp_replace("n_name", "NATION_", "U").alias("uf"), F.col("n_name").alias("regiao")),
        "uf_sigla", "uf", "regiao", "regiao", config.UNKNOWN_REGION,
    ),
    f"""with {star.fact_sql()} select distinct uf_sigla, coalesce(n_name, 'Desconhecido') as regiao from fact
    left join (select * from nation where n_regionkey <> 2) on replace(n_name, 'NATION_', 'U') = uf_sigla""",
)

# --- encoding, normalisation, bands ------------------------------------------------------------------
on_fact(
    "enc1_encode_categories", f"{KEYS} tipo_ies co_grupo qe_financiamento",
    lambda f: scores.encode_categories(f, ["tipo_ies", "co_grupo", "qe_financiamento"]),
    """t as (select tipo_ies as v, cast(dense_rank() over (order by tipo_ies) - 1 as int) as c from (select distinct tipo_ies from fact where tipo_ies is not null)),
    g as (select v, cast(dense_rank() over (order by v) - 1 as int) as c from (select distinct cast(co_grupo as varchar) as v from fact)),
    q as (select v, cast(dense_rank() over (order by v) - 1 as int) as c from (select distinct cast(qe_financiamento as varchar) as v from fact where qe_financiamento is not null))
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, tipo_ies, co_grupo, qe_financiamento, t.c as tipo_ies_code, g.c as co_grupo_code, q.c as qe_financiamento_code
    from fact left join t on t.v = tipo_ies left join g on g.v = cast(co_grupo as varchar) left join q on q.v = cast(qe_financiamento as varchar)""",
)
on_fact(
    "enc1_category_codes", "curso_nome", lambda f: scores.category_codes(f, "curso_nome").drop("coluna"),
    "select curso_nome as categoria, cast(dense_rank() over (order by curso_nome) - 1 as int) as codigo from (select distinct curso_nome from fact)",
)
add(
    "enc1_codes_of_many_values",
    lambda s, d: scores.category_codes(star.table(s, d, "documents"), "text", "source").groupBy("coluna").agg(
        F.count(F.lit(1)).alias("n"), F.min("codigo").alias("menor"), F.max("codigo").alias("maior"), F.count_distinct("codigo").alias("distintos")
    ),
    """select 'text' as coluna, count(distinct text) as n, 0 as menor, cast(count(distinct text) - 1 as int) as maior, count(distinct text) as distintos from documents
    union all select 'source', count(distinct source), 0, cast(count(distinct source) - 1 as int), count(distinct source) from documents""",
)
add(
    "enc1_sorted_rank",
    lambda s, d: sorted_rank(star.table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "lugar"),
    "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as lugar from orders",
)
on_fact(
    "nrm1_normalise_within", f"{KEYS} nu_ano nt_ger",
    lambda f: scores.normalise_within(f, "nt_ger", "nu_ano", "nt_ger_norm", 6),
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, nu_ano, nt_ger, round((nt_ger - min(nt_ger) over (partition by nu_ano))
    / (max(nt_ger) over (partition by nu_ano) - min(nt_ger) over (partition by nu_ano)) * 100, 6) as nt_ger_norm from fact""",
)
on_fact(
    "nrm1_constant_group", "l_orderkey l_quantity_only".replace("l_quantity_only", "l_linenumber") + " nt_fg",
    lambda f: agg.value_counts(
        scores.normalise_within(f.withColumn("g", F.col("nt_fg").cast("int")), "nt_fg", "g", "norm"), "g", "norm"
    ),
    "select cast(nt_fg as int) as g, 50.0::double as norm, count(*) as total from fact group by 1",
)
on_fact(
    "jn4_group_stats", f"{KEYS} curso_nome nt_ger",
    lambda f: scores.attach_group_stats(f, ["curso_nome"], menor=F.min("nt_ger"), maior=F.max("nt_ger"), n=F.count("nt_ger")),
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, curso_nome, nt_ger, min(nt_ger) over w as menor, max(nt_ger) over w as maior, count(nt_ger) over w as n
    from fact window w as (partition by curso_nome)""",
)
on_fact(
    "win1_group_range", f"{KEYS} nu_ano nt_ce",
    lambda f: scores.attach_group_stats(f, ["nu_ano"], menor=F.min("nt_ce"), maior=F.max("nt_ce")),
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, nu_ano, nt_ce, min(nt_ce) over (partition by nu_ano) as menor, max(nt_ce) over (partition by nu_ano) as maior from fact""",
)
on_fact(
    "bnd1_quantile_bands", f"{KEYS} nt_ger", lambda f: scores.quantile_bands(f, "nt_ger", "faixa"),
    """q as (select quantile_cont(nt_ger, 0.33) as a, quantile_cont(nt_ger, 0.66) as b from fact)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, nt_ger, case when nt_ger <= a then 'baixo' when nt_ger <= b then 'medio' when nt_ger > b then 'alto' end as faixa from fact, q""",
)
on_fact(
    "bnd2_buckets", "nt_ger", lambda f: agg.value_counts(f.select(fc.bucket("nt_ger").alias("bucket")), "bucket"),
    "select case when nt_ger is not null then least(cast(floor(nt_ger / 10) * 10 as int), 90) end as bucket, count(*) as total from fact group by 1",
)
on_fact(
    "bnd3_bucket_names", "nt_ce",
    lambda f: agg.value_counts(f.select(fc.bucket("nt_ce").alias("bucket")), "bucket").select(fc.bucket_name("bucket").alias("faixa"), "total"),
    "select least(cast(floor(nt_ce / 10) * 10 as int), 90) || '–' || (least(cast(floor(nt_ce / 10) * 10 as int), 90) + 9) as faixa, count(*) as total from fact group by 1",
)

# --- filters ------------------------------------------------------------------------------------------
on_fact(
    "flt2_members", "co_grupo curso_nome nt_ger",
    lambda f: agg.group_mean(filters.members(f, "co_grupo", [72, 4004, 6409]), ["curso_nome"], "nt_ger"),
    "select curso_nome, count(*) as total, round(avg(nt_ger), 2) as media from fact where co_grupo in (72, 4004, 6409) group by 1",
)
on_fact(
    "flt3_require", "nt_ger tipo_ies qe_renda", lambda f: agg.total(filters.require(f, "nt_ger", "tipo_ies", "qe_renda")),
    "select count(*) as total from fact where nt_ger is not null and tipo_ies is not null and qe_renda is not null",
)
on_fact(
    "flt5_exclude", "qe_raca_cor qe_renda", lambda f: agg.value_counts(filters.exclude(f, 0, "qe_raca_cor", "qe_renda"), "qe_raca_cor", "qe_renda"),
    "select qe_raca_cor, qe_renda, count(*) as total from fact where qe_raca_cor <> 0 and qe_renda <> 0 group by 1, 2",
)
on_fact(
    "flt6_both_present", "uf_nome tipo_ies modalidade nt_ger",
    lambda f: filters.both_present(
        reshape.two_sides(f, ["uf_nome"], fc.network("tipo_ies", "%URGENT%"), (("Pública", "a", "n_a"), ("Privada", "b", "n_b")), "nt_ger"), "a", "b"
    ),
    """s as (select uf_nome, round(avg(nt_ger) filter (where tipo_ies like '%URGENT%'), 2) as a, count(*) filter (where tipo_ies like '%URGENT%') as n_a,
    round(avg(nt_ger) filter (where tipo_ies not like '%URGENT%' or tipo_ies is null), 2) as b, count(*) filter (where tipo_ies not like '%URGENT%' or tipo_ies is null) as n_b from fact group by 1)
    select * from s where a > 0 and b > 0""",
)
on_fact(
    "flt7_class_subset", "faixa_nota", lambda f: agg.value_counts(filters.members(f, "faixa_nota", ["alto", "baixo"]), "faixa_nota"),
    "select faixa_nota, count(*) as total from fact where faixa_nota in ('alto', 'baixo') group by 1",
)
_LINE = "p as (select curso_nome, nu_ano, round(avg(nt_ger), 2) as media from fact where nt_ger is not null group by 1, 2), f as (select curso_nome, count(*) as pontos, regr_intercept(media, nu_ano) as b0, regr_slope(media, nu_ano) as b1, regr_r2(media, nu_ano) as r2 from p group by 1)"


def _course_fits(f: DataFrame, min_points: int = 3) -> DataFrame:
    points = agg.group_mean(filters.require(f, "nt_ger"), ["curso_nome", "nu_ano"], "nt_ger")
    return trend.fit_line(points, "nu_ano", "media", ["curso_nome"], min_points)


on_fact(
    "flt8_reliable", "curso_nome nu_ano nt_ger",
    lambda f: _course_fits(f).select(
        "curso_nome", filters.reliable(F.round("_r2", 4), [trend.predict(F.lit(float(y))) for y in PROJ], 0.1).alias("confiavel")
    ),
    f"{_LINE} select curso_nome, round(r2, 4) >= 0.1 and " + " and ".join(f"round(b0 + b1 * {y}, 2) between 20 and 100" for y in PROJ) + " as confiavel from f",
)
on_fact(
    "flt9_minimum_points", "curso_nome nu_ano nt_ger tipo_ensino",
    lambda f: _course_fits(f.filter((F.col("tipo_ensino") != "Tecnologia") | (F.col("nu_ano") < 1997))).select("curso_nome", "pontos"),
    "select curso_nome, count(distinct nu_ano) as pontos from fact where nt_ger is not null and (tipo_ensino <> 'Tecnologia' or nu_ano < 1997) group by 1 having count(distinct nu_ano) >= 3",
)
on_fact(
    "flt10_visible_courses", "co_grupo curso_nome",
    lambda f: filters.visible_courses(reports.course_options(f), "Tecnologia"),
    "select distinct co_grupo, curso_nome as nome from fact where co_grupo in (72, 79, 6409)",
)
on_fact(
    "flt10_visible_states", "co_regiao co_uf uf_sigla uf_nome", lambda f: filters.visible_states(reports.state_options(f), "1"),
    "select distinct co_regiao, co_uf, uf_sigla as sigla, uf_nome as nome from fact where uf_sigla is not null and co_regiao = 1",
)

# --- joins ---------------------------------------------------------------------------------------------
add(
    "jn1_left_join_with_fallback",
    lambda s, d: labels.lookup(
        star.fact(s, d, "co_municipio").distinct(), star.table(s, d, "customer").filter("c_acctbal > 0"), "co_municipio", "c_custkey", "nome", "c_name",
        F.col("co_municipio").cast("string"),
    ),
    f"with {star.fact_sql()} select distinct co_municipio, coalesce(c_name, cast(co_municipio as varchar)) as nome from fact left join (select * from customer where c_acctbal > 0) on c_custkey = co_municipio",
)
on_fact(
    "jn3_lookup_chain", "qe_renda tipo_ies curso_nome",
    lambda f: reduce(
        lambda rows, c: labels.lookup(rows, scores.category_codes(f, c), c, "categoria", f"{c}_codigo", "codigo"),
        ["curso_nome", "tipo_ies"],
        agg.value_counts(f, "curso_nome", "tipo_ies"),
    ),
    """g as (select curso_nome, tipo_ies, count(*) as total from fact group by 1, 2),
    a as (select v, cast(row_number() over (order by v) - 1 as int) as c from (select distinct curso_nome as v from fact)),
    b as (select v, cast(row_number() over (order by v) - 1 as int) as c from (select distinct tipo_ies as v from fact where tipo_ies is not null))
    select g.*, a.c as curso_nome_codigo, b.c as tipo_ies_codigo from g left join a on a.v = curso_nome left join b on b.v = tipo_ies""",
)
on_fact(
    "jn5_align_by_keys", "tipo_ies nu_ano nt_ger", lambda f: reports.network_trends_pivot(f, REAL, PROJ, PUB).select("ano", "pub_real", "prv_real").filter(F.col("pub_real").isNotNull()),
    f"""select nu_ano as ano, round(avg(nt_ger) filter (where tipo_ies like '{PUB}'), 2) as pub_real, round(avg(nt_ger) filter (where tipo_ies not like '{PUB}'), 2) as prv_real
    from fact where nt_ger is not null and tipo_ies is not null group by 1""",
)
on_fact(
    "jn6_align_by_rank", "qe_horas_estudo qe_horas_trabalho nt_ger",
    lambda f: agg.align_by_rank(
        agg.group_mean(f, ["qe_horas_estudo"], "nt_ger", media="a"), agg.group_mean(f, ["qe_horas_trabalho"], "nt_ger", media="b"),
        "qe_horas_estudo", "qe_horas_trabalho", "a", "b", ["um", "dois", "três", "quatro", "cinco"],
    ),
    """a as (select row_number() over (order by qe_horas_estudo) as i, round(avg(nt_ger), 2) as a from fact group by qe_horas_estudo),
    b as (select row_number() over (order by qe_horas_trabalho) as i, round(avg(nt_ger), 2) as b from fact group by qe_horas_trabalho),
    n as (select * from (values (1, 'um'), (2, 'dois'), (3, 'três'), (4, 'quatro'), (5, 'cinco')) t(i, grupo))
    select cast(n.i as int) as posicao, grupo, a.a, b.b from n left join a on a.i = n.i left join b on b.i = n.i""",
)

# --- aggregates ---------------------------------------------------------------------------------------------
on_fact("agg1_total", "nt_ger", lambda f: agg.total(filters.require(f, "nt_ger")), "select count(*) as total from fact where nt_ger is not null")
on_fact(
    "agg2_overview", "nt_fg nt_ce", lambda f: agg.overview(f, ["nt_fg", "nt_ce"], "nt_fg", 4),
    "select round(avg(nt_fg), 4) as media_nt_fg, round(avg(nt_ce), 4) as media_nt_ce, min(nt_fg) as min_nt_fg, max(nt_fg) as max_nt_fg from fact",
)
on_fact(
    "agg3_group_mean", "curso_nome uf_nome nt_ger", lambda f: agg.group_mean(f, ["curso_nome", "uf_nome"], "nt_ger"),
    "select curso_nome, uf_nome, count(*) as total, round(avg(nt_ger), 2) as media from fact group by 1, 2",
)
on_fact(
    "agg4_group_by_rounded", "pca_x pca_y nt_ger",
    lambda f: agg.group_mean(f, [F.round("pca_x", 1).alias("x"), F.round("pca_y", 1).alias("y")], "nt_ger"),
    "select round(pca_x, 1) as x, round(pca_y, 1) as y, count(*) as total, round(avg(nt_ger), 2) as media from fact group by 1, 2",
)
on_fact(
    "agg5_count_present", "modalidade nt_ger", lambda f: agg.count_present(f, ["modalidade"], "modalidade", {"media": "nt_ger"}, 4),
    "select modalidade, count(modalidade) as total, round(avg(nt_ger), 4) as media from fact group by 1",
)
on_fact(
    "agg6_weighted_mean", "tipo_ensino curso_nome nt_ce",
    lambda f: agg.weighted_mean(agg.group_mean(f, ["tipo_ensino", "curso_nome"], "nt_ce"), ["tipo_ensino"], "media", "total", 4),
    "g as (select tipo_ensino, curso_nome, count(*) as n, round(avg(nt_ce), 2) as m from fact group by 1, 2) select tipo_ensino, cast(sum(n) as bigint) as total, round(sum(m * n) / sum(n), 4) as media from g group by 1",
)
on_fact(
    "agg7_conditional_counts", "nu_ano nt_ger",
    lambda f: agg.conditional_counts(f, ["nu_ano"], {"alto": F.col("nt_ger") > 60, "baixo": F.col("nt_ger") <= 60, "sem": F.col("nt_ger").isNull()}),
    "select nu_ano, count(*) filter (where nt_ger > 60) as alto, count(*) filter (where nt_ger <= 60) as baixo, count(*) filter (where nt_ger is null) as sem from fact group by 1",
)
on_fact(
    "agg8_total_of_result", "curso_nome nt_ger", lambda f: agg.group_mean(f, ["curso_nome"], "nt_ger").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("grupos")),
    "select count(*) as total, count(distinct curso_nome) as grupos from fact",
)


def _medians(f: DataFrame) -> DataFrame:
    from microatlas.operators.quantiles import exact_medians

    columns = ["nt_ger", "nt_fg", "nt_ce", "qe_renda"]
    found = exact_medians(f, columns)
    return f.sparkSession.range(1).select(*[F.lit(found[c]).cast("double").alias(c) for c in columns])


on_fact(
    "agg9_medians", "nt_ger nt_fg nt_ce qe_renda", _medians,
    "select median(nt_ger) as nt_ger, median(nt_fg) as nt_fg, median(nt_ce) as nt_ce, cast(median(qe_renda) as double) as qe_renda from fact",
)


def _quantiles(spark, sf) -> DataFrame:
    from microatlas.operators.quantiles import exact_quantiles

    wanted = {"o_totalprice": [0.0, 0.33, 0.5, 0.66, 0.999, 1.0]}
    found = exact_quantiles(star.table(spark, sf, "orders"), wanted)["o_totalprice"]
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(f"q{i}") for i, v in enumerate(found)])


def _narrowed_quantiles(spark, sf) -> DataFrame:
    """The same cuts with as many nulls as values and another layout of the rows."""
    from microatlas.operators.quantiles import exact_quantiles

    rows = star.table(spark, sf, "orders")
    padded = rows.select("o_totalprice").unionAll(rows.select(F.lit(None).cast("double")))
    wanted = {"o_totalprice": [0.0, 0.33, 0.5, 0.66, 0.999, 1.0]}
    found = exact_quantiles(padded.repartition("o_totalprice"), wanted)["o_totalprice"]
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(f"q{i}") for i, v in enumerate(found)])


_QUANTILES = "select " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 6) as q{i}" for i, q in enumerate((0.0, 0.33, 0.5, 0.66, 0.999, 1.0))) + " from orders"
add("agg10_quantiles", _quantiles, _QUANTILES)
add("agg10_quantiles_narrowed", _narrowed_quantiles, _QUANTILES)
on_fact("agg11_value_counts", "faixa_nota", lambda f: agg.value_counts(f, "faixa_nota"), "select faixa_nota, count(*) as total from fact group by 1")
on_fact(
    "agg12_null_profile", "nt_ger tipo_ies qe_renda", agg.null_profile,
    "select 'nt_ger' as coluna, count(*) - count(nt_ger) as nulos from fact union all select 'tipo_ies', count(*) - count(tipo_ies) from fact union all select 'qe_renda', count(*) - count(qe_renda) from fact",
)
on_fact(
    "agg13_correlation", "nt_fg nt_ger", lambda f: agg.correlation(f, "nt_fg", "nt_ger"),
    "select count(*) filter (where nt_fg is not null and nt_ger is not null) as n, round(corr(nt_fg, nt_ger), 6) as r, round(corr(nt_fg, nt_ger) * corr(nt_fg, nt_ger), 6) as r2 from fact",
)
on_fact(
    "agg14_extremes", "uf_nome nt_ger", lambda f: agg.extremes(agg.group_mean(f, ["uf_nome"], "nt_ger", 6), "uf_nome", "media"),
    "g as (select uf_nome, round(avg(nt_ger), 6) as media from fact group by 1) select min_by(uf_nome, media) as menor_nome, min(media) as menor_valor, max_by(uf_nome, media) as maior_nome, max(media) as maior_valor from g",
)
on_fact(
    "agg15_last_over_first", "qe_escola_em nt_ger", lambda f: agg.last_over_first(agg.group_mean(f, ["qe_escola_em"], "nt_ger"), "media", "qe_escola_em", 3),
    "g as (select qe_escola_em as k, round(avg(nt_ger), 2) as m from fact where qe_escola_em is not null group by 1) select min_by(m, k) as primeiro, max_by(m, k) as ultimo, round(max_by(m, k) / min_by(m, k), 3) as fator from g",
)

# --- windows on report rows --------------------------------------------------------------------------------------
on_fact(
    "win2_share_of_total", "curso_nome", lambda f: agg.share_of_total(agg.value_counts(f, "curso_nome")),
    "select curso_nome, count(*) as total, round(count(*) * 100.0 / sum(count(*)) over (), 1) as pct from fact group by 1",
)
on_fact(
    "win3_share_of_all_rows", "qe_renda nt_ger", lambda f: reports.habits(f, None, {"qe_renda": {"0": "A", "1": "B"}}).select("codigo", "categoria", "total", "pct"),
    "n as (select count(*) as n from fact where nt_ger is not null) select cast(qe_renda as varchar) as codigo, case qe_renda when 0 then 'A' else 'B' end as categoria, count(*) as total, round(count(*) * 100.0 / (select n from n), 1) as pct from fact where nt_ger is not null and qe_renda in (0, 1) group by 1, 2",
)
on_fact(
    "win4_share_within", "nu_ano curso_nome", lambda f: agg.share_within(agg.value_counts(f, "nu_ano", "curso_nome"), ["nu_ano"]),
    "select nu_ano, curso_nome, count(*) as total, round(count(*) * 100.0 / sum(count(*)) over (partition by nu_ano), 1) as pct from fact group by 1, 2",
)
on_fact(
    "win5_share_of_matrix", "faixa_nota faixa_prevista", lambda f: agg.share_within(agg.value_counts(f.dropna(), "faixa_nota", "faixa_prevista"), []),
    "select faixa_nota, faixa_prevista, count(*) as total, round(count(*) * 100.0 / sum(count(*)) over (), 1) as pct from fact where faixa_nota is not null and faixa_prevista is not null group by 1, 2",
)
on_fact(
    "win6_change_over_time", "curso_nome nu_ano nt_ger",
    lambda f: agg.change_over_time(agg.group_mean(f, ["curso_nome", "nu_ano"], "nt_ger"), "nu_ano", "media", ["curso_nome"]),
    """g as (select curso_nome, nu_ano, count(*) as total, round(avg(nt_ger), 2) as media from fact group by 1, 2)
    select *, round(media - first_value(media) over w, 2) as delta_referencia, round(media - lag(media) over w, 2) as delta_anterior,
    round((media - first_value(media) over w) * 100 / first_value(media) over w, 1) as pct_referencia from g window w as (partition by curso_nome order by nu_ano)""",
)


# --- sorts: the order itself is a column ----------------------------------------------------------------------------
def _numbered(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("ordem", F.row_number().over(W.orderBy(*order)))


on_fact(
    "srt1_ascending_nulls_last", "tipo_ies", lambda f: _numbered(agg.value_counts(f, "tipo_ies"), F.col("tipo_ies").asc_nulls_last()),
    "select tipo_ies, count(*) as total, cast(row_number() over (order by tipo_ies asc nulls last) as int) as ordem from fact group by 1",
)
on_fact(
    "srt2_descending_nulls_first", "curso_nome nt_ger", lambda f: _numbered(agg.group_mean(f, ["curso_nome"], "nt_ger"), F.col("media").desc_nulls_first(), "curso_nome"),
    "g as (select curso_nome, count(*) as total, round(avg(nt_ger), 2) as media from fact group by 1) select *, cast(row_number() over (order by media desc nulls first, curso_nome) as int) as ordem from g",
)
on_fact(
    "srt3_by_derived_value", "curso_nome tipo_ies nt_ger", lambda f: _numbered(reports.course_by_network(f, PUB), F.col("delta").desc(), "curso").select("curso", "delta", "ordem"),
    f"""s as (select curso_nome as curso, round(round(avg(nt_ger) filter (where tipo_ies like '{PUB}'), 2) - round(avg(nt_ger) filter (where tipo_ies not like '{PUB}'), 2), 2) as delta
    from fact where nt_ger is not null and tipo_ies is not null group by 1) select *, cast(row_number() over (order by delta desc, curso) as int) as ordem from s""",
)
on_fact(
    "srt4_class_order", "faixa_nota", lambda f: _numbered(agg.value_counts(f.dropna(), "faixa_nota"), fc.class_order("faixa_nota")),
    "select faixa_nota, count(*) as total, case faixa_nota when 'baixo' then 1 when 'medio' then 2 else 3 end as ordem from fact where faixa_nota is not null group by 1",
)
def _places_in_order(spark, sf) -> DataFrame:
    """Municipality options in the order of their names, which the engine collates."""
    customers = star.table(spark, sf, "customer").filter("c_custkey is not null")
    start = F.when(F.col("c_custkey") % 3 == 0, "á").when(F.col("c_custkey") % 3 == 1, "B").otherwise("b")
    names = customers.select(
        F.col("c_custkey").alias("co_municipio"), F.lit(1).alias("co_uf"),
        F.concat(start, F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("nome"),
    )
    return in_place(reports.municipality_options(names, names.select("co_municipio", "nome"), 1)).select("nome", "ordem")


add(
    "srt5_locale_order", _places_in_order,
    """select nome, cast(row_number() over (order by strip_accents(lower(nome)), nome) as int) as ordem
    from (select distinct case c_custkey % 3 when 0 then 'á' when 1 then 'B' else 'b' end || lpad(cast(c_custkey as varchar), 9, '0') as nome from customer)""",
)
on_fact(
    "top1_first_and_last", "nu_ano nt_ger", lambda f: agg.first_and_last(agg.group_mean(f, ["nu_ano"], "nt_ger"), ["nu_ano", "media"], "nu_ano"),
    "g as (select nu_ano, round(avg(nt_ger), 2) as media from fact group by 1) select min(nu_ano) as primeiro_nu_ano, min_by(media, nu_ano) as primeiro_media, max(nu_ano) as ultimo_nu_ano, max_by(media, nu_ano) as ultimo_media from g",
)

# --- set operations and distinct ----------------------------------------------------------------------------------------
def _stacked_years(spark, sf) -> DataFrame:
    orders = star.table(spark, sf, "orders")
    parts = []
    for year in REAL:
        part = orders.filter(F.year("o_orderdate") == year).select("o_orderkey", "o_totalprice", F.lit(year).alias("nu_ano"))
        parts.append(part if year % 2 else part.withColumn("extra", F.lit("par")))
    return stack_rows(parts)


add(
    "set1_stack_editions", _stacked_years,
    "select o_orderkey, o_totalprice, cast(year(o_orderdate) as int) as nu_ano, case when year(o_orderdate) % 2 = 0 then 'par' end as extra from orders",
)
on_fact("dst1_states", "co_regiao co_uf uf_sigla uf_nome", reports.state_options, "select distinct co_regiao, co_uf, uf_sigla as sigla, uf_nome as nome from fact where uf_sigla is not null")
on_fact("dst2_states_of_region", "co_regiao co_uf uf_sigla uf_nome", lambda f: reports.state_options(f, "0"), "select distinct co_regiao, co_uf, uf_sigla as sigla, uf_nome as nome from fact where uf_sigla is not null and co_regiao = 0")
on_fact("dst3_courses", "co_grupo curso_nome", reports.course_options, "select distinct co_grupo, curso_nome as nome from fact")
on_fact(
    "dst4_types_as_list", "tipo_ensino", lambda f: reports.type_options(f).agg(F.array_join(F.sort_array(F.collect_set("tipo_ensino")), ",").alias("tipos")),
    "select string_agg(t, ',' order by t) as tipos from (select distinct tipo_ensino as t from fact)",
)
on_fact("dst5_municipalities", "co_uf co_municipio", lambda f: reports.municipality_codes(f, "4"), "select distinct co_municipio from fact where co_uf = 4 and co_municipio is not null")

# --- reshape ---------------------------------------------------------------------------------------------------------------
on_fact(
    "piv1_by_year", "uf_nome nu_ano nt_ger", lambda f: reshape.pivot_value(agg.group_mean(f, ["uf_nome", "nu_ano"], "nt_ger"), ["uf_nome"], "nu_ano", [*REAL, 2050], "media", "a"),
    "select uf_nome, " + ", ".join(f'round(avg(nt_ger) filter (where nu_ano = {y}), 2) as a{y}' for y in (*REAL, 2050)) + " from fact group by 1",
)
on_fact(
    "piv2_by_class", "curso_nome faixa_nota", lambda f: reshape.pivot_count(f, ["curso_nome"], "faixa_nota", [*config.CLASSES, "nenhum"]),
    "select curso_nome, " + ", ".join(f"count(*) filter (where faixa_nota = '{c}') as {c}" for c in (*config.CLASSES, "nenhum")) + " from fact group by 1",
)
on_fact(
    "piv3_two_sides", "uf_nome modalidade nt_ger",
    lambda f: reshape.two_sides(f, ["uf_nome"], F.coalesce("modalidade", F.lit("O")), (("F", "m_f", "n_f"), ("O", "m_o", "n_o")), "nt_ger").withColumn("delta", F.round(F.col("m_f") - F.col("m_o"), 2)),
    """s as (select uf_nome, round(avg(nt_ger) filter (where modalidade = 'F'), 2) as m_f, count(*) filter (where modalidade = 'F') as n_f, round(avg(nt_ger) filter (where modalidade is null), 2) as m_o,
    count(*) filter (where modalidade is null) as n_o from fact group by 1) select *, round(m_f - m_o, 2) as delta from s""",
)
on_fact(
    "piv4_binary_cross", "sexo qe_raca_cor nt_ger", lambda f: reports.binary_by_race(f, "sexo", ("F", "M")).select("codigo", "media_f", "media_m", "total_f", "total_m"),
    """select cast(qe_raca_cor as varchar) as codigo, round(avg(nt_ger) filter (where sexo = 'F'), 2) as media_f, cast(null as double) as media_m, count(*) filter (where sexo = 'F') as total_f, 0::bigint as total_m
    from fact where nt_ger is not null and sexo is not null group by 1""",
)
on_fact(
    "piv5_nested_cells", "curso_nome nu_ano",
    lambda f: reshape.nested_cells(agg.value_counts(f, "curso_nome", "nu_ano"), ["curso_nome"], ["nu_ano", "total"], "celulas").select(
        "curso_nome", F.array_join(F.transform("celulas", lambda x: F.concat_ws(":", x["nu_ano"].cast("string"), x["total"].cast("string"))), ",").alias("celulas")
    ),
    "g as (select curso_nome, nu_ano, count(*) as n from fact group by 1, 2) select curso_nome, string_agg(nu_ano || ':' || n, ',' order by nu_ano) as celulas from g group by 1",
)
on_fact(
    "piv6_sparse_percent", "tipo_ensino curso_nome",
    lambda f: reshape.pivot_value(agg.share_within(agg.value_counts(f, "tipo_ensino", "curso_nome"), ["tipo_ensino"]), ["tipo_ensino"], "curso_nome", ["ECONOMY", "LARGE", "PROMO"], "pct"),
    """p as (select tipo_ensino, curso_nome, round(count(*) * 100.0 / sum(count(*)) over (partition by tipo_ensino), 1) as pct from fact group by 1, 2)
    select tipo_ensino, max(pct) filter (where curso_nome = 'ECONOMY') as "ECONOMY", max(pct) filter (where curso_nome = 'LARGE') as "LARGE", max(pct) filter (where curso_nome = 'PROMO') as "PROMO" from p group by 1""",
)
on_fact(
    "piv7_year_by_income", "nu_ano qe_renda renda_nome nt_ger", lambda f: reports.income_over_time_pivot(f, None, ["Até 1,5 SM", "10 a 30 SM"]),
    """select nu_ano as ano, round(avg(nt_ger) filter (where renda_nome = 'Até 1,5 SM'), 2) as "Até 1,5 SM", cast(null as double) as "10 a 30 SM" from fact where nt_ger is not null and renda_nome is not null group by 1""",
)
on_fact(
    "piv8_radar", "cluster_id nt_ger nt_fg nt_ce", reports.cluster_radar,
    "select 'Cluster ' || cluster_id as cluster, round(avg(nt_ger), 1) as media_ger, round(avg(nt_fg), 1) as media_fg, round(avg(nt_ce), 1) as media_ce from fact group by cluster_id",
)
on_fact(
    "unp1_stack_columns", "qe_horas_estudo qe_trabalha qe_acesso_internet nt_ger",
    lambda f: agg.group_mean(reshape.stack_columns(f, ["nt_ger"], ["qe_horas_estudo", "qe_trabalha", "qe_acesso_internet"]), ["variavel", "categoria"], "nt_ger"),
    " union all ".join(
        f"(select '{c}' as variavel, cast({c} as varchar) as categoria, count(*) as total, round(avg(nt_ger), 2) as media from fact group by 2)" for c in ("qe_horas_estudo", "qe_trabalha", "qe_acesso_internet")
    ).replace("(select", "select", 1).replace(" group by 2)", " group by 2", 1),
)
on_fact(
    "den1_dense_grid", "nt_ger nu_ano",
    lambda f: reshape.densify(
        f.groupBy(fc.bucket("nt_ger").alias("bucket"), "nu_ano").agg(F.count(F.lit(1)).alias("total")), "total", bucket=config.BUCKETS, nu_ano=[*REAL, 2014]
    ),
    f"""b as (select cast(unnest(range(0, 100, 10)) as int) as bucket), y as (select unnest([{', '.join(map(str, (*REAL, 2014)))}]) as nu_ano),
    c as (select least(cast(floor(nt_ger / 10) * 10 as int), 90) as bucket, nu_ano, count(*) as n from fact where nt_ger is not null group by 1, 2)
    select b.bucket, y.nu_ano, coalesce(n, 0) as total from b cross join y left join c on c.bucket = b.bucket and c.nu_ano = y.nu_ano""",
)
on_fact(
    "den2_class_matrix", "faixa_nota faixa_prevista",
    lambda f: reshape.densify(
        f.dropna().withColumn("faixa_nota", F.when(F.col("faixa_nota") == "alto", "outra").otherwise(F.col("faixa_nota"))).groupBy(F.col("faixa_nota").alias("real"), F.col("faixa_prevista").alias("previsto")).agg(F.count(F.lit(1)).alias("total")),
        "total", real=config.CLASSES, previsto=config.CLASSES,
    ),
    """k as (select unnest(['baixo', 'medio', 'alto']) as c), g as (select faixa_nota as r, faixa_prevista as p, count(*) as n from fact where faixa_nota <> 'alto' group by 1, 2)
    select a.c as real, b.c as previsto, coalesce(n, 0) as total from k a cross join k b left join g on g.r = a.c and g.p = b.c""",
)
on_fact(
    "den3_year_scaffold", "curso_nome", lambda f: reshape.year_scaffold(agg.value_counts(f, "curso_nome"), REAL, PROJ),
    f"g as (select curso_nome, count(*) as total from fact group by 1), y as (select unnest([{', '.join(map(str, REAL))}]) as ano, 'real' as tipo union all select unnest([{', '.join(map(str, PROJ))}]), 'projecao') select * from g cross join y",
)

# --- scalar functions, one query per few functions --------------------------------------------------------------------------
add(
    "scl1_scl2_scl4_rounding",
    lambda s, d: star.table(s, d, "orders").select("o_orderkey", F.round("o_totalprice", 1).alias("r1"), fc.percent(F.col("o_orderkey") % 1000, F.lit(1000)).alias("pct"), F.floor(F.col("o_totalprice") / 100).alias("piso")),
    "select o_orderkey, round(o_totalprice, 1) as r1, round(o_orderkey % 1000 * 100.0 / 1000, 1) as pct, cast(floor(o_totalprice / 100) as bigint) as piso from orders",
)
add(
    "scl3_half_even",
    lambda s, d: star.table(s, d, "part").select("p_partkey", fc.rounded_half_even(F.col("p_size") / 8, 2).alias("par")),
    "select p_partkey, round_even(p_size / 8, 2) as par from part",
)
on_fact(
    "scl5_scl6_clamps", "curso_nome nu_ano nt_ger",
    lambda f: agg.group_mean(f, ["curso_nome", "nu_ano"], "nt_ger").select(
        "curso_nome", "nu_ano", F.round(fc.point_radius("total"), 6).alias("raio"), F.round(fc.point_radius("total", (4.0, 36.0, 0.8)), 6).alias("raio_pagina"),
        F.round(fc.to_ceiling("media", 40.0), 6).alias("relativo"), F.round(fc.to_ceiling("media", 90.0, 1.0), 6).alias("fracao"),
    ),
    """g as (select curso_nome, nu_ano, count(*) as n, round(avg(nt_ger), 2) as m from fact group by 1, 2)
    select curso_nome, nu_ano, round(greatest(4.0::double, least(30.0::double, sqrt(n) * 0.8::double)), 6) as raio, round(greatest(4.0::double, least(36.0::double, sqrt(n) * 0.8::double)), 6) as raio_pagina,
    round(least(m / 40.0::double * 100, 100.0::double), 6) as relativo, round(least(m / 90.0::double, 1.0::double), 6) as fracao from g""",
)
on_fact(
    "scl7_scl8_defaults_and_casts", f"{KEYS} tipo_ies nt_ger",
    lambda f: f.select(*KEYS.split(), F.coalesce("tipo_ies", F.lit("Não informado")).alias("tipo"), F.col("l_partkey").cast("string").alias("texto"), F.coalesce(F.col("nt_ger"), F.lit(0.0)).cast("int").alias("inteiro"), fc.whole_number(F.substring("tipo_ies", 1, 1)).alias("numero")),
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(tipo_ies, 'Não informado') as tipo, cast(l_partkey as varchar) as texto, cast(trunc(coalesce(nt_ger, 0)) as int) as inteiro, try_cast(substr(tipo_ies, 1, 1) as bigint) as numero from fact",
)
add(
    "scl9_scl10_scl11_text",
    lambda s, d: star.table(s, d, "documents").select("doc_id", F.col("text").like("%the%").alias("tem"), F.col("text").contains("a").alias("contem"), fc.is_token(F.concat(F.lit("  "), "lang", F.lit(" ")), "en").alias("en"), F.when(F.col("n_chars") > 500, "longo").otherwise("curto").alias("tamanho")),
    "select doc_id, text like '%the%' as tem, contains(text, 'a') as contem, lang = 'en' as en, case when n_chars > 500 then 'longo' else 'curto' end as tamanho from documents",
)
add(
    "scl12_json",
    lambda s, d: star.table(s, d, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("f1-score"), F.from_json("props", "struct<k:bigint>")["k"].alias("k"))).alias("detalhe")),
    "select event_id, cast(props->>'$.k' as bigint) as k, '{\"f1-score\":\"' || event_type || '\",\"k\":' || (props->>'$.k') || '}' as detalhe from events",
)
on_fact(
    "scl13_to_scl16_percents", "nu_ano nt_ger faixa_nota",
    lambda f: agg.conditional_counts(f, ["nu_ano"], {"a": F.col("faixa_nota") == "alto", "z": F.col("faixa_nota") == "nada"}).select(
        "nu_ano", fc.percent_of(fc.ratio(F.col("a"), F.col("a") + F.col("z")), 2).alias("cheio"), fc.percent(F.col("a"), F.col("z")).alias("vazio"),
        fc.direction(F.col("z") - F.col("a")).alias("sentido"), F.abs(F.col("z") - F.col("a")).alias("absoluto"),
    ),
    "select nu_ano, 100.0::double as cheio, 0.0::double as vazio, '↓' as sentido, count(*) filter (where faixa_nota = 'alto') as absoluto from fact group by 1",
)

# --- trends ----------------------------------------------------------------------------------------------------------------------
on_fact(
    "reg1_fit_line", "curso_nome nu_ano nt_ger", lambda f: _course_fits(f).select("curso_nome", "pontos", *trend.coefficients()),
    f"{_LINE} select curso_nome, pontos, round(b0, 4) as b0, round(b1, 4) as b1, round(r2, 4) as r2 from f",
)
on_fact(
    "reg2_predict", "curso_nome nu_ano nt_ger", lambda f: _course_fits(f).select("curso_nome", *[trend.predict(F.lit(float(y)), 6).alias(f"p{y}") for y in PROJ]),
    f"{_LINE} select curso_nome, " + ", ".join(f"round(b0 + b1 * {y}, 6) as p{y}" for y in PROJ) + " from f",
)
on_fact(
    "reg3_overall_trend", "nu_ano nt_fg", lambda f: reports.overall_trend(f.withColumnRenamed("nt_fg", "nt_ger"), REAL, PROJ).select("ano", "projecao", "b1"),
    f"""p as (select nu_ano, round(avg(nt_fg), 2) as m from fact group by 1), f as (select regr_intercept(m, nu_ano) as b0, regr_slope(m, nu_ano) as b1 from p)
    select y.ano, case when y.ano > 2001 then round(b0 + b1 * y.ano, 2) end as projecao, round(b1, 4) as b1 from f, (select unnest([{', '.join(map(str, (*REAL, *PROJ)))}]) as ano) y""",
)
on_fact(
    "reg4_grouped_trend", "uf_nome nu_ano nt_ger",
    lambda f: trend.trend(agg.group_mean(filters.require(f, "nt_ger"), ["uf_nome", F.col("nu_ano").alias("ano")], "nt_ger"), REAL, PROJ, ["uf_nome"], require_reliable=True).select("uf_nome", "ano", "media", "projecao", "confiavel"),
    f"""p as (select uf_nome, nu_ano as ano, round(avg(nt_ger), 2) as media from fact where nt_ger is not null group by 1, 2), f as (select uf_nome, regr_intercept(media, ano) as b0, regr_slope(media, ano) as b1, regr_r2(media, ano) as r2 from p group by 1 having count(*) >= 3),
    t as (select f.uf_nome, y.ano, case when y.ano <= 2001 then media end as media, round(r2, 4) >= 0.75 and round(b0 + b1 * 2004, 2) between 20 and 100 and round(b0 + b1 * 2007, 2) between 20 and 100 as confiavel, round(b0 + b1 * y.ano, 2) as v
    from f cross join (select unnest([{', '.join(map(str, (*REAL, *PROJ)))}]) as ano) y left join p on p.uf_nome = f.uf_nome and p.ano = y.ano)
    select uf_nome, ano, media, case when confiavel and ano > 2001 then v end as projecao, confiavel from t""",
)
on_fact(
    "reg5_network_trend", "tipo_ies nu_ano nt_ce", lambda f: reports.network_trends(f.withColumnRenamed("nt_ce", "nt_ger"), REAL, PROJ, PUB).select("rede", "ano", "projecao", "r2"),
    f"""p as (select case when tipo_ies like '{PUB}' then 'Pública' else 'Privada' end as rede, nu_ano as ano, round(avg(nt_ce), 2) as m from fact where tipo_ies is not null group by 1, 2),
    f as (select rede, regr_intercept(m, ano) as b0, regr_slope(m, ano) as b1, regr_r2(m, ano) as r2 from p group by 1)
    select rede, y.ano, case when y.ano > 2001 then round(b0 + b1 * y.ano, 2) end as projecao, round(r2, 4) as r2 from f, (select unnest([{', '.join(map(str, (*REAL, *PROJ)))}]) as ano) y""",
)
on_fact(
    "reg6_reliable_counts", "curso_nome nu_ano nt_ce", lambda f: reports.trend_summary(f.withColumnRenamed("nt_ce", "nt_ger"), REAL, PROJ).select("cursos_confiaveis", "cursos_nao_confiaveis"),
    """p as (select curso_nome, nu_ano as ano, round(avg(nt_ce), 2) as m from fact group by 1, 2), f as (select curso_nome, regr_intercept(m, ano) as b0, regr_slope(m, ano) as b1, regr_r2(m, ano) as r2 from p group by 1),
    c as (select round(r2, 4) >= 0.75 and round(b0 + b1 * 2004, 2) between 20 and 100 and round(b0 + b1 * 2007, 2) between 20 and 100 as ok from f) select count(*) filter (where ok) as cursos_confiaveis, count(*) filter (where not ok) as cursos_nao_confiaveis from c""",
)
