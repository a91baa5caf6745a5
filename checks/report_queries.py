"""The named reports R01 to R51 on the fact-shaped view."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import star
from checks.registry import ORACLE, add, add_in_order, in_place, on_fact
from microatlas.operators import evaluate
from microatlas.plans import cube, endpoints
from microatlas.plans import reports as r
from microatlas.runtime import scratch_path

PUB = star.PATTERN
REAL, PROJ = star.REAL_YEARS, star.PROJECTED_YEARS
RACE = "case cast(qe_raca_cor as varchar) when '0' then 'Não decl.' when '1' then 'Branca' when '2' then 'Preta' when '3' then 'Parda' when '4' then 'Amarela' when '5' then 'Indígena' else cast(qe_raca_cor as varchar) end"
INCOME = "case cast(qe_renda as varchar) when '0' then 'Não decl.' when '1' then '≤1,5SM' when '2' then '1,5–3SM' when '3' then '3–4,5SM' end"
FILTERS = {"ano": "1997", "tipo": "Bacharelado", "regiao": 2}
WHERE = "nu_ano = 1997 and tipo_ensino = 'Bacharelado' and co_regiao = 2"
FILTER_COLUMNS = "nu_ano tipo_ensino co_regiao"

# --- statistics ---
on_fact("r01_total_students", "nu_ano", r.total_students, "select count(*) as total from fact")
on_fact(
    "r02_score_overview", "nt_ger nt_fg nt_ce", lambda f: r.score_overview(f, digits=6),
    """select round(avg(nt_ger), 6) as media_nt_ger, round(avg(nt_fg), 6) as media_nt_fg,
    round(avg(nt_ce), 6) as media_nt_ce, min(nt_ger) as min_nt_ger, max(nt_ger) as max_nt_ger from fact""",
)
on_fact("r03_by_band", "faixa_nota", r.by_band, "select faixa_nota, count(faixa_nota) as total from fact group by 1")
on_fact(
    "r04_by_year", "nu_ano nt_ger", lambda f: r.by_year(f, digits=6),
    "select nu_ano, count(nu_ano) as total, round(avg(nt_ger), 6) as media from fact group by 1",
)
on_fact(
    "r05_by_course", "co_grupo curso_nome nt_ger", lambda f: r.by_course(f, digits=6),
    "select co_grupo, curso_nome, count(co_grupo) as total, round(avg(nt_ger), 6) as media from fact group by 1, 2",
)
on_fact(
    "r06_by_region", "co_regiao regiao_nome nt_ger", lambda f: r.by_region(f, digits=6),
    "select co_regiao, regiao_nome, count(co_regiao) as total, round(avg(nt_ger), 6) as media from fact group by 1, 2",
)
on_fact(
    "r07_by_institution_type", "tipo_ies nt_ger", lambda f: r.by_institution_type(f, digits=6),
    "select tipo_ies, count(tipo_ies) as total, round(avg(nt_ger), 6) as media from fact group by 1",
)


def _stacked(sets: dict, measures: str, where: dict[str, str]) -> str:
    """One SELECT per report, the keys it does not use as typed nulls."""
    kinds = {c: "varchar" for keys in sets.values() for c in keys}
    kinds.update({c: "int" for c in kinds if c in ("nu_ano", "co_regiao") or c.startswith("qe_")})
    kinds.update({"co_grupo": "bigint"}, **({"qe_estado_civil": "varchar"} if "qe_estado_civil" in kinds else {}))
    parts = []
    for name, keys in sets.items():
        columns = ", ".join(c if c in keys else f"cast(null as {k}) as {c}" for c, k in kinds.items() if any(c in x for x in sets.values()))
        parts.append(f"select '{name}' as relatorio, {columns}, count(*) as total, {measures} from fact {where.get(name, '')} group by {', '.join(keys)}")
    return "select * from (" + " union all ".join(parts) + ") t"


on_fact(
    "r03_r07_in_one_scan", "nu_ano co_grupo curso_nome co_regiao regiao_nome tipo_ies faixa_nota nt_ger",
    r.statistics_in_one_scan, _stacked(r.STATISTICS_SETS, "round(avg(nt_ger), 2) as media", {}),
)
on_fact(
    "r08_r16_in_one_scan",
    "nu_ano qe_renda renda_nome qe_escola_em escola_em_nome qe_trabalha qe_horas_estudo tipo_ies qe_financiamento qe_estado_civil tipo_ensino nt_ger nt_fg nt_ce",
    r.socioeconomic_in_one_scan,
    _stacked(
        r.SOCIOECONOMIC_SETS, "round(avg(nt_ger), 2) as media, round(avg(nt_fg), 2) as media_fg, round(avg(nt_ce), 2) as media_ce",
        {name: "where nt_ger is not null" + ("" if name == "renda" else "".join(f" and {c} is not null" for c in keys)) for name, keys in r.SOCIOECONOMIC_SETS.items()},
    ),
)

# --- socioeconomic ---
on_fact(
    "r08_income", "qe_renda renda_nome nt_ger", r.income,
    "select qe_renda, renda_nome as nome, count(*) as total, round(avg(nt_ger), 2) as media from fact where nt_ger is not null group by 1, 2",
)
on_fact(
    "r09_school", "qe_escola_em escola_em_nome nt_ger", r.school,
    "select qe_escola_em, escola_em_nome as nome, count(*) as total, round(avg(nt_ger), 2) as media from fact where nt_ger is not null and qe_escola_em is not null group by 1, 2",
)
for name, column, build in (
    ("r10_works", "qe_trabalha", r.works), ("r11_study_hours", "qe_horas_estudo", r.study_hours),
):
    on_fact(
        name, f"{column} nt_ger", build,
        f"select cast({column} as varchar) as nome, count(*) as total, round(avg(nt_ger), 2) as media from fact where nt_ger is not null and {column} is not null group by 1",
    )
on_fact(
    "r12_institution_type", "tipo_ies nt_ger", r.institution_type,
    "select tipo_ies as nome, count(*) as total, round(avg(nt_ger), 2) as media from fact where nt_ger is not null and tipo_ies is not null group by 1",
)
on_fact(
    "r13_income_over_time", "nu_ano qe_renda renda_nome nt_ger", r.income_over_time,
    "select nu_ano as ano, renda_nome as renda, round(avg(nt_ger), 2) as media from fact where nt_ger is not null and renda_nome is not null group by 1, 2",
)
_incomes = ("Até 1,5 SM", "1,5 a 3 SM", "3 a 4,5 SM", "4,5 a 6 SM", "6 a 10 SM", "10 a 30 SM", "Mais de 30 SM")
on_fact(
    "r13_income_over_time_pivot", "nu_ano qe_renda renda_nome nt_ger", r.income_over_time_pivot,
    "select nu_ano as ano, " + ", ".join(f"round(avg(nt_ger) filter (where renda_nome = '{i}'), 2) as \"{i}\"" for i in _incomes)
    + " from fact where nt_ger is not null and renda_nome is not null group by 1",
)
on_fact(
    "r14_funding", "qe_financiamento nt_ger", r.funding,
    """select case qe_financiamento when 0 then 'Sem financiamento' when 1 then 'ProUni' when 2 then 'FIES' when 3 then 'ProUni + FIES'
    when 4 then 'Outro público' when 5 then 'Outro privado' end as nome, cast(qe_financiamento as varchar) as codigo, count(*) as total,
    round(avg(nt_ger), 2) as media from fact where nt_ger is not null and qe_financiamento is not null group by 1, 2""",
)
on_fact(
    "r15_marital_status", "qe_estado_civil nt_ger", r.marital_status,
    """select case qe_estado_civil when 'A' then 'Solteiro(a)' when 'B' then 'Casado(a)' when 'D' then 'Viúvo(a)' else qe_estado_civil end as nome,
    qe_estado_civil as codigo, count(*) as total, round(avg(nt_ger), 2) as media
    from fact where nt_ger is not null and qe_estado_civil is not null group by 1, 2""",
)
on_fact(
    "r16_scores_by_teaching_type", "tipo_ensino nt_ger nt_fg nt_ce", r.scores_by_teaching_type,
    """select tipo_ensino as tipo, count(*) as total, round(avg(nt_ger), 2) as media_ger, round(avg(nt_fg), 2) as media_fg, round(avg(nt_ce), 2) as media_ce
    from fact where nt_ger is not null and tipo_ensino is not null group by 1""",
)

# --- race and habits ---
_RACE_ROWS = f"""select {RACE} as nome, cast(qe_raca_cor as varchar) as codigo, count(*) as total, round(avg(nt_ger), 2) as media_nota
    from fact where nt_ger is not null and qe_raca_cor is not null group by 1, 2"""
on_fact(
    "r17_race", "qe_raca_cor nt_ger", r.race,
    f"rows_ as ({_RACE_ROWS}) select *, round(total * 100.0 / sum(total) over (), 1) as pct from rows_",
)
_HABITS = {
    "qe_horas_estudo": ("Horas de estudo extraclasse (QE_I17)", {"0": "Nenhuma hora", "1": "De 1 a 3 h/sem", "2": "De 4 a 7 h/sem", "3": "Mais de 7 h/sem"}),
    "qe_trabalha": ("Vínculo empregatício (QE_I18)", {"0": "Não trabalha", "1": "Até 20 h/sem", "2": "Entre 20 e 40 h/sem", "3": "Mais de 40 h/sem"}),
    "qe_horas_trabalho": ("Horas de trabalho semanal (QE_I19)", {"0": "Não trabalha", "1": "Até 20 h/sem", "2": "Entre 20 e 40 h/sem", "3": "Mais de 40 h/sem"}),
    "qe_uso_biblioteca": ("Frequência de uso da biblioteca (QE_I21)", {"A": "Nunca/quase nunca", "B": "Sempre/quase sempre"}),
    "qe_acesso_internet": ("Acesso à internet para estudo (QE_I23)", {"A": "Nunca", "B": "Raramente", "C": "Ocasionalmente", "D": "Frequentemente", "E": "Sempre"}),
}
_HABIT_SQL = (
    "names as (select * from (values "
    + ", ".join(f"('{v}', '{title}', '{code}', '{text}')" for v, (title, codes) in _HABITS.items() for code, text in codes.items())
    + ") t(variavel, label, codigo, categoria)), everyone as (select count(*) as n from fact where nt_ger is not null), groups as ("
    + " union all ".join(
        f"select '{v}' as variavel, cast({v} as varchar) as codigo, count(*) as total, round(avg(nt_ger), 2) as media_nota from fact where nt_ger is not null and {v} is not null group by {v}"
        for v in _HABITS
    )
    + "), habits as (select g.variavel, n.label, g.codigo, n.categoria, g.total, round(g.total * 100.0 / (select n from everyone), 1) as pct, g.media_nota from groups g join names n on n.variavel = g.variavel and n.codigo = g.codigo) "
)
HABIT_COLUMNS = " ".join(_HABITS) + " nt_ger"
on_fact("r18_habits", HABIT_COLUMNS, r.habits, _HABIT_SQL + "select * from habits")
on_fact(
    "r19_habit_cards", HABIT_COLUMNS,
    lambda f: r.habit_cards(f, {
        "nao_estuda": ("qe_horas_estudo", "Nenhuma hora"),
        "nao_trabalha": ("qe_trabalha", "Não trabalha"),
        "usa_biblioteca": ("qe_uso_biblioteca", "Sempre/quase sempre"),
        "ausente": ("qe_uso_biblioteca", "Às vezes"),
    }),
    _HABIT_SQL + """select max(pct) filter (where variavel = 'qe_horas_estudo' and categoria = 'Nenhuma hora') as nao_estuda,
    max(pct) filter (where variavel = 'qe_trabalha' and categoria = 'Não trabalha') as nao_trabalha,
    max(pct) filter (where variavel = 'qe_uso_biblioteca' and categoria = 'Sempre/quase sempre') as usa_biblioteca,
    0.0::double as ausente from habits""",
)
on_fact(
    "r20_study_against_work", "qe_trabalha qe_horas_estudo nt_ger", r.study_against_work,
    """w as (select qe_trabalha as k, round(avg(nt_ger), 2) as trabalho from fact where nt_ger is not null and qe_trabalha is not null group by 1),
    s as (select qe_horas_estudo as k, round(avg(nt_ger), 2) as estudo from fact where nt_ger is not null and qe_horas_estudo is not null group by 1)
    select cast(w.k + 1 as int) as posicao, case w.k when 0 then 'Nenhuma / Não trabalha' when 1 then 'Baixa intensidade' when 2 then 'Média intensidade' else 'Alta intensidade' end as grupo,
    trabalho, estudo from w join s on w.k = s.k""",
)

# --- clusters and model tables (model columns are stand-ins) ---
on_fact(
    "r21_projection_points", "pca_x pca_y cluster_id nt_ger", r.projection_points,
    """select round(pca_x, 4) as x, round(pca_y, 4) as y, cluster_id, count(*) as total, round(avg(nt_ger), 2) as media_nota,
    round(greatest(4.0::double, least(30.0::double, sqrt(count(*)) * 0.8::double)), 6) as r from fact
    where pca_x is not null and pca_y is not null and cluster_id is not null group by 1, 2, 3""",
)
on_fact(
    "r22_cluster_statistics", "cluster_id nt_ger nt_fg nt_ce", lambda f: r.cluster_statistics(f, digits=6),
    "select cluster_id, count(cluster_id) as total, round(avg(nt_ger), 6) as media_ger, round(avg(nt_fg), 6) as media_fg, round(avg(nt_ce), 6) as media_ce from fact group by 1",
)
on_fact(
    "r22_cluster_radar", "cluster_id nt_ger nt_fg nt_ce", r.cluster_radar,
    "select 'Cluster ' || cluster_id as cluster, round(avg(nt_ger), 1) as media_ger, round(avg(nt_fg), 1) as media_fg, round(avg(nt_ce), 1) as media_ce from fact group by cluster_id",
)
on_fact(
    "r23_cluster_bands", "cluster_id faixa_nota", r.cluster_bands,
    "select cluster_id, faixa_nota, count(faixa_nota) as total from fact group by 1, 2",
)

# --- filter options ---
on_fact(
    "r25_state_options", "co_regiao co_uf uf_sigla uf_nome", r.state_options,
    "select distinct co_regiao, co_uf, uf_sigla as sigla, uf_nome as nome from fact where uf_sigla is not null",
)
on_fact(
    "r25_course_options", "co_grupo curso_nome", r.course_options,
    "select distinct co_grupo, curso_nome as nome from fact where curso_nome is not null",
)
on_fact(
    "r25_type_options", "tipo_ensino", r.type_options,
    "select distinct tipo_ensino from fact where tipo_ensino is not null",
)
on_fact(
    "r26_states_of_region", "co_regiao co_uf uf_sigla uf_nome", lambda f: r.state_options(f, 2),
    "select distinct co_regiao, co_uf, uf_sigla as sigla, uf_nome as nome from fact where uf_sigla is not null and co_regiao = 2",
)


def _municipalities(spark, sf):
    named = star.table(spark, sf, "customer").filter("c_acctbal > 0")
    return named.select(F.col("c_custkey").alias("co_municipio"), F.col("c_name").alias("nome"))


add(
    "r27_municipality_options",
    lambda spark, sf: r.municipality_options(
        star.fact(spark, sf, "co_uf", "co_municipio"), _municipalities(spark, sf), 3
    ),
    f"""with {star.fact_sql()} select distinct f.co_municipio, coalesce(c_name, cast(f.co_municipio as varchar)) as nome
    from fact f left join (select * from customer where c_acctbal > 0) m on m.c_custkey = f.co_municipio
    where f.co_uf = 3 and f.co_municipio is not null""",
)

# --- overview ---
on_fact(
    "r28_modality_by_year", "nu_ano modalidade", lambda f: r.modality_by_year(f, "F"),
    """select nu_ano as ano, count(*) filter (where modalidade = 'F') as presencial,
    count(*) filter (where modalidade is null or modalidade <> 'F') as ead_nd, count(*) as total from fact group by 1""",
)
on_fact(
    "r29_network_by_year", "nu_ano tipo_ies", lambda f: r.network_by_year(f, PUB),
    f"""c as (select nu_ano as ano, count(*) filter (where tipo_ies like '{PUB}') as publica,
    count(*) filter (where tipo_ies not like '{PUB}') as privada, count(*) as total from fact where tipo_ies is not null group by 1)
    select *, round(publica * 100.0 / total, 1) as pct_pub, round(privada * 100.0 / total, 1) as pct_priv from c""",
)


def _regions(spark, sf):
    pairs = star.table(spark, sf, "nation").join(
        star.table(spark, sf, "region").filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return pairs.select(
        F.regexp_replace("n_name", "NATION_", "U").alias("uf"), F.col("r_name").alias("regiao")
    )


_REGIONS = "d as (select replace(n_name, 'NATION_', 'U') as uf, r_name as regiao from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA')"
add(
    "r30_by_state",
    lambda spark, sf: r.by_state(star.fact(spark, sf, "uf_sigla", "uf_nome", "nt_ger"), _regions(spark, sf)),
    f"""with {star.fact_sql()}, {_REGIONS}, s as (select uf_sigla as uf, uf_nome as nome, count(*) as total, round(avg(nt_ger), 2) as media
    from fact where uf_sigla is not null and nt_ger is not null group by 1, 2)
    select s.*, coalesce(d.regiao, 'Desconhecido') as regiao from s left join d on d.uf = s.uf""",
)
add(
    "r31_by_region_of_state",
    lambda spark, sf: r.by_region_of_state(star.fact(spark, sf, "uf_sigla", "nt_ger"), _regions(spark, sf)),
    f"""with {star.fact_sql()}, {_REGIONS} select coalesce(d.regiao, 'Desconhecido') as regiao, count(*) as total, round(avg(nt_ger), 2) as media
    from fact left join d on d.uf = uf_sigla where uf_sigla is not null and nt_ger is not null group by 1""",
)
add(
    "r31_region_mean_of_rounded",
    lambda spark, sf: r.by_region_of_state(
        star.fact(spark, sf, "uf_sigla", "uf_nome", "nt_ger"), _regions(spark, sf), mean_of_rounded=True
    ),
    f"""with {star.fact_sql()}, {_REGIONS}, s as (select uf_sigla as uf, uf_nome, count(*) as total, round(avg(nt_ger), 2) as media
    from fact where uf_sigla is not null and nt_ger is not null group by 1, 2)
    select coalesce(d.regiao, 'Desconhecido') as regiao, cast(sum(total) as bigint) as total, round(sum(media * total) / sum(total), 2) as media
    from s left join d on d.uf = s.uf group by 1""",
)


def _coverage_inputs(spark, sf):
    raw = star.fact(spark, sf, "nu_ano")
    return star.fact(spark, sf, "nu_ano", "nt_ger"), raw


_COVERAGE = "c as (select nu_ano as ano, count(nt_ger) as validos, count(*) as total from fact group by 1)"
add(
    "r32_coverage",
    lambda spark, sf: r.coverage(*_coverage_inputs(spark, sf)),
    f"with {star.fact_sql()}, {_COVERAGE} select *, total - validos as sem_nota, round(validos * 100.0 / total, 1) as pct_validos from c",
)
add(
    "r32_coverage_summary",
    lambda spark, sf: r.coverage_summary(*_coverage_inputs(spark, sf)),
    f"""with {star.fact_sql()}, {_COVERAGE} select cast(sum(total) as bigint) as total_extraido, cast(sum(validos) as bigint) as total_validos,
    cast(sum(total) - sum(validos) as bigint) as total_sem_nota, round(sum(validos) * 100.0 / sum(total), 1) as pct_validos from c""",
)

# --- analysis ---
_COURSE_YEAR = "c as (select curso_nome as curso, nu_ano as ano, round(avg(nt_ger), 2) as media, count(*) as total from fact where nt_ger is not null and curso_nome is not null group by 1, 2)"
on_fact("r33_course_over_time", "curso_nome nu_ano nt_ger", r.course_over_time, f"{_COURSE_YEAR} select * from c")
on_fact(
    "r33_course_over_time_pivot", "curso_nome nu_ano nt_ger", lambda f: r.course_over_time_pivot(f, REAL),
    f"{_COURSE_YEAR} select curso, " + ", ".join(f'max(media) filter (where ano = {y}) as "{y}"' for y in REAL) + " from c group by 1",
)
on_fact(
    "r34_income_by_band", "qe_renda faixa_nota", r.income_by_band,
    """c as (select qe_renda, count(*) filter (where faixa_nota = 'baixo') as baixo, count(*) filter (where faixa_nota = 'medio') as medio,
    count(*) filter (where faixa_nota = 'alto') as alto, count(*) as total from fact where qe_renda is not null and faixa_nota is not null group by 1)
    select case qe_renda when 0 then 'Não decl.' when 1 then 'Até 1,5SM' when 2 then '1,5–3SM' when 3 then '3–4,5SM' end as nome,
    cast(qe_renda as varchar) as codigo, baixo, medio, alto, total, round(baixo * 100.0 / total, 1) as pct_baixo,
    round(medio * 100.0 / total, 1) as pct_medio, round(alto * 100.0 / total, 1) as pct_alto from c""",
)
on_fact(
    "r35_internet_access", "qe_acesso_internet nt_ger", r.internet_access,
    """select case qe_acesso_internet when 'A' then 'Não tem acesso' when 'B' then 'Raramente' when 'C' then 'Às vezes' when 'D' then 'Frequentemente' else 'Sempre' end as nome,
    qe_acesso_internet as codigo, count(*) as total, round(avg(nt_ger), 2) as media from fact where qe_acesso_internet is not null and nt_ger is not null group by 1, 2""",
)
on_fact(
    "r36_score_histogram", "nt_ger nu_ano", lambda f: r.score_histogram(f, REAL),
    "b as (select cast(unnest(range(0, 100, 10)) as int) as bucket), c as (select least(cast(floor(nt_ger / 10) * 10 as int), 90) as bucket, nu_ano, count(*) as n from fact where nt_ger is not null group by 1, 2) select b.bucket, b.bucket || '–' || (b.bucket + 9) as faixa, "
    + ", ".join(f'cast(coalesce(sum(n) filter (where nu_ano = {y}), 0) as bigint) as "{y}"' for y in REAL)
    + " from b left join c on c.bucket = b.bucket group by 1",
)
on_fact(
    "r37_confusion", "faixa_nota faixa_prevista", r.confusion,
    """c as (select faixa_nota as real, count(*) filter (where faixa_prevista = 'baixo') as baixo, count(*) filter (where faixa_prevista = 'medio') as medio,
    count(*) filter (where faixa_prevista = 'alto') as alto, count(*) as total_real, count(*) filter (where faixa_prevista = faixa_nota) as acerto
    from fact where faixa_nota is not null and faixa_prevista is not null group by 1)
    select *, round(acerto * 100.0 / total_real, 1) as pct_acerto, cast(sum(total_real) over () as bigint) as total_matriz from c""",
)

# --- two-way tables ---
def _sides(dim: str, extra: str = "") -> str:
    return f"""s as (select {dim}, round(avg(nt_ger) filter (where tipo_ies like '{PUB}'), 2) as publica,
    round(avg(nt_ger) filter (where tipo_ies not like '{PUB}'), 2) as privada, count(*) filter (where tipo_ies like '{PUB}') as n_pub,
    count(*) filter (where tipo_ies not like '{PUB}') as n_priv from fact where nt_ger is not null and tipo_ies is not null and {dim} is not null {extra} group by 1)"""


on_fact(
    "r38_income_by_network", "qe_renda tipo_ies nt_ger", lambda f: r.income_by_network(f, PUB),
    f"""{_sides('qe_renda')} select {INCOME} as nome, cast(qe_renda as varchar) as codigo, publica, privada, n_pub, n_priv,
    round(publica - privada, 2) as delta from s where publica > 0 and privada > 0""",
)
on_fact(
    "r39_course_by_network", "curso_nome tipo_ies nt_ger", lambda f: r.course_by_network(f, PUB),
    f"{_sides('curso_nome')} select curso_nome as curso, publica, privada, round(publica - privada, 2) as delta from s where publica > 0 and privada > 0",
)
_RACE_INCOME = f"""select {RACE} as raca, cast(qe_renda as varchar) as codigo, {INCOME} as nome, round(avg(nt_ger), 2) as media, count(*) as total
    from fact where nt_ger is not null and qe_raca_cor is not null and qe_renda is not null group by 1, 2, 3"""
on_fact("r40_race_by_income", "qe_raca_cor qe_renda nt_ger", r.race_by_income, _RACE_INCOME)
on_fact(
    "r40_race_by_income_nested", "qe_raca_cor qe_renda nt_ger",
    lambda f: r.race_by_income_nested(f).select(
        "raca", F.size("rendas").cast("bigint").alias("n"),
        F.array_join(F.transform("rendas", lambda x: F.concat_ws(":", x["codigo"], x["nome"], x["total"].cast("string"))), ";").alias("celulas"),
    ),
    f"c as ({_RACE_INCOME}) select raca, count(*) as n, string_agg(codigo || ':' || nome || ':' || total, ';' order by codigo) as celulas from c group by 1",
)
on_fact(
    "r41_funding_by_network", "qe_financiamento tipo_ies nt_ger", lambda f: r.funding_by_network(f, PUB),
    f"""{_sides('qe_financiamento')} select case qe_financiamento when 0 then 'Sem bolsa' when 1 then 'ProUni' when 2 then 'FIES' when 3 then 'ProUni+FIES'
    when 4 then 'Outro público' when 5 then 'Outro privado' end as nome, cast(qe_financiamento as varchar) as codigo, publica, privada from s""",
)
_COMPOSITION = f"""c as (select {INCOME} as nome, cast(qe_renda as varchar) as codigo, {RACE} as raca, count(*) as total from fact
    where qe_renda is not null and qe_raca_cor is not null and qe_renda <> 0 and qe_raca_cor <> 0 group by 1, 2, 3),
    p as (select *, round(total * 100.0 / sum(total) over (partition by codigo), 1) as pct from c)"""
on_fact("r42_race_within_income", "qe_renda qe_raca_cor", r.race_within_income, f"{_COMPOSITION} select * from p")
on_fact(
    "r42_race_within_income_pivot", "qe_renda qe_raca_cor", r.race_within_income_pivot,
    f"{_COMPOSITION} select nome, codigo, "
    + ", ".join(f"max(pct) filter (where raca = '{x}') as \"{x}\"" for x in ("Branca", "Preta", "Parda", "Amarela", "Indígena"))
    + " from p group by 1, 2",
)

# --- trends ---
_YEARS = f"y as (select unnest([{', '.join(map(str, REAL))}]) as ano, 'real' as tipo union all select unnest([{', '.join(map(str, PROJ))}]), 'projecao')"
_FIT = "regr_intercept(media, ano) as b0, regr_slope(media, ano) as b1, case when regr_syy(media, ano) = 0 then 1.0 else regr_r2(media, ano) end as r2"


def _trend(dim: str | None, where: str, cte: str = "") -> str:
    key = f"{dim[0]} as {dim[1]}, " if dim else ""
    name = dim[1] if dim else None
    group = "1, 2" if dim else "1"
    by = f"group by {name}" if dim else ""
    return f"""p as (select {key}nu_ano as ano, round(avg(nt_ger), 2) as media from fact where nt_ger is not null {where} group by {group}),
    f as (select {name + ', ' if dim else ''}{_FIT}, count(*) as n from p {by} having count(*) >= 3), {_YEARS},
    t as (select {'f.' + name + ', ' if dim else ''}y.ano, y.tipo, case when tipo = 'real' then p.media end as media,
    case when tipo = 'projecao' then round(b0 + b1 * y.ano, 2) end as projecao, round(b0, 4) as b0, round(b1, 4) as b1, round(r2, 4) as r2,
    round(r2, 4) >= 0.75 and {' and '.join(f'round(b0 + b1 * {q}, 2) between 20 and 100' for q in PROJ)} as confiavel
    from f cross join y left join p on p.ano = y.ano {f'and p.{name} = f.{name}' if dim else ''})"""


on_fact(
    "r43_overall_trend", "nu_ano nt_ger", lambda f: r.overall_trend(f, REAL, PROJ),
    _trend(None, "") + " select * exclude (confiavel) from t",
)
_COURSE_TREND = _trend(("curso_nome", "curso"), "and curso_nome is not null")
on_fact(
    "r44_course_trends", "curso_nome nu_ano nt_ger", lambda f: r.course_trends(f, REAL, PROJ),
    _COURSE_TREND + " select curso, ano, tipo, media, case when confiavel then projecao end as projecao, b0, b1, r2, confiavel from t",
)
_NETWORK_TREND = _trend((f"case when tipo_ies like '{PUB}' then 'Pública' else 'Privada' end", "rede"), "and tipo_ies is not null")
on_fact(
    "r45_network_trends", "tipo_ies nu_ano nt_ger", lambda f: r.network_trends(f, REAL, PROJ, PUB),
    _NETWORK_TREND + " select * exclude (confiavel) from t",
)
on_fact(
    "r45_network_trends_pivot", "tipo_ies nu_ano nt_ger", lambda f: r.network_trends_pivot(f, REAL, PROJ, PUB),
    _NETWORK_TREND + """ select ano, max(media) filter (where rede = 'Pública') as pub_real, max(media) filter (where rede = 'Privada') as prv_real,
    max(projecao) filter (where rede = 'Pública') as pub_proj, max(projecao) filter (where rede = 'Privada') as prv_proj from t group by 1""",
)
on_fact(
    "r46_trend_summary", "curso_nome nu_ano nt_ger", lambda f: r.trend_summary(f, REAL, PROJ),
    _COURSE_TREND.replace("p as", "p as", 1) + f""", m as (select count(distinct curso) filter (where confiavel) as a, count(distinct curso) filter (where not confiavel) as b from t),
    q as (select nu_ano as ano, round(avg(nt_ger), 2) as media from fact where nt_ger is not null group by 1), g as (select {_FIT} from q)
    select round(b1, 4) as tendencia_geral_b1, round(r2, 4) as tendencia_geral_r2, {', '.join(f'round(b0 + b1 * {y}, 2) as previsao_{y}' for y in PROJ)},
    m.a as cursos_confiaveis, m.b as cursos_nao_confiaveis from g, m""",
)

# --- binary crossing, cards, correlation, profile ---
on_fact(
    "r47_binary_split", "sexo nt_ger", lambda f: r.binary_split(f, "sexo"),
    """c as (select case sexo when 'F' then 'Feminino' when 'M' then 'Masculino' else sexo end as nome, sexo as codigo, count(*) as total, round(avg(nt_ger), 2) as media_nota
    from fact where nt_ger is not null and sexo is not null group by 1, 2) select *, round(total * 100.0 / sum(total) over (), 1) as pct from c""",
)
on_fact(
    "r47_binary_by_race", "sexo qe_raca_cor nt_ger", lambda f: r.binary_by_race(f, "sexo", ("F", "O")),
    f"""select {RACE} as raca, cast(qe_raca_cor as varchar) as codigo, round(avg(nt_ger) filter (where sexo = 'F'), 2) as media_f, count(*) filter (where sexo = 'F') as total_f,
    round(avg(nt_ger) filter (where sexo = 'O'), 2) as media_o, count(*) filter (where sexo = 'O') as total_o
    from fact where nt_ger is not null and sexo is not null and qe_raca_cor is not null group by 1, 2""",
)
on_fact(
    "r48_inequality_cards", "qe_renda renda_nome nt_ger", r.inequality_cards,
    """c as (select qe_renda, round(avg(nt_ger), 2) as media from fact where nt_ger is not null and qe_renda is not null group by 1)
    select min_by(media, qe_renda) as primeiro, max_by(media, qe_renda) as ultimo, round(max_by(media, qe_renda) / min_by(media, qe_renda), 1) as fator from c""",
)
on_fact(
    "r48_best_and_largest_race", "qe_raca_cor nt_ger", r.best_and_largest_race,
    f"""rows_ as ({_RACE_ROWS}), p as (select *, round(total * 100.0 / sum(total) over (), 1) as pct from rows_)
    select max_by(nome, media_nota) as melhor_nome, max(media_nota) as melhor_media, max_by(nome, total) as maior_nome, max(total) as maior_total, max_by(pct, total) as maior_pct from p""",
)
on_fact(
    "r48_largest_network_gap", "qe_renda tipo_ies nt_ger", lambda f: r.largest_network_gap(f, PUB),
    f"{_sides('qe_renda')} select max(abs(round(publica - privada, 2))) as max_abs_delta from s where publica > 0 and privada > 0",
)
on_fact(
    "r49_race_performance", "qe_raca_cor nt_ger", r.race_performance,
    f"""rows_ as ({_RACE_ROWS}) select *, round(total * 100.0 / sum(total) over (), 1) as pct,
    round(least(media_nota / 90.0::double * 100.0::double, 100.0::double), 2) as desempenho_relativo from rows_""",
)
on_fact(
    "r50_income_score_correlation", "qe_renda nt_ger", r.income_score_correlation,
    """select count(*) filter (where qe_renda is not null and nt_ger is not null) as n, round(corr(qe_renda, nt_ger), 6) as r,
    round(corr(qe_renda, nt_ger) * corr(qe_renda, nt_ger), 6) as r2 from fact""",
)
on_fact("r51_rows_by_year", "nu_ano", lambda f: r.rows_by(f, "nu_ano"), "select nu_ano, count(*) as total from fact group by 1")
on_fact("r51_rows_by_course", "curso_nome", lambda f: r.rows_by(f, "curso_nome"), "select curso_nome, count(*) as total from fact group by 1")
_PROFILED = "nt_ger uf_sigla tipo_ies modalidade qe_renda qe_estado_civil qe_escola_em qe_financiamento faixa_prevista cluster_id"
on_fact(
    "r51_nulls_by_column", _PROFILED, r.nulls_by_column,
    "select * from ("
    + " union all ".join(f"select '{c}' as coluna, count(*) - count({c}) as nulos from fact" for c in _PROFILED.split())
    + ") t",
)

# --- the same reports under the dashboard filters ---
on_fact(
    "flt1_income_filtered", f"{FILTER_COLUMNS} qe_renda renda_nome nt_ger", lambda f: r.income(f, FILTERS),
    f"select qe_renda, renda_nome as nome, count(*) as total, round(avg(nt_ger), 2) as media from fact where nt_ger is not null and {WHERE} group by 1, 2",
)
on_fact(
    "flt1_race_filtered", f"{FILTER_COLUMNS} qe_raca_cor nt_ger", lambda f: r.race(f, FILTERS),
    f"rows_ as ({_RACE_ROWS.replace('where', 'where ' + WHERE + ' and')}) select *, round(total * 100.0 / sum(total) over (), 1) as pct from rows_",
)
on_fact(
    "flt1_all_six", "nu_ano co_grupo tipo_ensino co_regiao co_uf co_municipio nt_ger",
    lambda f: r.score_overview(
        f.withColumns({"nt_fg": F.col("nt_ger"), "nt_ce": F.col("nt_ger")}),
        {"ano": "1997", "curso": "4004", "tipo": "Bacharelado", "regiao": "", "uf": "3", "municipio": None}, 6,
    ),
    """select round(avg(nt_ger), 6) as media_nt_ger, round(avg(nt_ger), 6) as media_nt_fg, round(avg(nt_ger), 6) as media_nt_ce,
    min(nt_ger) as min_nt_ger, max(nt_ger) as max_nt_ger from fact where nu_ano = 1997 and co_grupo = 4004 and tipo_ensino = 'Bacharelado' and co_uf = 3""",
)


# --- R24: the stored metrics, split back into sections ---
def _metrics(spark, sf):
    f = star.fact(spark, sf, "faixa_nota", "faixa_prevista", "nt_fg", "nt_ce", "nt_ger")
    counts = evaluate.confusion_counts(f, "faixa_nota", "faixa_prevista")
    importances = f.agg(
        *[F.abs(F.corr(c, "nt_ger")).alias(c) for c in ("nt_fg", "nt_ce")]
    ).unpivot([], ["nt_fg", "nt_ce"], "feature", "valor")
    return evaluate.metrics_table(importances, counts)


CELLS = """cells as (select a.c as real, b.c as previsto, (select count(*) from fact where faixa_nota = a.c and faixa_prevista = b.c) as total
    from (select unnest(['baixo', 'medio', 'alto']) as c) a, (select unnest(['baixo', 'medio', 'alto']) as c) b)"""
CLASS_REPORT = CELLS + """, k as (select c as classe, sum(total) filter (where real = c and previsto = c) as tp, sum(total) filter (where real = c) as n_real,
    sum(total) filter (where previsto = c) as n_prev from cells, (select unnest(['baixo', 'medio', 'alto']) as c) z group by 1),
    per_class as (select classe, tp / n_prev as precision, tp / n_real as recall, 2.0::double * tp / (n_real + n_prev) as f1, cast(n_real as bigint) as support from k)"""
on_fact_sql = f"WITH {star.fact_sql()}, "
add(
    "r24_metric_sections",
    lambda spark, sf: evaluate.metric_classes(_metrics(spark, sf)).select(
        "classe", "f1", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], "support"
    ),
    on_fact_sql + CLASS_REPORT + "select classe, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall, support from per_class",
)
add(
    "r24_metric_importances", lambda spark, sf: evaluate.metric_importances(_metrics(spark, sf)),
    on_fact_sql[:-2] + " select 'nt_fg' as feature, round(abs(corr(nt_fg, nt_ger)), 6) as valor from fact union all select 'nt_ce', round(abs(corr(nt_ce, nt_ger)), 6) from fact",
)
add(
    "r24_metric_accuracy", lambda spark, sf: evaluate.metric_accuracy(_metrics(spark, sf)),
    on_fact_sql + CELLS + " select round(sum(total) filter (where real = previsto) / sum(total), 6) as acuracia from cells",
)
add(
    "r24_metric_matrix", lambda spark, sf: evaluate.metric_matrix(_metrics(spark, sf)),
    on_fact_sql + CELLS + " select * from cells",
)
add(
    "r24_feature_importance", lambda spark, sf: r.feature_importance(_metrics(spark, sf)),
    on_fact_sql[:-2] + " select 'nt_fg' as nome, round(round(abs(corr(nt_fg, nt_ger)), 6) * 100, 1) as percentual from fact union all select 'nt_ce', round(round(abs(corr(nt_ce, nt_ger)), 6) * 100, 1) from fact",
)
on_fact(
    "r43_yearly_change", "nu_ano nt_ger", r.yearly_change,
    """g as (select nu_ano as ano, count(*) as total, round(avg(nt_ger), 2) as media from fact where nt_ger is not null group by 1)
    select *, round(media - first_value(media) over w, 2) as delta_referencia, round(media - lag(media) over w, 2) as delta_anterior,
    round((media - first_value(media) over w) * 100 / first_value(media) over w, 1) as pct_referencia from g window w as (order by ano)""",
)

# --- order as data: every ordered report again with the place of its rows ---
_CODE = "try_cast(codigo as bigint) nulls last, codigo nulls last"
for _name, _order in {
    "r03_by_band": "faixa_nota nulls last",
    "r04_by_year": "nu_ano nulls last",
    "r05_by_course": "total desc nulls first, co_grupo nulls last",
    "r06_by_region": "total desc nulls first, co_regiao nulls last",
    "r07_by_institution_type": "media desc nulls first, tipo_ies nulls last",
    "r08_income": "qe_renda nulls last",
    "r09_school": "qe_escola_em nulls last",
    "r10_works": "cast(nome as bigint) nulls last",
    "r11_study_hours": "cast(nome as bigint) nulls last",
    "r12_institution_type": "media desc nulls first, nome nulls last",
    "r14_funding": _CODE,
    "r15_marital_status": _CODE,
    "r16_scores_by_teaching_type": "tipo",
    "r17_race": _CODE,
    "r18_habits": f"variavel, {_CODE}",
    "r20_study_against_work": "posicao",
    "r21_projection_points": "cluster_id, total desc, x, y",
    "r22_cluster_statistics": "cluster_id nulls last",
    "r23_cluster_bands": "cluster_id nulls last, faixa_nota nulls last",
    "r25_state_options": "sigla",
    "r25_course_options": "co_grupo nulls last",
    "r25_type_options": "tipo_ensino",
    "r28_modality_by_year": "ano",
    "r29_network_by_year": "ano",
    "r30_by_state": "uf",
    "r31_by_region_of_state": "total desc, regiao",
    "r32_coverage": "ano",
    "r33_course_over_time": "curso, ano",
    "r34_income_by_band": _CODE,
    "r35_internet_access": _CODE,
    "r36_score_histogram": "bucket",
    "r38_income_by_network": _CODE,
    "r39_course_by_network": "delta desc nulls first, curso",
    "r40_race_by_income": f"raca, {_CODE}",
    "r41_funding_by_network": _CODE,
    "r42_race_within_income": f"{_CODE}, raca",
    "r43_overall_trend": "ano",
    "r44_course_trends": "curso, ano",
    "r45_network_trends": "rede, ano",
}.items():
    add_in_order(_name, _order)


def _funding_of_eleven_codes(f):
    """Codes 0 to 10: the tenth comes after the ninth, not after the first."""
    return in_place(r.funding(f.withColumn("qe_financiamento", (F.col("l_partkey") % 11).cast("int"))))


on_fact(
    "r14_eleven_codes_in_order", "l_partkey qe_financiamento nt_ger", _funding_of_eleven_codes,
    """c as (select l_partkey % 11 as k, count(*) as total, round(avg(nt_ger), 2) as media from fact where nt_ger is not null group by 1)
    select case k when 0 then 'Sem financiamento' when 1 then 'ProUni' when 2 then 'FIES' when 3 then 'ProUni + FIES' when 4 then 'Outro público' when 5 then 'Outro privado' else cast(k as varchar) end as nome,
    cast(k as varchar) as codigo, total, media, cast(k + 1 as int) as ordem from c""",
)

# --- bundles: every report of a bundle from its one pass equals the single report ---
for _bundle, _columns, _reports in (
    ("estatisticas", "nu_ano co_grupo curso_nome co_regiao regiao_nome tipo_ies faixa_nota nt_ger nt_fg nt_ce",
     {"distribuicao_faixa": "r03_by_band", "total_estudantes": "r01_total_students"}),
    ("socioeconomico", "nu_ano qe_renda renda_nome qe_escola_em escola_em_nome qe_trabalha qe_horas_estudo tipo_ies qe_financiamento qe_estado_civil tipo_ensino nt_ger nt_fg nt_ce",
     {"renda": "r08_income_in_order", "escola": "r09_school_in_order", "trabalha": "r10_works_in_order", "estudo": "r11_study_hours_in_order",
      "tipo_ies": "r12_institution_type_in_order", "evolucao_renda": "r13_income_over_time", "financiamento": "r14_funding_in_order",
      "estado_civil": "r15_marital_status_in_order", "nt_por_tipo": "r16_scores_by_teaching_type_in_order",
      "comparativo_habitos": "r20_study_against_work_in_order", "desigualdade": "r48_inequality_cards"}),
):
    for _report, _single in _reports.items():
        def _from_bundle(spark, sf, bundle=_bundle, report=_report, columns=_columns, placed=_single.endswith("_in_order")):
            rows = getattr(endpoints, bundle)(star.fact(spark, sf, *columns.split()))[report]
            return in_place(rows) if placed else rows

        add(f"{_single.split('_')[0]}_{_report}_of_bundle", _from_bundle, ORACLE[_single])

# --- bundles from the stored cube: the single reports, also under filters, without reading the rows ---
_CUBE_COLUMNS = (
    "nu_ano co_grupo curso_nome co_regiao regiao_nome co_uf co_municipio tipo_ies tipo_ensino faixa_nota qe_renda renda_nome qe_escola_em escola_em_nome "
    "qe_trabalha qe_horas_estudo qe_financiamento qe_estado_civil nt_ger nt_fg nt_ce"
)
_CHOSEN = {"ano": "1996", "regiao": "2"}
_stored_cubes: dict[tuple[str, str], str] = {}


def _stored_cube(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored_cubes:
        path = scratch_path(spark, "cube")
        cube.write(star.fact(spark, sf, *[c for c in _CUBE_COLUMNS.split() if c in star.COLUMNS]), path)
        _stored_cubes[key] = path
    return cube.read(spark, _stored_cubes[key])


for _bundle, _reports in (
    (lambda stored, chosen: cube.statistics(stored, chosen, 6),
     {"total_estudantes": "r01_total_students", "distribuicao_faixa": "r03_by_band", "distribuicao_ano": "r04_by_year",
                      "distribuicao_curso": "r05_by_course", "distribuicao_regiao": "r06_by_region", "distribuicao_tipo_ies": "r07_by_institution_type"}),
    (lambda stored, chosen: endpoints.socioeconomico(None, chosen, stored),
     {"renda": "r08_income", "escola": "r09_school", "trabalha": "r10_works", "estudo": "r11_study_hours", "tipo_ies": "r12_institution_type",
                        "evolucao_renda": "r13_income_over_time", "financiamento": "r14_funding", "estado_civil": "r15_marital_status",
                        "nt_por_tipo": "r16_scores_by_teaching_type"}),
):
    for _report, _single in _reports.items():
        def _from_cube(spark, sf, bundle=_bundle, report=_report):
            return bundle(_stored_cube(spark, sf), None)[report]

        def _from_filtered_cube(spark, sf, bundle=_bundle, report=_report):
            return bundle(_stored_cube(spark, sf), _CHOSEN)[report]

        _start = f"WITH {star.fact_sql()}"
        _rest = ORACLE[_single].removeprefix(_start).replace(" from fact", " from chosen")
        add(f"{_single}_of_cube", _from_cube, ORACLE[_single])
        add(f"{_single}_of_filtered_cube", _from_filtered_cube, f"{_start}, chosen as (select * from fact where nu_ano = 1996 and co_regiao = 2) {_rest}")
