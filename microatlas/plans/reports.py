"""The named reports. Each takes the fact table and returns one small table.

Reports that accept ``filters`` take the six dashboard filters (``ano``, ``curso``,
``tipo``, ``regiao``, ``uf``, ``municipio``); absent ones are ignored. Null order is
ascending-last and descending-first throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import (
    bucket,
    bucket_name,
    class_order,
    code_order,
    label,
    mean,
    network,
    one_of_or_rest,
    percent,
    percent_of,
    point_radius,
    rounded,
    to_ceiling,
)
from microatlas.operators import aggregates as agg
from microatlas.operators import evaluate
from microatlas.operators.filters import both_present, exclude, reliable, require, with_filters
from microatlas.operators.labels import dimension, lookup
from microatlas.operators.reshape import (
    densify,
    nested_cells,
    pivot_count,
    pivot_value,
    stack_columns,
    two_sides,
)
from microatlas.operators.trend import fit_line, predict, trend

Filters = Mapping[str, object] | None
SCORE = "nt_ger"
PUBLIC, PRIVATE = "Pública", "Privada"
NETWORK_SIDES = ((PUBLIC, "publica", "n_pub"), (PRIVATE, "privada", "n_priv"))


def _asc(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def _desc(column: str) -> Column:
    return F.col(column).desc_nulls_first()


def _scored(fact: DataFrame, filters: Filters = None, *needed: str) -> DataFrame:
    return require(with_filters(fact, filters), SCORE, *needed)


# --- statistics --------------------------------------------------------------------------
def total_students(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return agg.total(with_filters(fact, filters))


def score_overview(fact: DataFrame, filters: Filters = None, digits: int | None = None) -> DataFrame:
    return agg.overview(with_filters(fact, filters), ["nt_ger", "nt_fg", "nt_ce"], SCORE, digits)


def by_band(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return agg.count_present(with_filters(fact, filters), ["faixa_nota"]).orderBy(*_asc("faixa_nota"))


def _present(fact, filters, dims, digits) -> DataFrame:
    return agg.count_present(
        with_filters(fact, filters), dims, dims[0], {"media": SCORE}, digits
    )


def by_year(fact: DataFrame, filters: Filters = None, digits: int | None = None) -> DataFrame:
    return _present(fact, filters, ["nu_ano"], digits).orderBy(*_asc("nu_ano"))


def by_course(fact: DataFrame, filters: Filters = None, digits: int | None = None) -> DataFrame:
    return _present(fact, filters, ["co_grupo", "curso_nome"], digits).orderBy(
        _desc("total"), *_asc("co_grupo")
    )


def by_region(fact: DataFrame, filters: Filters = None, digits: int | None = None) -> DataFrame:
    return _present(fact, filters, ["co_regiao", "regiao_nome"], digits).orderBy(
        _desc("total"), *_asc("co_regiao")
    )


def by_institution_type(fact: DataFrame, filters: Filters = None, digits: int | None = None) -> DataFrame:
    return _present(fact, filters, ["tipo_ies"], digits).orderBy(_desc("media"), *_asc("tipo_ies"))


STATISTICS_SETS = {
    "ano": ["nu_ano"],
    "curso": ["co_grupo", "curso_nome"],
    "regiao": ["co_regiao", "regiao_nome"],
    "tipo_ies": ["tipo_ies"],
    "faixa": ["faixa_nota"],
}


def statistics_in_one_scan(fact: DataFrame, filters: Filters = None, digits: int | None = 2) -> DataFrame:
    """Year, course, region, institution type and band from one pass over the rows."""
    return agg.group_sets(with_filters(fact, filters), STATISTICS_SETS, {"media": SCORE}, digits, cube=True)


def statistics_cube(fact: DataFrame, filters: Filters = None) -> DataFrame:
    """Rows counted and summed per combination of all keys of the statistics.

    The keys are coded and few, so this is small however many rows there are, and every
    statistic can be cut from it.
    """
    columns = list(dict.fromkeys(c for keys in STATISTICS_SETS.values() for c in keys))
    scores = ("nt_ger", "nt_fg", "nt_ce")
    return with_filters(fact, filters).groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in scores],
        *[F.count(c).alias(f"n_{c}") for c in scores],
        F.min(SCORE).alias("low"),
        F.max(SCORE).alias("high"),
    )


def statistics_of_cube(cube: DataFrame, digits: int | None = None) -> dict[str, DataFrame]:
    """The statistics reports, cut from a cube: the same columns, order and null groups
    as the single reports."""

    def media(c: str) -> Column:
        return rounded(F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")), digits)

    def cut(report: str, *measures: Column) -> DataFrame:
        keys = STATISTICS_SETS[report]
        # Counting the first key shows 0 for its null group, as the single reports do.
        present = F.coalesce(F.sum(F.when(F.col(keys[0]).isNotNull(), F.col("n"))), F.lit(0))
        return cube.groupBy(*keys).agg(present.alias("total"), *measures)

    score = media(SCORE).alias("media")
    return {
        "total_estudantes": cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")),
        "media_notas": cube.agg(
            *[media(c).alias(f"media_{c}") for c in ("nt_ger", "nt_fg", "nt_ce")],
            F.min("low").alias(f"min_{SCORE}"), F.max("high").alias(f"max_{SCORE}"),
        ),
        "distribuicao_faixa": cut("faixa").orderBy(*_asc("faixa_nota")),
        "distribuicao_ano": cut("ano", score).orderBy(*_asc("nu_ano")),
        "distribuicao_curso": cut("curso", score).orderBy(_desc("total"), *_asc("co_grupo")),
        "distribuicao_regiao": cut("regiao", score).orderBy(_desc("total"), *_asc("co_regiao")),
        "distribuicao_tipo_ies": cut("tipo_ies", score).orderBy(_desc("media"), *_asc("tipo_ies")),
    }


# --- socioeconomic ------------------------------------------------------------------------
def income(fact: DataFrame, filters: Filters = None) -> DataFrame:
    """The undeclared group is kept, in last place."""
    return (
        agg.group_mean(_scored(fact, filters), ["qe_renda", "renda_nome"], SCORE)
        .orderBy(*_asc("qe_renda"))
        .select("qe_renda", F.col("renda_nome").alias("nome"), "total", "media")
    )


def school(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return (
        agg.group_mean(
            _scored(fact, filters, "qe_escola_em"), ["qe_escola_em", "escola_em_nome"], SCORE
        )
        .orderBy(*_asc("qe_escola_em"))
        .select("qe_escola_em", F.col("escola_em_nome").alias("nome"), "total", "media")
    )


def _by_code(fact: DataFrame, filters: Filters, column: str) -> DataFrame:
    return (
        agg.group_mean(_scored(fact, filters, column), [column], SCORE)
        .orderBy(*_asc(column))
        .select(F.col(column).cast("string").alias("nome"), "total", "media")
    )


def works(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return _by_code(fact, filters, "qe_trabalha")


def study_hours(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return _by_code(fact, filters, "qe_horas_estudo")


def institution_type(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return (
        agg.group_mean(_scored(fact, filters, "tipo_ies"), ["tipo_ies"], SCORE)
        .withColumnRenamed("tipo_ies", "nome")
        .orderBy(_desc("media"), *_asc("nome"))
    )


def income_over_time(fact: DataFrame, filters: Filters = None) -> DataFrame:
    groups = agg.group_mean(
        _scored(fact, filters, "renda_nome"), ["nu_ano", "qe_renda", "renda_nome"], SCORE
    )
    return groups.orderBy(*_asc("nu_ano", "qe_renda")).select(
        F.col("nu_ano").cast("int").alias("ano"), F.col("renda_nome").alias("renda"), "media"
    )


def income_over_time_pivot(
    fact: DataFrame, filters: Filters = None, incomes: Sequence[str] = tuple(config.INCOME_NAMES.values())
) -> DataFrame:
    return pivot_value(income_over_time(fact, filters), ["ano"], "renda", incomes, "media").orderBy("ano")


def _labelled(
    fact: DataFrame, filters: Filters, column: str, names: Mapping[str, str], media: str = "media"
) -> DataFrame:
    groups = agg.group_mean(_scored(fact, filters, column), [column], SCORE, media=media)
    code = F.col(column).cast("string")
    return groups.select(
        label(code, names, code).alias("nome"), code.alias("codigo"), "total", media
    ).orderBy(*code_order("codigo"))


def funding(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return _labelled(fact, filters, "qe_financiamento", config.FUNDING_NAMES)


def marital_status(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return _labelled(fact, filters, "qe_estado_civil", config.MARITAL_NAMES)


def scores_by_teaching_type(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return (
        agg.group_means(
            _scored(fact, filters, "tipo_ensino"),
            ["tipo_ensino"],
            {"media_ger": "nt_ger", "media_fg": "nt_fg", "media_ce": "nt_ce"},
        )
        .withColumnRenamed("tipo_ensino", "tipo")
        .orderBy("tipo")
    )


SOCIOECONOMIC_SETS = {
    "renda": ["qe_renda", "renda_nome"],
    "escola": ["qe_escola_em", "escola_em_nome"],
    "trabalha": ["qe_trabalha"],
    "estudo": ["qe_horas_estudo"],
    "tipo_ies": ["tipo_ies"],
    "evolucao_renda": ["nu_ano", "qe_renda", "renda_nome"],
    "financiamento": ["qe_financiamento"],
    "estado_civil": ["qe_estado_civil"],
    "nt_por_tipo": ["tipo_ensino"],
}


def socioeconomic_in_one_scan(fact: DataFrame, filters: Filters = None) -> DataFrame:
    """All socioeconomic reports from one pass over the rows; only income keeps its
    undeclared group."""
    return agg.group_sets(
        _scored(fact, filters),
        SOCIOECONOMIC_SETS,
        {"media": "nt_ger", "media_fg": "nt_fg", "media_ce": "nt_ce"},
        known=set(SOCIOECONOMIC_SETS) - {"renda"},
    )


def socioeconomic_of_cells(cells: DataFrame) -> dict[str, DataFrame]:
    """The socioeconomic reports, cut from the stacked groups: the same columns, order
    and null groups as the single reports."""

    def cut(report: str) -> DataFrame:
        return cells.filter(F.col("relatorio") == report)

    def coded(report: str, column: str) -> DataFrame:
        return cut(report).orderBy(*_asc(column)).select(F.col(column).cast("string").alias("nome"), "total", "media")

    def named(report: str, column: str, names: Mapping[str, str]) -> DataFrame:
        code = F.col(column).cast("string")
        rows = cut(report).select(label(code, names, code).alias("nome"), code.alias("codigo"), "total", "media")
        return rows.orderBy(*code_order("codigo"))

    income_rows = cut("renda").orderBy(*_asc("qe_renda")).select(
        "qe_renda", F.col("renda_nome").alias("nome"), "total", "media"
    )
    levels = [
        coded(report, column).select(F.col("nome").alias("nivel"), F.col("media").alias(name))
        for report, column, name in (("trabalha", "qe_trabalha", "trabalho"), ("estudo", "qe_horas_estudo", "estudo"))
    ]
    return {
        "renda": income_rows,
        "escola": cut("escola").orderBy(*_asc("qe_escola_em")).select(
            "qe_escola_em", F.col("escola_em_nome").alias("nome"), "total", "media"
        ),
        "trabalha": coded("trabalha", "qe_trabalha"),
        "estudo": coded("estudo", "qe_horas_estudo"),
        "tipo_ies": cut("tipo_ies").select(F.col("tipo_ies").alias("nome"), "total", "media").orderBy(_desc("media"), *_asc("nome")),
        "evolucao_renda": cut("evolucao_renda").filter(F.col("renda_nome").isNotNull()).orderBy(*_asc("nu_ano", "qe_renda")).select(
            F.col("nu_ano").cast("int").alias("ano"), F.col("renda_nome").alias("renda"), "media"
        ),
        "financiamento": named("financiamento", "qe_financiamento", config.FUNDING_NAMES),
        "estado_civil": named("estado_civil", "qe_estado_civil", config.MARITAL_NAMES),
        "nt_por_tipo": cut("nt_por_tipo").select(
            F.col("tipo_ensino").alias("tipo"), "total", F.col("media").alias("media_ger"), F.col("media_fg"), F.col("media_ce")
        ).orderBy("tipo"),
        "comparativo_habitos": agg.align_by_rank(*levels, "nivel", "nivel", "trabalho", "estudo", config.INTENSITY_NAMES),
        "desigualdade": agg.last_over_first(income_rows, "media", "qe_renda"),
    }


# --- race and habits ------------------------------------------------------------------------
def race(fact: DataFrame, filters: Filters = None) -> DataFrame:
    groups = _labelled(fact, filters, "qe_raca_cor", config.RACE_NAMES, "media_nota")
    return agg.share_of_total(groups).orderBy(*code_order("codigo"))


def race_performance(fact: DataFrame, filters: Filters = None) -> DataFrame:
    """Race report with each mean relative to the ceiling score."""
    return race(fact, filters).withColumn(
        "desempenho_relativo", F.round(to_ceiling("media_nota"), 2)
    )


def habits(
    fact: DataFrame,
    filters: Filters = None,
    names: Mapping[str, Mapping[str, str]] = config.HABIT_NAMES,
) -> DataFrame:
    """All habit questions stacked, from one scan.

    Shares are of all filtered rows, unanswered ones included; answers without a
    label are dropped after the shares are taken.
    """
    rows = stack_columns(_scored(fact, filters), [SCORE], list(names))
    groups = agg.group_mean(rows, ["variavel", "categoria"], SCORE, total="total", media="media_nota")
    everyone = F.sum("total").over(W.partitionBy("variavel"))
    shares = groups.withColumn("pct", percent(F.col("total"), everyone))
    known = F.array(
        *[
            F.struct(
                F.lit(v).alias("variavel"), F.lit(config.HABIT_TITLES.get(v, v)).alias("label"),
                F.lit(code).alias("categoria"), F.lit(text).alias("nome"),
            )
            for v, codes in names.items()
            for code, text in codes.items()
        ]
    )
    labels = fact.sparkSession.range(0, 1, 1, 1).select(F.inline(known))
    return (
        shares.join(labels, ["variavel", "categoria"], "inner")
        .select(
            "variavel", "label", F.col("categoria").alias("codigo"), F.col("nome").alias("categoria"),
            "total", "pct", F.coalesce("media_nota", F.lit(0.0)).alias("media_nota"),
        )
        .orderBy("variavel", *code_order("codigo"))
    )


def habit_cards(
    fact: DataFrame, cards: Mapping[str, tuple[str, str]], filters: Filters = None
) -> DataFrame:
    """Share of one category per card (``name -> (question, category)``), 0 when absent."""
    rows = habits(fact, filters)
    return rows.agg(
        *[
            F.coalesce(
                F.max(F.when((F.col("variavel") == v) & (F.col("categoria") == c), F.col("pct"))),
                F.lit(0.0),
            ).alias(name)
            for name, (v, c) in cards.items()
        ]
    )


def study_against_work(
    fact: DataFrame, filters: Filters = None, levels: Sequence[str] = config.INTENSITY_NAMES
) -> DataFrame:
    """The i-th study level next to the i-th work level."""
    work = works(fact, filters).select(F.col("nome").alias("nivel"), F.col("media").alias("trabalho"))
    study = study_hours(fact, filters).select(F.col("nome").alias("nivel"), F.col("media").alias("estudo"))
    return agg.align_by_rank(work, study, "nivel", "nivel", "trabalho", "estudo", levels)


# --- clusters and models -----------------------------------------------------------------------
def projection_points(fact: DataFrame, filters: Filters = None) -> DataFrame:
    """Equal coordinates folded into one point per cluster."""
    rows = require(with_filters(fact, filters), "pca_x", "pca_y", "cluster_id")
    points = agg.group_mean(
        rows,
        [F.round("pca_x", 4).alias("x"), F.round("pca_y", 4).alias("y"), F.col("cluster_id")],
        SCORE,
        media="media_nota",
    )
    return points.withColumn("r", F.round(point_radius("total"), 6)).orderBy(
        "cluster_id", _desc("total"), "x", "y"
    )


def cluster_statistics(fact: DataFrame, filters: Filters = None, digits: int | None = None) -> DataFrame:
    return agg.count_present(
        with_filters(fact, filters),
        ["cluster_id"],
        "cluster_id",
        {"media_ger": "nt_ger", "media_fg": "nt_fg", "media_ce": "nt_ce"},
        digits,
    ).orderBy(*_asc("cluster_id"))


def cluster_radar(fact: DataFrame, filters: Filters = None) -> DataFrame:
    stats = cluster_statistics(fact, filters)
    return stats.select(
        F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")).alias("cluster"),
        *[
            F.round(F.coalesce(c, F.lit(0.0)), 1).alias(c)
            for c in ("media_ger", "media_fg", "media_ce")
        ],
    )


def cluster_bands(fact: DataFrame, filters: Filters = None) -> DataFrame:
    return agg.count_present(
        with_filters(fact, filters), ["cluster_id", "faixa_nota"], "faixa_nota"
    ).orderBy(*_asc("cluster_id", "faixa_nota"))


def feature_importance(metrics: DataFrame) -> DataFrame:
    """Stored importances with readable names and percents."""
    rows = evaluate.metric_importances(metrics)
    return rows.select(
        label("feature", config.FEATURE_NAMES, F.col("feature")).alias("nome"),
        percent_of("valor").alias("percentual"),
    )


# --- filter options ----------------------------------------------------------------------------
def state_options(fact: DataFrame, region=None) -> DataFrame:
    """Distinct states, optionally of one region."""
    rows = require(fact, "uf_sigla")
    if region not in (None, ""):
        rows = rows.filter(F.col("co_regiao") == F.lit(int(region)))
    return (
        rows.select("co_regiao", "co_uf", F.col("uf_sigla").alias("sigla"), F.col("uf_nome").alias("nome"))
        .distinct()
        .orderBy("sigla")
    )


def course_options(fact: DataFrame) -> DataFrame:
    return (
        require(fact, "curso_nome")
        .select("co_grupo", F.col("curso_nome").alias("nome"))
        .distinct()
        .orderBy(*_asc("co_grupo"))
    )


def type_options(fact: DataFrame) -> DataFrame:
    return require(fact, "tipo_ensino").select("tipo_ensino").distinct().orderBy("tipo_ensino")


def municipality_codes(fact: DataFrame, state) -> DataFrame:
    """Distinct municipalities of a state."""
    rows = require(fact.filter(F.col("co_uf") == F.lit(int(state))), "co_municipio")
    return rows.select("co_municipio").distinct()


def municipality_options(fact: DataFrame, municipalities: DataFrame, state) -> DataFrame:
    """Municipalities of a state, named where the dimension knows them.

    Distinct codes first, so only they meet the dimension.
    """
    named = lookup(
        municipality_codes(fact, state), municipalities, "co_municipio", "co_municipio", "nome", "nome",
        F.col("co_municipio").cast("string"),
    )
    return named.orderBy(F.collate("nome", "UNICODE"))


# --- overview ------------------------------------------------------------------------------------
def modality_by_year(fact: DataFrame, value: str = "Presencial") -> DataFrame:
    side = one_of_or_rest(F.coalesce("modalidade", F.lit(config.UNKNOWN_MODALITY)), value, "p", "r")
    counts = agg.conditional_counts(
        fact, ["nu_ano"], {"presencial": side == "p", "ead_nd": side == "r"}
    )
    return counts.select(
        F.col("nu_ano").alias("ano"), "presencial", "ead_nd",
        (F.col("presencial") + F.col("ead_nd")).alias("total"),
    ).orderBy("ano")


def network_by_year(fact: DataFrame, pattern: str = config.PUBLIC_PATTERN) -> DataFrame:
    side = network("tipo_ies", pattern)
    counts = agg.conditional_counts(
        require(fact, "tipo_ies"), ["nu_ano"], {"publica": side == PUBLIC, "privada": side == PRIVATE}
    ).withColumn("total", F.col("publica") + F.col("privada"))
    return counts.select(
        F.col("nu_ano").alias("ano"), "publica", "privada", "total",
        percent(F.col("publica"), F.col("total")).alias("pct_pub"),
        percent(F.col("privada"), F.col("total")).alias("pct_priv"),
    ).orderBy("ano")


def _region_of_state(fact: DataFrame, regions: DataFrame | None) -> DataFrame:
    if regions is not None:
        return regions
    return dimension(fact.sparkSession, config.REGION_OF_STATE, "uf", "regiao")


def by_state(fact: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Count and mean per state, with the region derived from the state."""
    groups = agg.group_mean(_scored(fact, None, "uf_sigla"), ["uf_sigla", "uf_nome"], SCORE).select(
        F.col("uf_sigla").alias("uf"), F.col("uf_nome").alias("nome"), "total", "media"
    )
    return lookup(
        groups, _region_of_state(fact, regions), "uf", "uf", "regiao", "regiao", config.UNKNOWN_REGION
    ).orderBy("uf")


def by_region_of_state(
    fact: DataFrame, regions: DataFrame | None = None, mean_of_rounded: bool = False
) -> DataFrame:
    """Count and mean per derived region, largest first.

    The mean is exact; ``mean_of_rounded`` weighs the already rounded state means.
    """
    if mean_of_rounded:
        return agg.weighted_mean(by_state(fact, regions), ["regiao"], "media", "total").orderBy(
            _desc("total"), "regiao"
        )
    states = _scored(fact, None, "uf_sigla").groupBy("uf_sigla").agg(
        F.count(F.lit(1)).alias("n"), F.sum(SCORE).alias("soma")
    )
    placed = lookup(
        states, _region_of_state(fact, regions), "uf_sigla", "uf", "regiao", "regiao", config.UNKNOWN_REGION
    )
    return (
        placed.groupBy("regiao")
        .agg(
            F.sum("n").alias("total"),
            F.round(F.try_divide(F.sum("soma"), F.sum("n")), 2).alias("media"),
        )
        .orderBy(_desc("total"), "regiao")
    )


def coverage(fact: DataFrame, raw: DataFrame, raw_year: str = "nu_ano") -> DataFrame:
    """Valid scores per edition against the rows of the raw layer."""
    valid = _scored(fact).groupBy(F.col("nu_ano").cast("int").alias("ano")).agg(
        F.count(F.lit(1)).alias("validos")
    )
    extracted = raw.groupBy(F.col(raw_year).cast("int").alias("ano")).agg(F.count(F.lit(1)).alias("total"))
    return valid.join(extracted, "ano", "left").select(
        "ano",
        "validos",
        F.coalesce("total", "validos").alias("total"),
        (F.coalesce("total", "validos") - F.col("validos")).alias("sem_nota"),
        percent(F.col("validos"), F.coalesce("total", "validos")).alias("pct_validos"),
    ).orderBy("ano")


def coverage_summary(fact: DataFrame, raw: DataFrame, raw_year: str = "nu_ano") -> DataFrame:
    sums = coverage(fact, raw, raw_year).agg(
        F.sum("total").alias("total_extraido"), F.sum("validos").alias("total_validos")
    )
    return sums.select(
        "total_extraido",
        "total_validos",
        (F.col("total_extraido") - F.col("total_validos")).alias("total_sem_nota"),
        percent(F.col("total_validos"), F.col("total_extraido")).alias("pct_validos"),
    )


# --- analysis ---------------------------------------------------------------------------------------
def course_over_time(
    fact: DataFrame, names: Mapping[str, str] = config.COURSE_SHORT_EVOLUTION
) -> DataFrame:
    groups = agg.group_mean(_scored(fact, None, "curso_nome"), ["curso_nome", "nu_ano"], SCORE)
    return groups.select(
        label("curso_nome", names, F.col("curso_nome")).alias("curso"),
        F.col("nu_ano").cast("int").alias("ano"),
        "media",
        "total",
    ).orderBy("curso", "ano")


def course_over_time_pivot(
    fact: DataFrame,
    years: Sequence[int] = config.EDITIONS,
    names: Mapping[str, str] = config.COURSE_SHORT_EVOLUTION,
) -> DataFrame:
    return pivot_value(course_over_time(fact, names), ["curso"], "ano", years, "media").orderBy("curso")


def income_by_band(
    fact: DataFrame,
    names: Mapping[str, str] = config.INCOME_SHORT_BANDS,
    classes: Sequence[str] = config.CLASSES,
) -> DataFrame:
    counts = pivot_count(require(fact, "qe_renda", "faixa_nota"), ["qe_renda"], "faixa_nota", classes)
    whole = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    code = F.col("qe_renda").cast("string")
    return (
        counts.withColumn("total", whole)
        .select(
            label(code, names, code).alias("nome"),
            code.alias("codigo"),
            *classes,
            "total",
            *[percent(F.col(c), F.col("total")).alias(f"pct_{c}") for c in classes],
        )
        .orderBy(*code_order("codigo"))
    )


def internet_access(fact: DataFrame) -> DataFrame:
    return _labelled(fact, None, "qe_acesso_internet", config.INTERNET_NAMES)


def score_histogram(fact: DataFrame, years: Sequence[int] = config.EDITIONS) -> DataFrame:
    """Dense buckets by edition; a perfect score joins the last bucket."""
    rows = _scored(fact).select(bucket(SCORE).alias("bucket"), "nu_ano")
    counts = pivot_count(rows, ["bucket"], "nu_ano", years)
    dense = densify(counts, [str(y) for y in years], bucket=config.BUCKETS)
    return dense.select("bucket", bucket_name("bucket").alias("faixa"), *[str(y) for y in years]).orderBy(
        "bucket"
    )


def confusion(fact: DataFrame) -> DataFrame:
    counts = evaluate.confusion_counts(fact, "faixa_nota", "faixa_prevista")
    return evaluate.confusion_matrix(counts)


# --- two-way tables ------------------------------------------------------------------------------------
def _delta() -> Column:
    return F.round(F.col("publica") - F.col("privada"), 2)


def income_by_network(
    fact: DataFrame, pattern: str = config.PUBLIC_PATTERN, names: Mapping[str, str] = config.INCOME_SHORT
) -> DataFrame:
    rows = _scored(fact, None, "qe_renda", "tipo_ies")
    code = F.col("qe_renda").cast("string")
    sides = two_sides(rows, ["qe_renda"], network("tipo_ies", pattern, config.PUBLIC_WORDS), NETWORK_SIDES, SCORE)
    return both_present(sides, "publica", "privada").select(
        label(code, names, code).alias("nome"), code.alias("codigo"),
        "publica", "privada", "n_pub", "n_priv", _delta().alias("delta"),
    ).orderBy(*code_order("codigo"))


def course_by_network(
    fact: DataFrame, pattern: str = config.PUBLIC_PATTERN, names: Mapping[str, str] = config.COURSE_SHORT
) -> DataFrame:
    rows = _scored(fact, None, "curso_nome", "tipo_ies")
    sides = two_sides(rows, ["curso_nome"], network("tipo_ies", pattern, config.PUBLIC_WORDS), NETWORK_SIDES, SCORE)
    return both_present(sides, "publica", "privada").select(
        label("curso_nome", names, F.col("curso_nome")).alias("curso"),
        "publica", "privada", _delta().alias("delta"),
    ).orderBy(_desc("delta"), "curso")


def race_by_income(fact: DataFrame) -> DataFrame:
    groups = agg.group_mean(
        _scored(fact, None, "qe_raca_cor", "qe_renda"), ["qe_raca_cor", "qe_renda"], SCORE
    )
    race_code, income_code = (F.col(c).cast("string") for c in ("qe_raca_cor", "qe_renda"))
    return groups.select(
        label(race_code, config.RACE_NAMES, race_code).alias("raca"),
        income_code.alias("codigo"),
        label(income_code, config.INCOME_SHORT, income_code).alias("nome"),
        "media",
        "total",
    ).orderBy("raca", *code_order("codigo"))


def race_by_income_nested(fact: DataFrame) -> DataFrame:
    return nested_cells(
        race_by_income(fact), ["raca"], ["codigo", "nome", "media", "total"], "rendas",
        F.col("codigo").try_cast("bigint"),
    ).orderBy("raca")


def funding_by_network(fact: DataFrame, pattern: str = config.PUBLIC_PATTERN) -> DataFrame:
    """A funding code may lack one side: that mean is null."""
    rows = _scored(fact, None, "qe_financiamento", "tipo_ies")
    code = F.col("qe_financiamento").cast("string")
    sides = two_sides(rows, ["qe_financiamento"], network("tipo_ies", pattern, config.PUBLIC_WORDS), NETWORK_SIDES, SCORE)
    return sides.select(
        label(code, config.FUNDING_SHORT, code).alias("nome"), code.alias("codigo"), "publica", "privada"
    ).orderBy(*code_order("codigo"))


def race_within_income(fact: DataFrame, undeclared: str = "0") -> DataFrame:
    """Racial shares inside each income group, undeclared left out on both axes."""
    rows = require(fact, "qe_renda", "qe_raca_cor").select(
        *[F.col(c).cast("string").alias(c) for c in ("qe_renda", "qe_raca_cor")]
    )
    counts = agg.value_counts(exclude(rows, undeclared, "qe_renda", "qe_raca_cor"), "qe_renda", "qe_raca_cor")
    shares = agg.share_within(counts, ["qe_renda"])
    return shares.select(
        label("qe_renda", config.INCOME_SHORT, F.col("qe_renda")).alias("nome"),
        F.col("qe_renda").alias("codigo"),
        label("qe_raca_cor", config.RACE_NAMES, F.col("qe_raca_cor")).alias("raca"),
        "total",
        "pct",
    ).orderBy(*code_order("codigo"), "raca")


def race_within_income_pivot(
    fact: DataFrame,
    races: Sequence[str] = tuple(v for k, v in config.RACE_NAMES.items() if k != "0"),
    undeclared: str = "0",
) -> DataFrame:
    return pivot_value(
        race_within_income(fact, undeclared), ["nome", "codigo"], "raca", races, "pct"
    ).orderBy(*code_order("codigo"))


# --- trends -----------------------------------------------------------------------------------------------
def _yearly(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Edition means, rounded as published: trends are fitted on these."""
    return agg.group_mean(rows, [*by, F.col("nu_ano").cast("int").alias("ano")], SCORE)


def overall_trend(
    fact: DataFrame, real: Sequence[int] = config.EDITIONS, projected: Sequence[int] = config.PROJECTED_EDITIONS
) -> DataFrame:
    return trend(_yearly(_scored(fact)), real, projected).drop("confiavel").orderBy("ano")


def course_trends(
    fact: DataFrame,
    real: Sequence[int] = config.EDITIONS,
    projected: Sequence[int] = config.PROJECTED_EDITIONS,
    names: Mapping[str, str] = config.COURSE_SHORT,
) -> DataFrame:
    """Trend per course; projections only where the fit is reliable."""
    course = label("curso_nome", names, F.col("curso_nome")).alias("curso")
    points = _yearly(_scored(fact, None, "curso_nome"), course)
    return trend(points, real, projected, ["curso"], require_reliable=True).orderBy("curso", "ano")


def network_trends(
    fact: DataFrame,
    real: Sequence[int] = config.EDITIONS,
    projected: Sequence[int] = config.PROJECTED_EDITIONS,
    pattern: str = config.PUBLIC_PATTERN,
) -> DataFrame:
    points = _yearly(_scored(fact, None, "tipo_ies"), network("tipo_ies", pattern).alias("rede"))
    return trend(points, real, projected, ["rede"]).drop("confiavel").orderBy("rede", "ano")


def network_trends_pivot(
    fact: DataFrame,
    real: Sequence[int] = config.EDITIONS,
    projected: Sequence[int] = config.PROJECTED_EDITIONS,
    pattern: str = config.PUBLIC_PATTERN,
) -> DataFrame:
    rows = network_trends(fact, real, projected, pattern)
    sides = (("pub", PUBLIC), ("prv", PRIVATE))
    return rows.groupBy("ano").agg(
        *[
            F.max(F.when(F.col("rede") == side, F.col(value))).alias(f"{short}_{name}")
            for value, name in (("media", "real"), ("projecao", "proj"))
            for short, side in sides
        ]
    ).orderBy("ano")


def trend_summary(
    fact: DataFrame, real: Sequence[int] = config.EDITIONS, projected: Sequence[int] = config.PROJECTED_EDITIONS
) -> DataFrame:
    """Overall slope, fit and projections with the number of reliable courses, in one row.

    Grouping sets give course and overall edition means from one scan.
    """
    rows = _scored(fact).withColumn("ano", F.col("nu_ano").cast("int"))
    cells = (
        rows.groupingSets([["curso_nome", "ano"], ["ano"]], "curso_nome", "ano")
        .agg(F.grouping("curso_nome").alias("_all"), mean(SCORE).alias("media"))
        .filter((F.col("_all") == 1) | F.col("curso_nome").isNotNull())
        .filter(F.col("ano").isin(list(real)))
    )
    fits = fit_line(cells, "ano", "media", ["_all", "curso_nome"])
    overall, course = F.col("_all") == 1, F.col("_all") == 0
    sure = reliable(F.round("_r2", 4), [predict(F.lit(float(y))) for y in projected])
    return fits.agg(
        F.max(F.when(overall, F.round("_b1", 4))).alias("tendencia_geral_b1"),
        F.max(F.when(overall, F.round("_r2", 4))).alias("tendencia_geral_r2"),
        *[F.max(F.when(overall, predict(F.lit(float(y))))).alias(f"previsao_{y}") for y in projected],
        F.count_if(course & sure).alias("cursos_confiaveis"),
        F.count_if(course & ~sure).alias("cursos_nao_confiaveis"),
    )


# --- binary crossing, cards, profile --------------------------------------------------------------------------
def binary_split(
    fact: DataFrame, column: str, names: Mapping[str, str] = config.BINARY_NAMES, filters: Filters = None
) -> DataFrame:
    groups = _labelled(fact, filters, column, names, "media_nota")
    return agg.share_of_total(groups).orderBy(*code_order("codigo"))


def binary_by_race(
    fact: DataFrame,
    column: str,
    values: tuple[str, str] = ("F", "M"),
    filters: Filters = None,
) -> DataFrame:
    """Race rows with mean and count for the two values of a column."""
    rows = _scored(fact, filters, column, "qe_raca_cor")
    a, b = values
    sides = two_sides(
        rows, ["qe_raca_cor"], F.col(column), ((a, f"media_{a.lower()}", f"total_{a.lower()}"), (b, f"media_{b.lower()}", f"total_{b.lower()}")), SCORE
    )
    code = F.col("qe_raca_cor").cast("string")
    return sides.select(
        label(code, config.RACE_NAMES, code).alias("raca"), code.alias("codigo"),
        *[c for c in sides.columns if c != "qe_raca_cor"],
    ).orderBy(*code_order("codigo"))


def inequality_cards(fact: DataFrame, filters: Filters = None) -> DataFrame:
    """First and last income group with their ratio, in one row (undeclared left out)."""
    return agg.last_over_first(income(fact, filters), "media", "qe_renda")


def best_and_largest_race(fact: DataFrame, filters: Filters = None) -> DataFrame:
    """Race group with the best mean and the one with most students."""
    rows = race(fact, filters)
    return rows.agg(
        F.max_by("nome", "media_nota").alias("melhor_nome"),
        F.max("media_nota").alias("melhor_media"),
        F.max_by("nome", "total").alias("maior_nome"),
        F.max("total").alias("maior_total"),
        F.max_by("pct", "total").alias("maior_pct"),
    )


def largest_network_gap(fact: DataFrame, pattern: str = config.PUBLIC_PATTERN) -> DataFrame:
    return agg.largest_absolute(income_by_network(fact, pattern), "delta", "max_abs_delta")


def income_score_correlation(fact: DataFrame, code: str = "qe_renda", digits: int = 6) -> DataFrame:
    """The income code against the score, with the rows that have both."""
    return agg.correlation(fact, code, SCORE, digits)


def yearly_change(fact: DataFrame) -> DataFrame:
    """Edition means with their change against the first and the previous edition."""
    return agg.change_over_time(_yearly(_scored(fact)), "ano", "media").orderBy("ano")


def rows_by(fact: DataFrame, column: str) -> DataFrame:
    return agg.value_counts(fact, column).orderBy(*_asc(column))


def nulls_by_column(fact: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return agg.null_profile(fact, columns).orderBy("coluna")


def band_order(rows: DataFrame, column: str = "faixa_nota") -> DataFrame:
    """Rows in the fixed class order."""
    return rows.orderBy(class_order(column).asc_nulls_last())
