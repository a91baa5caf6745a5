"""Preparation, models and evaluation.

Fits and predictions of ``pyspark.ml`` have no SQL twin; their registered queries
return invariants that must hold, over whole tables, with the settings of the batch job.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import star
from checks.registry import add, on_fact
from checks.report_queries import CELLS, CLASS_REPORT, on_fact_sql
from checks.source_queries import UNFOLDED_SQL, _unfolded
from microatlas import config
from microatlas.operators import aggregates as agg
from microatlas.operators import evaluate, models, split
from microatlas.operators.quantiles import exact_medians
from microatlas.runtime import scratch_path, settle

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["qe_renda", "qe_raca_cor", "qe_horas_estudo", "qe_trabalha", "qe_horas_trabalho", "co_categad"]
SMALL = ["qe_renda", "qe_escola_em", "qe_financiamento"]
_K = ", ".join(KEYS)
_F = " ".join(FEATURES)
_SMALL = " ".join(SMALL)
_FILLED = "m as (select " + ", ".join(f"median({c}) as {c}_m" for c in SMALL) + " from fact), filled as (select " + _K + ", " + ", ".join(f"cast(coalesce({c}, {c}_m) as double) as {c}" for c in SMALL) + " from fact, m)"
_MOMENTS = "s as (select " + ", ".join(f"avg({c}) as {c}_a, stddev_pop({c}) as {c}_s" for c in SMALL) + " from filled)"


def _filled(f: DataFrame) -> DataFrame:
    return models.impute(f, exact_medians(f, SMALL))


on_fact("ml1_impute_medians", f"{' '.join(KEYS)} {_SMALL}", _filled, f"{_FILLED} select * from filled")


def _standard(f: DataFrame) -> DataFrame:
    filled = _filled(settle(f, "rows"))  # read by medians, moments and the result
    return models.standardise(filled, models.moments(filled, SMALL))


on_fact(
    "ml2_standardise", f"{' '.join(KEYS)} {_SMALL}",
    lambda f: _standard(f).select(*KEYS, *[F.round(c, 6).alias(c) for c in SMALL]),
    f"{_FILLED}, {_MOMENTS} select {_K}, " + ", ".join(f"round(({c} - {c}_a) / {c}_s, 6) as {c}" for c in SMALL) + " from filled, s",
)
CENTRES = ((0.0, 0.0, 1.0), (1.0, 3.0, 2.0), (2.0, 1.0, 4.0), (3.0, 4.0, 5.0))
_DISTANCES = [" + ".join(f"({c} - {x}::double) * ({c} - {x}::double)" for c, x in zip(SMALL, centre)) for centre in CENTRES]
on_fact(
    "ml4_nearest_centre", f"{' '.join(KEYS)} {_SMALL}",
    lambda f: _filled(f).select(*KEYS, models.nearest_centre(f, SMALL, CENTRES).alias("centro")),
    f"{_FILLED}, d as (select {_K}, " + ", ".join(f"{e} as d{i}" for i, e in enumerate(_DISTANCES)) + f" from filled) select {_K}, case least(d0, d1, d2, d3) when d0 then 0 when d1 then 1 when d2 then 2 else 3 end as centro from d",
)
on_fact(
    "ml5_rank_clusters", "cluster_id nt_ger",
    lambda f: models.rank_clusters(f.dropna().select(F.col("cluster_id").alias("k"), "nt_ger"), "k", "nt_ger"),
    "g as (select cluster_id as k, count(*) as total, avg(nt_ger) as m from fact where cluster_id is not null and nt_ger is not null group by 1) select k, cast(row_number() over (order by m, k) - 1 as int) as cluster_id, total, round(m, 4) as media from g",
)
on_fact(
    "ml6_stratified_holdout", f"{' '.join(KEYS)} faixa_nota",
    lambda f: split.stratified_holdout(f, "faixa_nota", KEYS),
    f"""h as (select {_K}, faixa_nota, ('0x' || substr(md5({" || '|' || ".join(KEYS)}), 1, 15))::bigint as h from fact where faixa_nota is not null)
    select {_K}, faixa_nota, row_number() over (partition by faixa_nota order by h) <= round(count(*) over (partition by faixa_nota) * 0.2) as teste from h""",
)
on_fact(
    "ml7_class_weights", "faixa_nota", lambda f: split.class_weights(f, "faixa_nota").withColumn("peso", F.round("peso", 6)),
    "g as (select faixa_nota, count(*) as n from fact where faixa_nota is not null group by 1) select faixa_nota, n, round(sum(n) over () / (count(*) over () * n), 6) as peso from g",
)
_PAIRS = [(a, b) for i, a in enumerate(SMALL) for b in SMALL[i:]]
for kind in ("corr", "covar_pop"):
    on_fact(
        f"ml12_{kind}_matrix", _SMALL, lambda f, kind=kind: agg.covariance_matrix(f, SMALL, kind),
        " union all ".join(f"select '{a}' as x, '{b}' as y, round({kind}({a}, {b}), 6) as valor from fact" for a, b in _PAIRS),
    )


# --- fits: invariants ---------------------------------------------------------------------------------------
def _profiles(f: DataFrame) -> tuple[models.Profiles, DataFrame]:
    rows = f.filter(F.col("nt_ger").isNotNull())
    return models.fit_profiles(rows, FEATURES, "nt_ger"), rows


def _kmeans_invariants(f: DataFrame) -> DataFrame:
    """Every row gets one of k ids, and the mean score ascends with the id."""
    fitted, rows = _profiles(f)
    groups = agg.group_mean(fitted.transform(rows), ["cluster_id"], "nt_ger", None)
    scored = fitted.pipeline.transform(rows)
    model = fitted.pipeline.stages[3]
    off = [
        F.when(F.col("_k") == i, sum(((F.col(f"{c}_z") - F.lit(float(x))) ** 2 for c, x in zip(FEATURES, centre)), F.lit(0.0)))
        for i, centre in enumerate(model.clusterCenters())
    ]
    # The cost over the rows, not over the folded points that the fit has seen.
    cost = scored.agg(F.sum(F.coalesce(*off))).first()[0]
    pairs = groups.select("cluster_id", "total", "media", F.lag("media").over(W.orderBy("cluster_id")).alias("antes"))
    return pairs.agg(
        F.count(F.lit(1)).alias("grupos"),
        F.sum("total").alias("total"),
        F.min("cluster_id").alias("primeiro"),
        F.max("cluster_id").alias("ultimo"),
        F.bool_and(F.coalesce(F.col("media") >= F.col("antes"), F.lit(True))).alias("ascendente"),
        F.lit(abs(cost / model.summary.trainingCost - 1) < 1e-6).alias("custo_confere"),
        F.lit(all(x >= cost * (1 - 1e-6) for x in fitted.costs.values())).alias("melhor_custo"),
        F.lit(len(fitted.costs)).alias("partidas"),
    )


on_fact(
    "ml3_kmeans_profiles", f"{_F} nt_ger", _kmeans_invariants,
    "select 4::bigint as grupos, count(*) as total, 0 as primeiro, 3 as ultimo, true as ascendente, true as custo_confere, true as melhor_custo, 10 as partidas from fact where nt_ger is not null",
)


def _rows_at_nearest(f: DataFrame) -> DataFrame:
    """Rows whose assigned centre is the nearest one, over all rows."""
    fitted, rows = _profiles(f)
    model = fitted.pipeline.stages[3]
    scored = fitted.pipeline.transform(rows)
    nearest = models.nearest_centre(rows, [f"{c}_z" for c in FEATURES], [list(map(float, c)) for c in model.clusterCenters()])
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_k") == nearest).alias("no_mais_proximo"))


on_fact(
    "ml3_rows_at_nearest_centre", f"{_F} nt_ger", _rows_at_nearest,
    "select count(*) as total, count(*) as no_mais_proximo from fact where nt_ger is not null",
)


def _projection_invariants(f: DataFrame) -> DataFrame:
    fitted, rows = _profiles(f)
    scored = fitted.transform(rows)
    a, b = fitted.projection.loadings
    return scored.agg(
        (F.abs(F.avg("pca_x")) < 1e-3).alias("centrado_x"),
        (F.abs(F.avg("pca_y")) < 1e-3).alias("centrado_y"),
        (F.var_pop("pca_x") >= F.var_pop("pca_y")).alias("ordenado"),
        (F.abs(F.corr("pca_x", "pca_y")) < 1e-2).alias("sem_correlacao"),
        F.lit(abs(sum(x * y for x, y in zip(a, b))) < 1e-9).alias("ortogonais"),
        F.lit(abs(sum(x * x for x in a) - 1) < 1e-9 and max(a, key=abs) > 0).alias("norma_e_sinal"),
    )


on_fact(
    "ml11_projection", f"{_F} nt_ger", _projection_invariants,
    "select true as centrado_x, true as centrado_y, true as ordenado, true as sem_correlacao, true as ortogonais, true as norma_e_sinal",
)


def _embedding_projection(spark, sf) -> DataFrame:
    """Two components of the 64-d vectors: centred, uncorrelated, spread as explained."""
    table = star.table(spark, sf, "embeddings")
    columns = [f"e{i}" for i in range(64)]
    wide = table.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    z = models.standardise(wide, models.moments(wide, columns))
    ready = VectorAssembler(inputCols=columns, outputCol="v").transform(z)
    found = models.fit_projection(ready, "v")
    points = z.select("label", *[models.project(columns, w).alias(n) for n, w in zip(("x", "y"), found.loadings)])
    # On standardised columns a component's variance is its eigenvalue: share times columns.
    spread = F.var_pop("x") / F.var_pop("y")
    share = found.explained[0] / found.explained[1]
    return points.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("label").alias("rotulos"),
        (F.abs(F.avg("x")) + F.abs(F.avg("y")) < 1e-3).alias("centrado"),
        (F.abs(F.corr("x", "y")) < 1e-3).alias("sem_correlacao"),
        (F.abs(spread / F.lit(share) - 1) < 1e-3).alias("variancia_explicada"),
    )


add(
    "ml11_projection_of_embeddings", _embedding_projection,
    "select count(*) as total, count(distinct label) as rotulos, true as centrado, true as sem_correlacao, true as variancia_explicada from embeddings",
)


def _labelled(f: DataFrame) -> DataFrame:
    """A band that depends on three of the features."""
    signal = F.coalesce("qe_renda", F.lit(1)) * 2 + F.col("qe_trabalha") + F.col("qe_horas_estudo")
    return f.withColumn("banda", F.when(signal <= 4, "baixo").when(signal <= 7, "medio").otherwise("alto"))


def _best_share(f: DataFrame) -> DataFrame:
    """``melhor``: the share of rows that any rule on the imputed features can get right."""
    signal = ["qe_renda", "qe_trabalha", "qe_horas_estudo"]
    cells = settle(_labelled(f).groupBy(*signal, "banda").agg(F.count(F.lit(1)).alias("n")), "cells")
    medians = exact_medians(cells, signal, "n")
    filled = cells.select("banda", "n", *[F.coalesce(c, F.lit(medians[c])).alias(c) for c in signal])
    return filled.groupBy(*signal, "banda").agg(F.sum("n").alias("n")).groupBy(*signal).agg(
        F.max("n").alias("most"), F.sum("n").alias("all")
    ).agg((F.sum("most") / F.sum("all")).alias("melhor"))


def _classifier(f: DataFrame) -> models.Classifier:
    return models.fit_classifier(_labelled(f), FEATURES, "banda", KEYS)


_BANDA = """b as (select nt_ger, case when s <= 4 then 'baixo' when s <= 7 then 'medio' else 'alto' end as banda
    from (select nt_ger, coalesce(qe_renda, 1) * 2 + qe_trabalha + qe_horas_estudo as s from fact))"""
_CLASSIFIER_COLUMNS = f"{' '.join(KEYS)} {_F}"


def _forest_holdout(f: DataFrame) -> DataFrame:
    rows = settle(f, "rows")  # read by the fit and by the share to compare with
    return evaluate.accuracy(evaluate.confusion_counts(_classifier(rows).holdout), 4).select(
        (F.col("acuracia") > _best_share(rows).first().melhor - 0.05).alias("perto_do_melhor"), "total"
    )


on_fact(
    "ml8_forest_holdout", _CLASSIFIER_COLUMNS, _forest_holdout,
    f"b as (select case when s <= 4 then 'baixo' when s <= 7 then 'medio' else 'alto' end as b from (select coalesce(qe_renda, 1) * 2 + qe_trabalha + qe_horas_estudo as s from fact)), g as (select b, round(count(*) * 0.2) as n from b group by 1) select true as perto_do_melhor, cast(sum(n) as bigint) as total from g",
)
on_fact(
    "ml9_score_all_rows", _CLASSIFIER_COLUMNS,
    lambda f: _classifier(f).transform(_labelled(f)).groupBy("banda").agg(
        F.count(F.lit(1)).alias("total"), F.count("faixa_prevista").alias("previstas")
    ),
    f"{_BANDA} select banda, count(*) as total, count(*) as previstas from b group by 1",
)


def _block_forest(f: DataFrame) -> DataFrame:
    """Training on weighted blocks: every row of the table still gets its class."""
    rows = settle(f, "rows")  # read by the fit, the scores and the share to compare with
    fit = models.fit_classifier(_labelled(rows), FEATURES, "banda", KEYS, blocks=8)
    scored = fit.transform(_labelled(rows))
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        (F.avg((F.col("banda") == F.col("faixa_prevista")).cast("double")) > _best_share(rows).first().melhor - 0.05).alias("perto_do_melhor"),
    )


on_fact(
    "ml8_forest_on_blocks", _CLASSIFIER_COLUMNS, _block_forest,
    "select count(*) as total, true as perto_do_melhor from fact",
)


def _importances(f: DataFrame) -> DataFrame:
    """The three features that make the band stand above the three that do not."""
    rows = models.importance_rows(f.sparkSession, *zip(*_classifier(f).importances))
    signal = F.col("feature").isin("qe_renda", "qe_trabalha", "qe_horas_estudo")
    return rows.agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum("valor"), 6).alias("soma"),
        F.bool_and(F.col("valor") >= 0).alias("nao_negativas"),
        (F.min(F.when(signal, F.col("valor"))) > F.max(F.when(~signal, F.col("valor")))).alias("sinal_encontrado"),
    )


on_fact(
    "ml10_importances", _CLASSIFIER_COLUMNS, _importances,
    f"select {len(FEATURES)}::bigint as features, 1.0::double as soma, true as nao_negativas, true as sinal_encontrado",
)


def _all_models(f: DataFrame) -> DataFrame:
    """K-means, forest and projection on the same rows, four columns added."""
    rows = _labelled(settle(f.filter(F.col("nt_ger").isNotNull()), "rows"))  # read by each fit and each check
    profiles = models.fit_profiles(rows, FEATURES, "nt_ger")
    forest = models.fit_classifier(rows, FEATURES, "banda", KEYS)
    scored = forest.transform(profiles.transform(rows))
    right = F.avg((F.col("banda") == F.col("faixa_prevista")).cast("double"))
    means = scored.groupBy("cluster_id").agg(F.avg("nt_ger").alias("m"))
    ranked = means.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "m"))).alias("c")).select(
        (F.transform("c", lambda x: x["cluster_id"]) == F.expr(f"sequence(0, {config.CLUSTERS - 1})")).alias("numbered"),
        (F.array_sort(F.transform("c", lambda x: x["m"])) == F.transform("c", lambda x: x["m"])).alias("ascending"),
    ).first()
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count("cluster_id").alias("agrupadas"), F.lit(bool(ranked.numbered)).alias("numeradas"),
        F.lit(bool(ranked.ascending)).alias("crescentes"),
        (F.abs(F.avg("pca_x")) + F.abs(F.avg("pca_y")) < 1e-3).alias("centrado"),
        (F.abs(F.corr("pca_x", "pca_y")) < 1e-3).alias("sem_correlacao"),
        (F.var_pop("pca_x") >= F.var_pop("pca_y")).alias("eixos_em_ordem"),
        (right > _best_share(rows).first().melhor - 0.05).alias("perto_do_melhor"),
    )


on_fact(
    "ml13_all_models", f"{_CLASSIFIER_COLUMNS} nt_ger", _all_models,
    "select count(*) as total, count(*) as agrupadas, true as numeradas, true as crescentes, true as centrado, true as sem_correlacao, true as eixos_em_ordem, true as perto_do_melhor from fact where nt_ger is not null",
)


def _reloaded(f: DataFrame) -> DataFrame:
    """Scores of a saved and reloaded pipeline equal those of the fitted one."""
    rows = f.filter(F.col("nt_ger").isNotNull())
    fitted = models.fit_profiles(rows, FEATURES, "nt_ger")
    path = scratch_path(f.sparkSession, "model")
    models.save_pipeline(fitted.pipeline, path)
    again: PipelineModel = models.load_pipeline(path)
    by = ["cluster_id", "pca_x", "pca_y"]
    a, b = (
        agg.value_counts(m.transform(rows), *by) for m in (fitted.pipeline, again)
    )
    return settle(a).join(settle(b).withColumnRenamed("total", "outro"), by, "full").agg(
        F.bool_and(F.col("total") == F.col("outro")).alias("iguais"), F.sum("total").alias("total")
    )


on_fact(
    "ml14_snk4_saved_pipeline", f"{_F} nt_ger", _reloaded,
    "select true as iguais, count(*) as total from fact where nt_ger is not null",
)

# --- evaluation ---------------------------------------------------------------------------------------------------
_BANDS = "faixa_nota faixa_prevista"


def _counts(f: DataFrame) -> DataFrame:
    return evaluate.confusion_counts(f, "faixa_nota", "faixa_prevista")


def _e(body: str) -> str:
    return (CELLS + " " + body)


on_fact("evl1_confusion_counts", _BANDS, _counts, "select faixa_nota as real, faixa_prevista as previsto, count(*) as total from fact where faixa_nota is not null and faixa_prevista is not null group by 1, 2")
on_fact(
    "evl2_dense_matrix", _BANDS, lambda f: evaluate.confusion_matrix(_counts(f)),
    _e("""select real, cast(sum(total) filter (where previsto = 'baixo') as bigint) as baixo, cast(sum(total) filter (where previsto = 'medio') as bigint) as medio, cast(sum(total) filter (where previsto = 'alto') as bigint) as alto,
    cast(sum(total) as bigint) as total_real, cast(sum(total) filter (where previsto = real) as bigint) as acerto, round(sum(total) filter (where previsto = real) * 100.0 / sum(total), 1) as pct_acerto,
    cast(sum(sum(total)) over () as bigint) as total_matriz from cells group by 1"""),
)
on_fact("evl3_accuracy", _BANDS, lambda f: evaluate.accuracy(_counts(f)), _e("select round(sum(total) filter (where real = previsto) / sum(total), 6) as acuracia, cast(sum(total) as bigint) as total from cells"))
on_fact(
    "evl4_class_report", _BANDS, lambda f: evaluate.class_report(_counts(f)),
    CLASS_REPORT + """, r as (select * from per_class union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from per_class
    union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) as bigint) from per_class)
    select classe, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from r""",
)
on_fact(
    "evl5_matrix_details", _BANDS, lambda f: evaluate.matrix_details(_counts(f)),
    _e("""select cast(sum(total) as bigint) as total, cast(sum(total) filter (where real = previsto) as bigint) as acertos, max(total) filter (where real = previsto) as max_diagonal, max(total) filter (where real <> previsto) as max_fora,
    cast(sum(total) filter (where real = 'medio' and previsto <> 'medio') as bigint) as erros_classe, cast(sum(total) filter (where real = 'medio') as bigint) as total_classe,
    cast(sum(total) filter (where (real = 'baixo' and previsto = 'alto') or (real = 'alto' and previsto = 'baixo')) as bigint) as confusoes_extremas,
    round(sum(total) filter (where real = previsto) * 100.0 / sum(total), 2) as pct_acertos,
    round(sum(total) filter (where real = 'medio' and previsto <> 'medio') * 100.0 / sum(total) filter (where real = 'medio'), 1) as pct_erros_classe from cells"""),
)
on_fact(
    "evl5_matrix_shares", _BANDS, lambda f: evaluate.matrix_shares(_counts(f)),
    _e("""select real, previsto, total, cast(sum(total) over (partition by real) as bigint) as total_linha, cast(sum(total) over (partition by previsto) as bigint) as total_coluna,
    round(total * 100.0 / sum(total) over (partition by real), 1) as pct_linha, round(total * 100.0 / sum(total) over (), 1) as pct_total from cells"""),
)


def _metrics(f: DataFrame) -> DataFrame:
    importances = f.agg(F.abs(F.corr("nt_fg", "nt_ger")).alias("nt_fg")).unpivot([], ["nt_fg"], "feature", "valor")
    return evaluate.metrics_table(importances, _counts(f))


on_fact(
    "evl6_metrics_table", f"{_BANDS} nt_fg nt_ger", lambda f: _unfolded(_metrics(f)),
    CLASS_REPORT + UNFOLDED_SQL.format(second=""),
)
add(
    "evl7_sections_from_json",
    lambda s, d: evaluate.metric_matrix(_metrics(star.fact(s, d, "faixa_nota", "faixa_prevista", "nt_fg", "nt_ger"))),
    on_fact_sql + CELLS + " select * from cells",
)
on_fact(
    "evl8_cluster_shares", "cluster_id", lambda f: evaluate.cluster_shares(f.dropna()),
    "select cluster_id, count(*) as total, round(count(*) * 100.0 / sum(count(*)) over (), 1) as pct from fact where cluster_id is not null group by 1",
)
