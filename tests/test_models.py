"""Invariants of the fits, on separable data with nulls."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from microatlas.operators import evaluate, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(3000).select(
        "id",
        (F.col("id") % 5).cast("int").alias("a"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 7).cast("int")).alias("b"),
        (F.col("id") % 5 % 3).cast("int").alias("c"),
    )
    score = F.col("a") * 10 + F.coalesce("b", F.lit(3))
    return base.withColumn("nota", score.cast("double")).withColumn(
        "faixa", F.when(score < 15, "baixo").when(score < 32, "medio").otherwise("alto")
    ).persist()


@pytest.fixture(scope="module")
def profiles(rows):
    return models.fit_profiles(rows, FEATURES, "nota", 3, (42, 43, 44), 50)


def filled(rows):
    pdf = rows.select(*FEATURES).toPandas().astype(float)
    return ((f := pdf.fillna(pdf.median())) - f.mean()) / f.std(ddof=0)


def test_clusters_are_nearest_best_and_ranked(rows, profiles):
    scored = profiles.transform(rows)
    means = [r.m for r in scored.groupBy("cluster_id").agg(F.avg("nota").alias("m")).orderBy("cluster_id").collect()]
    assert len(means) == 3 and means == sorted(means)
    model = profiles.pipeline.stages[3]
    z = filled(rows).to_numpy()
    distances = ((z[:, None, :] - np.array(model.clusterCenters())[None]) ** 2).sum(axis=2)
    best = distances.min(axis=1).sum()
    assert best == pytest.approx(min(profiles.costs.values()), rel=1e-6)
    raw = profiles.pipeline.transform(rows).orderBy("id").select("_k").toPandas()["_k"].to_numpy()
    assert distances[np.arange(len(raw)), raw] == pytest.approx(distances.min(axis=1))


def test_projection_matches_numpy_and_the_row_based_fit(spark, rows, profiles):
    z = filled(rows).to_numpy()
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    order = np.argsort(values)[::-1][:2]
    for loadings, j in zip(profiles.projection.loadings, order):
        v = vectors[:, j]
        v = v if v[abs(v).argmax()] > 0 else -v
        assert np.allclose(loadings, v, atol=1e-6)
    assert np.allclose(profiles.projection.explained, values[order] / values.sum())
    got = profiles.transform(rows).orderBy("id").select("pca_x", "pca_y").toPandas().to_numpy()
    assert np.allclose(got, z @ np.array(profiles.projection.loadings).T, atol=1e-4)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double, c double")
    by_rows = models.fit_projection(VectorAssembler(inputCols=FEATURES, outputCol="v").transform(frame), "v")
    assert np.allclose(by_rows.loadings, profiles.projection.loadings, atol=1e-6)


def test_forest_learns_and_repeats(rows):
    fits = [models.fit_classifier(rows, FEATURES, "faixa", ["id"], trees=10, depth=6) for _ in range(2)]
    fit = fits[0]
    assert sum(v for _, v in fit.importances) == pytest.approx(1.0)
    assert all(v >= 0 for _, v in fit.importances)
    assert [n for n, _ in fit.importances][0] == "a"
    acc = evaluate.accuracy(evaluate.confusion_counts(fit.holdout)).first()
    sizes = {r.faixa: r.n for r in rows.groupBy("faixa").agg(F.count("*").alias("n")).collect()}
    assert acc.total == sum(round(n * 0.2) for n in sizes.values())
    assert acc.acuracia > 0.9
    a, b = (f.transform(rows).select("id", "faixa_prevista") for f in fits)
    assert a.exceptAll(b).count() == 0
    assert fit.transform(rows).columns == [*rows.columns, "faixa_prevista"]


def test_forest_on_blocks_keeps_all_weight_and_learns(rows):
    fit = models.fit_classifier(rows, FEATURES, "faixa", ["id"], trees=10, depth=6, blocks=16)
    counts = evaluate.confusion_counts(fit.holdout)
    assert evaluate.accuracy(counts).first().acuracia > 0.9
    plain = models.fit_classifier(rows, FEATURES, "faixa", ["id"], trees=3, depth=3)
    assert counts.agg(F.sum("total")).first()[0] == plain.holdout.count()


def test_saved_pipelines_score_alike(spark, rows, profiles, tmp_path):
    models.save_pipeline(profiles.pipeline, str(tmp_path / "m"))
    again = models.load_pipeline(str(tmp_path / "m"))
    columns = ["id", "cluster_id", "pca_x", "pca_y"]
    assert again.transform(rows).select(columns).exceptAll(profiles.transform(rows).select(columns)).count() == 0


def test_weighted_moments_equal_those_of_the_rows(spark):
    flat = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "x double")
    folded = spark.createDataFrame([(1.0, 2.0), (4.0, 1.0), (None, 1.0)], "x double, n double")
    assert models.moments(flat, ["x"])["x"] == pytest.approx(models.moments(folded, ["x"], "n")["x"])
    assert models.moments(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"]) == {"x": (3.0, 1.0)}


# The published hold-out matrix, and the figures that follow from it.
PUBLISHED = {("alto", "alto"): 8539, ("alto", "medio"): 111, ("medio", "alto"): 405, ("medio", "medio"): 7496, ("medio", "baixo"): 495, ("baixo", "medio"): 110, ("baixo", "baixo"): 8293}


def test_evaluation_of_the_published_matrix(spark):
    counts = spark.createDataFrame([(a, b, n) for (a, b), n in PUBLISHED.items()], "real string, previsto string, total bigint")
    assert evaluate.accuracy(counts, 4).first().acuracia == 0.956
    report = {r.classe: r for r in evaluate.class_report(counts, digits=4).collect()}
    assert report["medio"].f1 == 0.9304
    assert report["weighted avg"].support == 25449
    details = evaluate.matrix_details(counts).first()
    assert (details.total, details.confusoes_extremas, details.erros_classe, details.max_fora) == (25449, 0, 900, 495)
    metrics = evaluate.metrics_table(spark.createDataFrame([("QE_I05", 0.2856)], "feature string, valor double"), counts)
    assert [r.id for r in metrics.orderBy("id").collect()] == list(range(8))
    cells = {(r.real, r.previsto): r.total for r in evaluate.metric_matrix(metrics).collect()}
    assert cells == {(a, b): PUBLISHED.get((a, b), 0) for a in ("baixo", "medio", "alto") for b in ("baixo", "medio", "alto")}
    assert {r.classe for r in evaluate.metric_classes(metrics).collect()} == {"baixo", "medio", "alto"}


def test_unseen_class_gives_zero_not_an_error(spark):
    counts = spark.createDataFrame([("baixo", "baixo", 3)], "real string, previsto string, total bigint")
    report = {r.classe: (r.precision, r.recall, r.f1) for r in evaluate.class_report(counts).collect()}
    assert report["alto"] == (0.0, 0.0, 0.0) and report["baixo"] == (1.0, 1.0, 1.0)
