"""Profiles, classifier and projection with ``pyspark.ml``.

Feature preparation is arithmetic on literals, kept in ``SQLTransformer`` stages so
that a saved pipeline scores new rows on its own. Fitting reads the rows through
Spark; only scalars, centres and loadings reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import class_order, rounded_half_even
from microatlas.operators.quantiles import exact_medians
from microatlas.operators.split import key_hash, mark_smallest, with_class_weight
from microatlas.runtime import settle

BLOCKS = 64
STARTS_AT_ONCE = 5
POINTS_PER_PARTITION = 50_000
MOST_POINTS = 200_000  # distinct points whose scores are broadcast

# --- preparation ---------------------------------------------------------------------
def impute(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    """Fill nulls with the given medians; the columns become doubles."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(float(m or 0.0)))
            for c, m in medians.items()
        }
    )


def moments(
    df: DataFrame, columns: Sequence[str], weight: str | None = None
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets deviation 1.

    ``weight`` names a column with how many equal rows each row stands for.
    """
    n = F.col(weight) if weight else F.lit(1.0)
    total = lambda c, e: F.sum(F.when(F.col(c).isNotNull(), n * e))
    means = df.agg(
        *[F.try_divide(total(c, F.col(c)), total(c, F.lit(1.0))).alias(c) for c in columns]
    ).first()
    centred = {c: F.col(c) - F.lit(means[c] or 0.0) for c in columns}
    spread = df.agg(
        *[
            F.sqrt(F.try_divide(total(c, centred[c] * centred[c]), total(c, F.lit(1.0)))).alias(c)
            for c in columns
        ]
    ).first()
    return {c: (means[c] or 0.0, spread[c] or 1.0) for c in columns}


def standardise(df: DataFrame, stats: Mapping[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns(
        {f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()}
    )


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _imputer(medians: Mapping[str, float | None], suffix: str) -> SQLTransformer:
    filled = ", ".join(
        f"coalesce(cast(`{c}` AS double), {_number(m or 0.0)}) AS `{c}{suffix}`"
        for c, m in medians.items()
    )
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def _scaler(stats: Mapping[str, tuple[float, float]], source: str, suffix: str) -> SQLTransformer:
    scaled = ", ".join(
        f"(`{c}{source}` - {_number(m)}) / {_number(s)} AS `{c}{suffix}`"
        for c, (m, s) in stats.items()
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


# --- k-means --------------------------------------------------------------------------
def distinct_points(df: DataFrame, features: Sequence[str], score: str) -> DataFrame:
    """Equal rows folded into weighted points, with the sum of their scores.

    Coded answers have few combinations, so billions of rows become a small table
    that holds all that medians, moments, clusters, ranking and projection need.
    Settled, it is the only pass over the rows before scoring.
    """
    points = df.groupBy(*features).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.sum(score).alias("_sum"),
        F.count(score).alias("_scored"),
    )
    return settle(points, "points")


def fit_kmeans(
    points: DataFrame,
    features_col: str,
    k: int = config.CLUSTERS,
    seeds: Sequence[int] = tuple(range(config.SEED, config.SEED + config.KMEANS_RESTARTS)),
    max_iter: int = config.KMEANS_ITERATIONS,
    weight: str | None = None,
) -> tuple[KMeansModel, dict[int, float]]:
    """Best of several starts by training cost; also the cost of every start."""
    def fit(seed: int) -> KMeansModel:
        estimator = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=features_col, predictionCol="_k")
        if weight:
            estimator.setWeightCol(weight)
        return estimator.fit(points)

    # A start is many small jobs that leave most cores idle: several run side by side.
    with ThreadPoolExecutor(min(STARTS_AT_ONCE, len(seeds))) as pool:
        fitted = dict(zip(seeds, pool.map(fit, seeds)))
    costs = {seed: model.summary.trainingCost for seed, model in fitted.items()}
    return fitted[min(seeds, key=lambda seed: (costs[seed], seeds.index(seed)))], costs


def nearest_centre(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest of fixed centres; ties go to the lower index."""
    distances = [
        F.struct(
            sum(
                ((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, centre)),
                F.lit(0.0),
            ).alias("d"),
            F.lit(i).alias("i"),
        )
        for i, centre in enumerate(centres)
    ]
    return F.least(*distances)["i"] if len(distances) > 1 else F.lit(0)


def rank_clusters(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """Canonical id per cluster: rank by ascending mean score (one row per cluster)."""
    means = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("total"), F.avg(score).alias("_m"))
    return _ranked(means, cluster)


def rank_point_clusters(points: DataFrame, cluster: str) -> DataFrame:
    """The same from weighted points."""
    means = points.groupBy(cluster).agg(
        F.sum("_n").cast("bigint").alias("total"),
        F.try_divide(F.sum("_sum"), F.sum("_scored")).alias("_m"),
    )
    return _ranked(means, cluster)


def _ranked(means: DataFrame, cluster: str) -> DataFrame:
    rank = F.row_number().over(W.orderBy(F.col("_m").asc_nulls_first(), cluster)) - 1
    return means.select(cluster, rank.cast("int").alias("cluster_id"), "total", F.round("_m", 4).alias("media"))


# --- forest ---------------------------------------------------------------------------
def fit_forest(
    train: DataFrame,
    features_col: str,
    label_col: str,
    weight_col: str,
    trees: int = config.TREES,
    depth: int = 30,
    seed: int = config.SEED,
    bins: int = 32,
) -> RandomForestClassificationModel:
    return RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        maxBins=bins,
        seed=seed,
        featureSubsetStrategy="sqrt",
        featuresCol=features_col,
        labelCol=label_col,
        weightCol=weight_col,
        predictionCol="_p",
        probabilityCol="_prob",
        rawPredictionCol="_raw",
        cacheNodeIds=True,
        maxMemoryInMB=512,
    ).fit(train)


def importance_rows(
    spark: SparkSession, features: Sequence[str], importances: Sequence[float]
) -> DataFrame:
    rows = sorted(zip(features, (float(x) for x in importances)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, valor double")


# --- projection -----------------------------------------------------------------------
@dataclass(frozen=True)
class Projection:
    loadings: tuple[tuple[float, ...], ...]  # one row per component
    explained: tuple[float, ...]


def fit_projection(df: DataFrame, features_col: str, components: int = 2) -> Projection:
    """Principal components with a fixed sign: the largest loading is positive."""
    model = PCA(k=components, inputCol=features_col, outputCol="_pc").fit(df)
    matrix = model.pc.toArray()
    rows = tuple(_signed(matrix[:, j]) for j in range(components))
    return Projection(rows, tuple(float(x) for x in model.explainedVariance.toArray()))


def _signed(column: np.ndarray) -> tuple[float, ...]:
    sign = 1.0 if column[abs(column).argmax()] >= 0 else -1.0
    return tuple(float(x) * sign for x in column)


def fit_projection_of_points(
    points: DataFrame, columns: Sequence[str], weight: str, components: int = 2
) -> Projection:
    """The same from weighted, standardised points: one aggregate gives the second
    moments of all pairs, and the driver solves that features x features matrix."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = points.agg(
        F.sum(weight).alias("n"),
        *[
            F.sum(F.col(weight) * F.col(columns[i]) * F.col(columns[j])).alias(f"{i}|{j}")
            for i, j in pairs
        ],
    ).first()
    matrix = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = row[f"{i}|{j}"] / row["n"]
    values, vectors = np.linalg.eigh(matrix)
    largest = np.argsort(values)[::-1][:components]
    rows = tuple(_signed(vectors[:, j]) for j in largest)
    return Projection(rows, tuple(float(values[j] / values.sum()) for j in largest))


def project(columns: Sequence[str], loadings: Sequence[float], digits: int = 4) -> Column:
    """Coordinate on one component, rounded half to even."""
    return rounded_half_even(
        sum((F.col(c) * F.lit(w) for c, w in zip(columns, loadings)), F.lit(0.0)), digits
    )


# --- scoring --------------------------------------------------------------------------
def score_rows(
    pipeline: PipelineModel, df: DataFrame, features: Sequence[str], outputs: Mapping[str, str]
) -> DataFrame:
    """Every row with ``outputs`` (a column of the pipeline -> its name) beside its columns.

    Equal features have equal scores, and coded answers have few combinations: those are
    scored, and rows look their scores up. Beyond ``MOST_POINTS`` each row is scored by itself.
    """
    points = settle(df.select(*features).distinct(), "points")
    if points.count() > MOST_POINTS:
        return pipeline.transform(df).select(*df.columns, *[F.col(c).alias(n) for c, n in outputs.items()])
    scored = pipeline.transform(points).select(
        *[F.col(c).alias(f"_point_{i}") for i, c in enumerate(features)], *[F.col(c).alias(f"_score_{c}") for c in outputs]
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_point_{i}")) for i, c in enumerate(features)])
    found = df.join(F.broadcast(settle(scored, "scores")), same, "left")
    return found.select(*df.columns, *[F.col(f"_score_{c}").alias(n) for c, n in outputs.items()])


# --- fitted bundle ----------------------------------------------------------------------
@dataclass
class Profiles:
    """K-means and projection in one scoring pipeline."""

    pipeline: PipelineModel
    costs: dict[int, float]
    projection: Projection
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return score_rows(self.pipeline, df, self.features, {c: c for c in ("cluster_id", "pca_x", "pca_y")})


def fit_profiles(
    df: DataFrame,
    features: Sequence[str],
    score: str,
    k: int = config.CLUSTERS,
    seeds: Sequence[int] = tuple(range(config.SEED, config.SEED + config.KMEANS_RESTARTS)),
    max_iter: int = config.KMEANS_ITERATIONS,
) -> Profiles:
    """Impute, standardise, cluster, rank clusters by mean score and project.

    The rows are read once, into weighted distinct points; every fit reads those.
    """
    features = list(features)
    points = distinct_points(df, features, score)
    medians = exact_medians(points, features, weight="_n")
    stats = moments(impute(points, medians), features, "_n")
    prepare = [_imputer(medians, "_f"), _scaler(stats, "_f", "_z")]
    assemble = VectorAssembler(inputCols=[f"{c}_z" for c in features], outputCol="_zv")
    ready = PipelineModel([*prepare, assemble]).transform(points)
    # Many passes over few points: partitions by their number, not by the shuffle's.
    ready = ready.coalesce(max(1, -(-points.count() // POINTS_PER_PARTITION)))
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model, costs = fit_kmeans(ready, "_zv", k, seeds, max_iter, "_n")
        ranks = rank_point_clusters(model.transform(ready), "_k").collect()  # k rows
        projection = fit_projection_of_points(ready, [f"{c}_z" for c in features], "_n")
    finally:
        ready.unpersist()
    order = ", ".join(f"{r['_k']}, {r['cluster_id']}" for r in ranks)
    axes = [
        " + ".join(f"`{c}_z` * {_number(w)}" for c, w in zip(features, loadings))
        for loadings in projection.loadings
    ]
    finish = SQLTransformer(
        statement=(
            f"SELECT *, element_at(map({order}), _k) AS cluster_id, "
            f"bround({axes[0]}, 4) AS pca_x, bround({axes[1]}, 4) AS pca_y FROM __THIS__"
        )
    )
    return Profiles(PipelineModel([*prepare, assemble, model, finish]), costs, projection, features)


@dataclass
class Classifier:
    """Forest in one scoring pipeline, with its hold-out predictions."""

    pipeline: PipelineModel
    importances: list[tuple[str, float]]
    holdout: DataFrame  # (real, previsto) of the test rows
    features: list[str]

    def transform(self, df: DataFrame, name: str = "faixa_prevista") -> DataFrame:
        return score_rows(self.pipeline, df, self.features, {"_class": name})


def fit_classifier(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    classes: Sequence[str] = config.CLASSES,
    fraction: float = config.TEST_FRACTION,
    trees: int = config.TREES,
    depth: int = 30,
    seed: int = config.SEED,
    fit_on: str = "train",
    blocks: int | None = BLOCKS,
) -> Classifier:
    """Stratified hold-out, balanced weights, forest.

    Medians come from the training rows only; ``fit_on="all"`` takes them from all
    labelled rows instead. Equal training rows are folded into up to ``blocks`` weighted
    blocks per feature combination: no row is lost, and the training table stays
    small however many rows there are. The trees then resample blocks, not rows, so
    their bootstrap is coarser: a block is drawn as a whole. ``blocks=None`` resamples
    rows and holds them all.
    """
    features = list(features)
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks or 1)).cast("int")
    labelled = df.filter(F.col(label).isin(list(classes))).select(
        *features, label, key_hash(keys).alias("_h"), block.alias("_block")
    )
    # Narrow and settled: the rows are read once, their keys hashed once; later steps read this.
    marked = mark_smallest(settle(labelled, "labelled"), label, fraction)
    marked = settle(marked.select(*features, label, "teste", "_block"), "holdout")
    train = marked.filter(~F.col("teste")).withColumn("_n", F.lit(1.0))
    if blocks:
        folded = train.groupBy(*features, label, "_block").agg(F.sum("_n").alias("_n"))
        train = settle(folded, "training-blocks")
    source, weight = (train, "_n") if fit_on == "train" else (marked, None)
    medians = exact_medians(source, features, weight=weight)
    prepare = _imputer(medians, "_f")
    assemble = VectorAssembler(inputCols=[f"{c}_f" for c in features], outputCol="_fv")
    ready = PipelineModel([prepare, assemble])
    learn = with_class_weight(train, label, weight="_n").withColumns(
        {
            "_y": (class_order(label, tuple(classes)) - 1).cast("double"),
            "peso": F.col("peso") * F.col("_n"),
        }
    )
    rows = ready.transform(learn).select("_fv", "_y", "peso").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_forest(rows, "_fv", "_y", "peso", trees, depth, seed)
    finally:
        rows.unpersist()
    names = ", ".join(f"'{c}'" for c in classes)
    decode = SQLTransformer(
        statement=f"SELECT *, element_at(array({names}), cast(_p AS int) + 1) AS _class FROM __THIS__"
    )
    pipeline = PipelineModel([prepare, assemble, model, decode])
    held = score_rows(pipeline, marked.filter("teste"), features, {"_class": "previsto"}).select(
        F.col(label).alias("real"), "previsto"
    )
    importances = sorted(
        zip(features, (float(x) for x in model.featureImportances.toArray())), key=lambda r: -r[1]
    )
    return Classifier(pipeline, importances, held, features)


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
