"""The batch job: raw fragments -> clean rows -> model columns -> fact and metrics.

Each stage reads the Parquet layer of the one before and writes its own, so a stage
can be run again alone and a lost executor costs recomputed tasks only.

    extract    fragments            -> <base>/raw, <base>/load_report, <base>/fragment_report, <base>/rejects
    transform  raw                  -> <base>/clean, <base>/profile
    ml         clean                -> <base>/scored, <base>/metrics, <base>/models
    load       scored               -> <base>/fact, <base>/cube
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import label
from microatlas.operators import evaluate, models
from microatlas.operators.cleaning import clean, drop_control
from microatlas.operators.scores import encode_categories, normalise_within, quantile_bands
from microatlas.plans import cube, reports
from microatlas.runtime import owned_scratch, settle
from microatlas.sources import fragments, tables

STAGES = ("extract", "transform", "ml", "load")


@dataclass
class Settings:
    folders: Mapping[int, str]
    base: str
    codes: Sequence[int] = tuple(config.COURSE_NAMES)
    on_error: str = "fail"
    save_csv: bool = False
    clusters: int = config.CLUSTERS
    seeds: Sequence[int] = tuple(range(config.SEED, config.SEED + config.KMEANS_RESTARTS))
    iterations: int = config.KMEANS_ITERATIONS
    trees: int = config.TREES
    depth: int = 30
    forest_blocks: int | None = models.BLOCKS
    stages: Sequence[str] = field(default=STAGES)

    def path(self, layer: str) -> str:
        return f"{self.base.rstrip('/')}/{layer}"


def extract(spark: SparkSession, s: Settings) -> None:
    """Assemble the editions and number the rows."""
    done = fragments.load(spark, s.folders, s.codes, on_error=s.on_error, with_id=True)
    done.rows.write.mode("overwrite").partitionBy(config.YEAR_COLUMN).parquet(s.path("raw"))
    # Ids were given to the kept identification rows: a row lost since then leaves a gap.
    rows_, ids, top, total = spark.read.parquet(s.path("raw")).agg(
        F.count(F.lit(1)), F.count("id"), F.max("id"), F.sum(F.col("id").cast("decimal(38,0)"))
    ).first()
    if rows_ and (ids != rows_ or top != rows_ - 1 or 2 * int(total) != rows_ * (rows_ - 1)):
        raise RuntimeError(f"raw layer of {rows_} rows has {ids} ids up to {top}")
    done.report.write.mode("overwrite").parquet(s.path("load_report"))
    done.fragments.write.mode("overwrite").parquet(s.path("fragment_report"))
    done.rejects.write.mode("overwrite").parquet(s.path("rejects"))


def derive(rows: DataFrame) -> DataFrame:
    """Clean typed rows with normalised score, band and labels.

    Source codes stay as they are; the encoded features are extra columns.
    """
    rows = normalise_within(rows, "NT_GER", "NU_ANO", "NT_GER_NORM")
    rows = quantile_bands(rows, "NT_GER_NORM", "FAIXA_NOTA")
    return rows.withColumns(
        {
            "REGIAO_LABEL": label("CO_REGIAO_CURSO", config.REGION_NAMES),
            "CATEGAD_LABEL": label("CO_CATEGAD", config.CATEGORY_NAMES),
            "CURSO_LABEL": label("CO_GRUPO", config.COURSE_NAMES),
            "RENDA_LABEL": label("QE_I05", config.INCOME_NAMES),
            "ESCOLA_EM_LABEL": label("QE_I02", config.SCHOOL_NAMES),
            "MODALIDADE_LABEL": label("CO_MODALIDADE", config.MODALITY_NAMES),
            "TIPO_ENSINO": label("CO_GRUPO", config.COURSE_TEACHING_TYPE),
            "UF_SIGLA": label("CO_UF_CURSO", config.STATE_INITIALS),
            "UF_NOME": label("CO_UF_CURSO", config.STATE_NAMES),
        }
    )


def transform(spark: SparkSession, s: Settings) -> None:
    raw = spark.read.parquet(s.path("raw"))
    raw = raw.withColumn(config.YEAR_COLUMN, F.col(config.YEAR_COLUMN).cast("string"))
    # Parsed once: group statistics, cuts and codes all read this, not the raw text.
    typed = settle(clean(raw), "typed")
    derived = derive(typed)
    encoded = encode_categories(derived, [c for c in config.FEATURES if c in derived.columns])
    done = drop_control(encoded)
    done.write.mode("overwrite").parquet(s.path("clean"))
    cleaned = spark.read.parquet(s.path("clean"))
    for name, rows in profile(cleaned).items():
        rows.write.mode("overwrite").parquet(s.path(f"profile/{name}"))
    if s.save_csv:
        tables.write_csv(cleaned, s.path("clean_csv"))


def profile(rows: DataFrame) -> dict[str, DataFrame]:
    """What the cleaned layer holds: rows by edition and course, and nulls by column."""
    return {
        "rows_by_year": reports.rows_by(rows, config.YEAR_COLUMN),
        "rows_by_course": reports.rows_by(rows, config.GROUP_COLUMN),
        "nulls_by_column": reports.nulls_by_column(rows),
    }


def _coded(rows: DataFrame) -> list[str]:
    """The encoded features that exist: a question no edition asked is left out."""
    return [f"{c}_code" for c in config.FEATURES if f"{c}_code" in rows.columns]


def ml(spark: SparkSession, s: Settings) -> None:
    rows = spark.read.parquet(s.path("clean"))
    features = _coded(rows)
    profiles = models.fit_profiles(rows, features, "NT_GER", s.clusters, s.seeds, s.iterations)
    forest = models.fit_classifier(
        rows, features, "FAIXA_NOTA", ["id"], trees=s.trees, depth=s.depth, blocks=s.forest_blocks
    )
    scored = forest.transform(profiles.transform(rows), "FAIXA_PREVISTA")
    named = scored.withColumnsRenamed({"cluster_id": "CLUSTER_ID", "pca_x": "PCA_X", "pca_y": "PCA_Y"})
    named.write.mode("overwrite").parquet(s.path("scored"))
    importances = models.importance_rows(
        spark,
        [name.removesuffix("_code") for name, _ in forest.importances],
        [value for _, value in forest.importances],
    )
    counts = evaluate.confusion_counts(forest.holdout)
    tables.write_metrics(evaluate.metrics_table(importances, counts), s.path("metrics"))
    models.save_pipeline(profiles.pipeline, s.path("models/profiles"))
    models.save_pipeline(forest.pipeline, s.path("models/forest"))


def load(spark: SparkSession, s: Settings) -> None:
    """The serving table: encoded features under their serving names, as reports expect."""
    rows = spark.read.parquet(s.path("scored"))
    serving = rows.withColumns({c.removesuffix("_code"): F.col(c) for c in _coded(rows)})
    tables.write_fact(tables.fact_layout(serving), s.path("fact"))
    cube.write(tables.read_fact(spark, s.path("fact")), s.path("cube"))


def run(spark: SparkSession, settings: Settings) -> None:
    """Run the asked stages in order."""
    todo = {"extract": extract, "transform": transform, "ml": ml, "load": load}
    for stage in STAGES:
        if stage in settings.stages:
            with owned_scratch(spark):  # a stage's result is written by its end
                todo[stage](spark, settings)
