"""The statistics and the socioeconomic reports from a stored cube, under any filters.

The cube is made once per load: for every report the rows are counted and summed by the
report's keys and all filter columns but the municipality. Those cuts follow from the codes,
not from the rows, so a filtered request reads the cut of its report (a folder of its own) and
never the fact table. Municipalities are many, and by them and the other keys hardly two
rows are alike; so they are not repeated in every cut. One more cut has all keys with
the municipality, for the requests that name one. It is folded where that makes it
smaller; where it does not, a row stays a cell of its own, which needs no shuffle. The answers
are those of the single reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import rounded
from microatlas.operators.filters import with_filters
from microatlas.plans import reports as r
from microatlas.sources import versions

CUT = "corte"
SCORES = ("nt_ger", "nt_fg", "nt_ce")
PLACE = config.FILTER_COLUMNS["municipio"][0]
FILTERS = [column for column, _ in config.FILTER_COLUMNS.values() if column != PLACE]
BY_PLACE = "municipio"  # the cut with all keys
TASKS_A_CORE = 4
FOLDED = 4  # rows a cell, from which the cut by municipality is folded
_STATISTICS = {
    "total_estudantes": [], "media_notas": [], "distribuicao_faixa": r.STATISTICS_SETS["faixa"], "distribuicao_ano": r.STATISTICS_SETS["ano"],
    "distribuicao_curso": r.STATISTICS_SETS["curso"], "distribuicao_regiao": r.STATISTICS_SETS["regiao"],
    "distribuicao_tipo_ies": r.STATISTICS_SETS["tipo_ies"],
}


def _columns(keys: list[str]) -> list[str]:
    return list(dict.fromkeys([*FILTERS, *keys]))


def cuts() -> dict[str, list[str]]:
    """The groupings that are stored: those of the reports, each once."""
    found = {"_".join(_columns(keys)[len(FILTERS) :]) or "filtros": _columns(keys) for keys in [*_STATISTICS.values(), *r.SOCIOECONOMIC_SETS.values()]}
    return dict(sorted(found.items()))


def _cut_of(keys: list[str]) -> str:
    return next(name for name, columns in cuts().items() if columns == _columns(keys))


def _keys() -> list[str]:
    return list(dict.fromkeys([*(c for keys in cuts().values() for c in keys), PLACE]))


def cells(fact: DataFrame) -> DataFrame:
    """A cell per row, with the keys of all cuts: what a row adds to the counts and sums, in
    the types of those. A column that the fact does not have is null."""
    rows = fact.withColumns({c: F.lit(None).cast("string") for c in _keys() if c not in fact.columns})
    known, summed = F.col(r.SCORE).isNotNull(), fact.agg(*[F.sum(c).alias(c) for c in SCORES]).schema
    adds = {"n": F.lit(1).cast("bigint")}
    for c in SCORES:
        adds |= {f"s_{c}": F.col(c).cast(summed[c].dataType), f"n_{c}": F.col(c).isNotNull().cast("bigint")}
        if c != r.SCORE:  # of the score itself these are the sum and the count above
            adds |= {f"k_{c}": F.when(known, F.col(c)).cast(summed[c].dataType), f"kn_{c}": (known & F.col(c).isNotNull()).cast("bigint")}
    # The bounds of one row are its score, which is not written again.
    adds |= {c: F.lit(None).cast(fact.schema[r.SCORE].dataType) for c in ("low", "high")}
    return rows.select(*_keys(), *[e.alias(name) for name, e in adds.items()])


def _sums(cells: DataFrame) -> list[Column]:
    score, found = F.col(f"s_{r.SCORE}"), {"low": F.min, "high": F.max}
    return [(found[c](score) if c in found else F.sum(c)).cast(cells.schema[c].dataType).alias(c) for c in cells.columns if c not in _keys()]


def build(cells: DataFrame) -> DataFrame:
    """All cuts but the one by municipality stacked, from one pass over the cells of rows."""
    sets = cuts()
    columns = [c for c in _keys() if c != PLACE]
    grouped = cells.groupingSets([[F.col(c) for c in keys] for keys in sets.values()], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_gid"), *_sums(cells)
    )
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    name = F.lit(None).cast("string")
    for cut, keys in sets.items():
        name = F.when(F.col("_gid") == sum(bit.values()) - sum(bit[c] for c in keys), F.lit(cut)).otherwise(name)
    return grouped.withColumn(PLACE, F.lit(None).cast(cells.schema[PLACE].dataType)).select(*cells.columns, name.alias(CUT))


def _folds(cells: DataFrame) -> bool:
    """Whether cells by all keys are at most one in ``FOLDED`` rows; mostly the filter columns
    alone tell that they are not."""
    rows = cells.count()
    for keys in ([*FILTERS, PLACE], _keys()):
        if rows < FOLDED * cells.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]:
            return False
    return True


def write(fact: DataFrame, path: str) -> None:
    """Replace the stored cube of a fact table: a folder per cut.

    The fact is read once, into the cells of its rows; these are what all cuts are made of,
    and are served as they are where the cut by municipality is not folded.
    """
    spark = fact.sparkSession

    def cut(folder: str) -> None:
        drafts, place = f"{folder}/_cells", f"{folder}/{CUT}={BY_PLACE}"
        of_rows = cells(fact)
        of_rows.write.option("compression", "zstd").parquet(drafts)
        stored = spark.read.schema(of_rows.schema).parquet(drafts)
        folds = _folds(stored)
        if folds:
            stored.groupBy(*_keys()).agg(*_sums(stored)).write.parquet(place)
        # A task shuffles its cells of all cuts, however many rows it has read: few tasks a core.
        build(stored.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)).write.mode("append").partitionBy(CUT).parquet(folder)
        if folds:
            versions.delete(spark, drafts)
        else:
            versions.rename(spark, drafts, place)

    versions.replace(spark, path, cut)


def read(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path)


def _rows(cube: DataFrame, keys: list[str], filters: r.Filters) -> DataFrame:
    if (filters or {}).get("municipio") in (None, ""):
        return with_filters(cube.filter(F.col(CUT) == _cut_of(keys)), filters)
    score = F.col(f"s_{r.SCORE}")
    bounds = {c: F.coalesce(F.col(c), score.cast(cube.schema[c].dataType)) for c in ("low", "high")}
    return with_filters(cube.filter(F.col(CUT) == BY_PLACE), filters).withColumns(bounds)


def _mean(total: str, count: str) -> Column:
    return rounded(F.try_divide(F.sum(total), F.sum(count)), 2)


def statistics(cube: DataFrame, filters: r.Filters = None, digits: int | None = None) -> dict[str, DataFrame]:
    """The statistics reports of the filtered rows."""
    return {name: r.statistics_of_cube(_rows(cube, keys, filters), digits)[name] for name, keys in _STATISTICS.items()}


def socioeconomic(cube: DataFrame, filters: r.Filters = None) -> dict[str, DataFrame]:
    """The socioeconomic reports of the filtered rows."""

    def cells(report: str, keys: list[str]) -> DataFrame:
        rows = _rows(cube, keys, filters).groupBy(*keys).agg(
            F.sum(f"n_{r.SCORE}").alias("total"), _mean(f"s_{r.SCORE}", f"n_{r.SCORE}").alias("media"),
            _mean("k_nt_fg", "kn_nt_fg").alias("media_fg"), _mean("k_nt_ce", "kn_nt_ce").alias("media_ce"),
        )
        rows = rows.filter("total > 0")
        if report != "renda":  # only income keeps its undeclared group
            rows = rows.dropna(subset=keys)
        return rows.withColumn("relatorio", F.lit(report))

    stacked = [cells(report, keys) for report, keys in r.SOCIOECONOMIC_SETS.items()]
    return r.socioeconomic_of_cells(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked))
