"""Evaluation tables over (actual, predicted) pairs.

The rows are counted once into at most classes x classes cells; everything else
reads those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas import config
from microatlas.functions.columns import class_order, percent
from microatlas.operators.filters import require
from microatlas.operators.reshape import densify



def confusion_counts(df: DataFrame, real: str = "real", predicted: str = "previsto") -> DataFrame:
    pairs = df.select(F.col(real).alias("real"), F.col(predicted).alias("previsto"))
    return (
        require(pairs, "real", "previsto")
        .groupBy("real", "previsto")
        .agg(F.count(F.lit(1)).alias("total"))
    )


def confusion_cells(counts: DataFrame, classes: Sequence[str] = config.CLASSES) -> DataFrame:
    """Every class pair, 0 where none was counted; unknown classes are dropped."""
    return densify(counts, "total", real=classes, previsto=classes)


def confusion_matrix(counts: DataFrame, classes: Sequence[str] = config.CLASSES) -> DataFrame:
    """One row per actual class: counts per predicted class, hits, hit share, totals."""
    cells = confusion_cells(counts, classes)
    rows = cells.groupBy("real").agg(
        *[F.sum(F.when(F.col("previsto") == F.lit(c), F.col("total"))).alias(c) for c in classes],
        F.sum("total").alias("total_real"),
        F.sum(F.when(F.col("previsto") == F.col("real"), F.col("total"))).alias("acerto"),
    )
    return rows.select(
        "*",
        percent(F.col("acerto"), F.col("total_real")).alias("pct_acerto"),
        F.sum("total_real").over(W.partitionBy()).alias("total_matriz"),
    ).orderBy(class_order("real", tuple(classes)))


def accuracy(counts: DataFrame, digits: int = 6) -> DataFrame:
    hits = F.sum(F.when(F.col("real") == F.col("previsto"), F.col("total")).otherwise(0))
    return counts.agg(
        F.round(F.try_divide(hits, F.sum("total")), digits).alias("acuracia"),
        F.sum("total").alias("total"),
    )


def class_report(
    counts: DataFrame, classes: Sequence[str] = config.CLASSES, digits: int | None = 6
) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    cells = confusion_cells(counts, classes)
    hit = F.when(F.col("real") == F.col("previsto"), F.col("total")).otherwise(0)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("real").alias("classe"), hit.alias("tp"), F.col("total").alias("n_real"), F.lit(0).cast("bigint").alias("n_prev")),
                F.struct(F.col("previsto").alias("classe"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("n_real"), F.col("total").alias("n_prev")),
            )
        )
    )
    per_class = (
        sides.groupBy("classe")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "n_real", "n_prev")])
        .select(
            "classe",
            F.coalesce(F.try_divide("tp", "n_prev"), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide("tp", "n_real"), F.lit(0.0)).alias("recall"),
            F.coalesce(
                F.try_divide(F.col("tp") * 2.0, F.col("n_real") + F.col("n_prev")), F.lit(0.0)
            ).alias("f1"),
            F.col("n_real").alias("support"),
        )
    )
    scores = ("precision", "recall", "f1")
    averages = per_class.agg(
        *[F.avg(c).alias(f"m_{c}") for c in scores],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in scores],
        F.sum("support").alias("support"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("classe"),
                        *[F.col(f"{p}_{c}").alias(c) for c in scores],
                        F.col("support"),
                    )
                    for name, p in (("macro avg", "m"), ("weighted avg", "w"))
                ]
            )
        )
    )
    report = per_class.unionByName(averages)
    if digits is None:
        return report
    return report.select("classe", *[F.round(c, digits).alias(c) for c in scores], "support")


def matrix_details(
    counts: DataFrame, focus: str = "medio", classes: Sequence[str] = config.CLASSES
) -> DataFrame:
    """One row of drill-down figures: totals, extremes, errors of one class, far confusions."""
    cells = confusion_cells(counts, classes)
    n = F.col("total")
    same = F.col("real") == F.col("previsto")
    of_focus = F.col("real") == F.lit(focus)
    far = F.abs(class_order("real", tuple(classes)) - class_order("previsto", tuple(classes))) >= F.lit(
        len(classes) - 1
    )
    one = cells.agg(
        F.sum("total").alias("total"),
        F.sum(F.when(same, n)).alias("acertos"),
        F.max(F.when(same, n)).alias("max_diagonal"),
        F.max(F.when(~same, n)).alias("max_fora"),
        F.sum(F.when(of_focus & ~same, n)).alias("erros_classe"),
        F.sum(F.when(of_focus, n)).alias("total_classe"),
        F.sum(F.when(far, n)).alias("confusoes_extremas"),
    )
    return one.select(
        "*",
        percent(F.col("acertos"), F.col("total"), 2).alias("pct_acertos"),
        percent(F.col("erros_classe"), F.col("total_classe")).alias("pct_erros_classe"),
    )


def matrix_shares(counts: DataFrame, classes: Sequence[str] = config.CLASSES) -> DataFrame:
    """Cells with their share of the row, of the column and of everything."""
    cells = confusion_cells(counts, classes)
    n = F.col("total")
    row, column = (F.sum(n).over(W.partitionBy(c)) for c in ("real", "previsto"))
    return cells.select(
        "real",
        "previsto",
        "total",
        row.alias("total_linha"),
        column.alias("total_coluna"),
        percent(n, row).alias("pct_linha"),
        percent(n, F.sum(n).over(W.partitionBy())).alias("pct_total"),
    )


# --- the long metrics table -------------------------------------------------------------
DETAIL = "struct<precision:double,recall:double,`f1-score`:double,support:bigint>"
MATRIX_DETAIL = "struct<classes:array<string>,matrix:array<array<bigint>>,total_teste:bigint>"


def metrics_table(
    importances: DataFrame, counts: DataFrame, classes: Sequence[str] = config.CLASSES
) -> DataFrame:
    """Importances, accuracy, class scores and the matrix as (metrica, chave, valor, detalhe)."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, order: int, key, value, within, detail=none) -> DataFrame:
        return df.select(
            F.lit(order).alias("_o"),
            within.alias("_w"),
            F.lit(kind).alias("metrica"),
            key.alias("chave"),
            F.round(value, 6).alias("valor"),
            detail.alias("detalhe"),
        )

    report = class_report(counts, classes, None)
    detail = F.to_json(
        F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")
    )
    cells = confusion_cells(counts, classes)
    at = [class_order(c, tuple(classes)) for c in ("real", "previsto")]
    lines = cells.groupBy(at[0].alias("i")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(at[1].alias("j"), F.col("total")))),
            lambda x: x["total"],
        ).alias("line"),
        F.sum("total").alias("n"),
    )
    matrix = lines.agg(
        F.to_json(
            F.struct(
                F.array(*[F.lit(c) for c in classes]).alias("classes"),
                F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("matrix"),
                F.sum("n").alias("total_teste"),
            )
        ).alias("detalhe"),
        F.sum("n").cast("double").alias("n"),
    )
    table = (
        rows(importances, "importancia_feature", 0, F.col("feature"), F.col("valor"), -F.col("valor"))
        .unionByName(rows(accuracy(counts), "acuracia_geral", 1, F.lit("random_forest"), F.col("acuracia"), F.lit(0.0)))
        .unionByName(
            rows(
                report, "metricas_classe", 2, F.col("classe"), F.col("f1"),
                F.coalesce(class_order("classe", tuple(classes)), F.lit(len(classes) + 1)).cast("double"),
                detail,
            )
        )
        .unionByName(rows(matrix, "matriz_confusao", 3, F.lit("teste"), F.col("n"), F.lit(0.0), F.col("detalhe")))
    )
    order = W.orderBy("_o", "_w", "chave")  # a dozen rows
    return table.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("id"), "metrica", "chave", "valor", "detalhe"
    )


def metric_accuracy(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("metrica") == "acuracia_geral").select(F.col("valor").alias("acuracia"))


def metric_importances(metrics: DataFrame) -> DataFrame:
    found = metrics.filter(F.col("metrica") == "importancia_feature")
    return found.select(F.col("chave").alias("feature"), "valor").orderBy(F.desc("valor"), "feature")


def metric_classes(metrics: DataFrame, classes: Sequence[str] = config.CLASSES) -> DataFrame:
    """Scores of the main classes, the detail parsed from its JSON."""
    d = F.from_json("detalhe", DETAIL)
    return metrics.filter(
        (F.col("metrica") == "metricas_classe") & F.col("chave").isin(list(classes))
    ).select(
        F.col("chave").alias("classe"),
        F.col("valor").alias("f1"),
        d["precision"].alias("precision"),
        d["recall"].alias("recall"),
        d["support"].alias("support"),
    )


def metric_matrix(metrics: DataFrame) -> DataFrame:
    """The stored matrix as (real, previsto, total) cells."""
    m = metrics.filter(F.col("metrica") == "matriz_confusao").select(
        F.from_json("detalhe", MATRIX_DETAIL).alias("m")
    )
    lines = m.select("m.classes", F.posexplode("m.matrix").alias("i", "line"))
    cells = lines.select("classes", "i", F.posexplode("line").alias("j", "total"))
    return cells.select(
        F.col("classes")[F.col("i")].alias("real"),
        F.col("classes")[F.col("j")].alias("previsto"),
        "total",
    )


def cluster_shares(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("total"))
    return sizes.select(
        cluster, "total", percent(F.col("total"), F.sum("total").over(W.partitionBy())).alias("pct")
    )
