"""Grouped counts, means and the statistics built on them.

All of them are declarative aggregates with map-side partials, so a group that
holds a third of the rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microatlas.functions.columns import as_col, code_order, mean, rounded


def total(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def overview(
    df: DataFrame, means: Sequence[str], score: str, digits: int | None = None
) -> DataFrame:
    """Means of several scores with the range of the main one, in one row."""
    return df.agg(
        *[mean(c, digits).alias(f"media_{c}") for c in means],
        F.min(score).alias(f"min_{score}"),
        F.max(score).alias(f"max_{score}"),
    )


def group_mean(
    df: DataFrame,
    dims: Sequence[str | Column],
    measure: str,
    digits: int | None = 2,
    total: str = "total",
    media: str = "media",
) -> DataFrame:
    """Rows and rounded mean per group."""
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias(total), mean(measure, digits).alias(media)
    )


def group_means(
    df: DataFrame,
    dims: Sequence[str | Column],
    measures: Mapping[str, str],
    digits: int | None = 2,
    total: str = "total",
) -> DataFrame:
    """Rows and one rounded mean per measure (``name -> column``)."""
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias(total),
        *[mean(c, digits).alias(name) for name, c in measures.items()],
    )


def count_present(
    df: DataFrame,
    dims: Sequence[str],
    counted: str | None = None,
    measures: Mapping[str, str] | None = None,
    digits: int | None = None,
    total: str = "total",
) -> DataFrame:
    """Group and count a column's non-null values: its null group shows 0."""
    return df.groupBy(*dims).agg(
        F.count(counted or dims[0]).alias(total),
        *[mean(c, digits).alias(name) for name, c in (measures or {}).items()],
    )


def weighted_mean(
    df: DataFrame, dims: Sequence[str], value: str, weight: str, digits: int | None = 2
) -> DataFrame:
    """Mean of group means, weighted by group size."""
    return df.groupBy(*dims).agg(
        F.sum(weight).alias("total"),
        rounded(
            F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), digits
        ).alias("media"),
    )


def conditional_counts(
    df: DataFrame, dims: Sequence[str], cases: Mapping[str, Column]
) -> DataFrame:
    """One count per predicate: a pivot with a known list of classes."""
    return df.groupBy(*dims).agg(*[F.count_if(p).alias(n) for n, p in cases.items()])


def value_counts(df: DataFrame, *columns: str, total: str = "total") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(total))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column as rows, from one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "coluna", "nulos")


def correlation(df: DataFrame, x: str, y: str, digits: int | None = 6) -> DataFrame:
    r = F.corr(F.col(x).cast("double"), F.col(y).cast("double"))
    return df.agg(
        F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"),
        rounded(r, digits).alias("r"),
        rounded(r * r, digits).alias("r2"),
    )


def extremes(groups: DataFrame, name: str, value: str, order: str | None = None) -> DataFrame:
    """Smallest and largest group value with their names; ties go to the first name."""
    tie = F.col(order or name)
    low = F.min(F.struct(F.col(value).alias("v"), tie.alias("t"), F.col(name).alias("n")))
    top = F.min(F.struct((-F.col(value)).alias("v"), tie.alias("t"), F.col(name).alias("n")))
    return groups.filter(F.col(value).isNotNull()).agg(low.alias("lo"), top.alias("hi")).select(
        F.col("lo.n").alias("menor_nome"),
        F.col("lo.v").alias("menor_valor"),
        F.col("hi.n").alias("maior_nome"),
        (-F.col("hi.v")).alias("maior_valor"),
    )


def largest_absolute(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.agg(F.max(F.abs(F.col(column))).alias(name or f"max_abs_{column}"))


def last_over_first(groups: DataFrame, value: str, order: str, digits: int = 1) -> DataFrame:
    """Mean of the last ordered group over the first one (unordered groups are left out)."""
    ordered = groups.filter(F.col(order).isNotNull())
    return ordered.agg(
        F.min_by(value, order).alias("primeiro"), F.max_by(value, order).alias("ultimo")
    ).select(
        "primeiro",
        "ultimo",
        rounded(F.try_divide(F.col("ultimo"), F.col("primeiro")), digits).alias("fator"),
    )


def first_and_last(groups: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """First and last row of an ordered result, side by side."""
    row = F.struct(*columns)
    ends = groups.agg(F.min_by(row, order).alias("p"), F.max_by(row, order).alias("u"))
    return ends.select(
        *[F.col(f"p.{c}").alias(f"primeiro_{c}") for c in columns],
        *[F.col(f"u.{c}").alias(f"ultimo_{c}") for c in columns],
    )


def group_sets(
    df: DataFrame,
    sets: Mapping[str, Sequence[str]],
    measures: Mapping[str, str],
    digits: int | None = 2,
    known: Collection[str] = (),
    cube: bool = False,
) -> DataFrame:
    """Several group-and-mean reports over one scan, stacked under ``relatorio``.

    Every key column is there; those a report does not group by are null in its rows.
    Reports named in ``known`` lose the groups with a null key. Grouping sets make
    Spark read the rows once instead of once per report. With ``cube`` the rows are
    first counted and summed per combination of all keys, so that only combinations,
    not rows, are repeated for each report: for keys whose combinations are few.
    """
    columns = list(dict.fromkeys(c for keys in sets.values() for c in keys))
    if cube:
        sums = [e for c in dict.fromkeys(measures.values()) for e in (F.sum(c).alias(f"_s|{c}"), F.count(c).alias(f"_n|{c}"))]
        df = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"), *sums)
        total = F.sum("_rows")
        means = [
            rounded(F.try_divide(F.sum(f"_s|{c}"), F.sum(f"_n|{c}")), digits).alias(name) for name, c in measures.items()
        ]
    else:
        total = F.count(F.lit(1))
        means = [mean(c, digits).alias(name) for name, c in measures.items()]
    grouped = df.groupingSets(
        [[F.col(c) for c in keys] for keys in sets.values()], *[F.col(c) for c in columns]
    ).agg(F.grouping_id().alias("_gid"), total.alias("total"), *means)
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    gid = {report: sum(bit.values()) - sum(bit[c] for c in keys) for report, keys in sets.items()}
    if len(set(gid.values())) < len(gid):
        raise ValueError("two reports group by the same columns")
    name = F.lit(None).cast("string")
    dropped = F.lit(False)
    for report, keys in sets.items():
        here = F.col("_gid") == F.lit(gid[report])
        name = F.when(here, F.lit(report)).otherwise(name)
        if report in known:
            for c in keys:
                dropped = dropped | (here & F.col(c).isNull())
    return grouped.filter(~dropped).select(name.alias("relatorio"), *columns, "total", *measures)


def covariance_matrix(
    df: DataFrame, columns: Sequence[str], kind: str = "corr", digits: int | None = 6
) -> DataFrame:
    """All pairs of columns as (x, y, valor), from one aggregate row."""
    f = {"corr": F.corr, "covar_pop": F.covar_pop}[kind]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one_row = df.agg(
        *[
            f(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("x"), F.lit(b).alias("y"),
                rounded(F.col(f"`{a}|{b}`"), digits).alias("valor"),
            )
            for a, b in pairs
        ]
    )
    return one_row.select(F.inline(cells))


# --- windows over aggregated rows ---------------------------------------------------
# These windows run on report rows (one per group), never on the rows of the fact.


def share_of_total(groups: DataFrame, count: str = "total", name: str = "pct", digits: int = 1) -> DataFrame:
    """Share of the shown groups' total."""
    return share_within(groups, [], count, name, digits)


def share_within(
    groups: DataFrame,
    parent: Sequence[str],
    count: str = "total",
    name: str = "pct",
    digits: int = 1,
) -> DataFrame:
    """Share inside the parent group (of everything when no parent is named)."""
    whole = F.sum(count).over(W.partitionBy(*parent))
    share = F.when(whole > 0, F.round(F.col(count) * 100.0 / whole, digits)).otherwise(F.lit(0.0))
    return groups.withColumn(name, share)


def change_over_time(
    groups: DataFrame, time: str, value: str, parent: Sequence[str] = (), digits: int = 2
) -> DataFrame:
    """Change against the first and the previous edition of the same group."""
    w = W.partitionBy(*parent).orderBy(time)
    first = F.first_value(F.col(value)).over(w)
    previous = F.lag(value).over(w)
    return groups.select(
        "*",
        F.round(F.col(value) - first, digits).alias("delta_referencia"),
        F.round(F.col(value) - previous, digits).alias("delta_anterior"),
        F.round(F.try_divide((F.col(value) - first) * 100, first), 1).alias("pct_referencia"),
    )


def align_by_rank(
    left: DataFrame, right: DataFrame, left_order: str, right_order: str, left_value: str,
    right_value: str, names: Sequence[str],
) -> DataFrame:
    """Put the i-th category of two ordered series side by side; codes in number order.

    Both sides are report rows (one per category); ranks beyond the named levels
    are dropped (a new level must be named to be shown), a missing one gives null.
    """
    def ranked(df: DataFrame, order: str, value: str) -> DataFrame:
        rank = F.row_number().over(W.orderBy(*code_order(order)))
        return df.select(rank.alias("posicao"), as_col(value).alias(value))

    levels = left.sparkSession.range(0, 1, 1, 1).select(
        F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "grupo")
    ).select((F.col("i") + 1).alias("posicao"), "grupo")
    return (
        levels.join(ranked(left, left_order, left_value), "posicao", "left")
        .join(ranked(right, right_order, right_value), "posicao", "left")
        .orderBy("posicao")
    )
