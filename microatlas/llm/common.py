"""Helpers the operators share: text passes, row numbers, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.runtime import settle

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_one(names: Sequence[str]) -> Column:
    """The named columns as one, so that none can clash with an operator's own."""
    return F.struct(*([col(c) for c in names] or [F.lit(0).alias("none")]))


def out_of(whole: str, names: Sequence[str]) -> list[Column]:
    """The columns that ``in_one`` has put together."""
    return [F.col(whole).getField(c).alias(c) for c in names]


def others(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` that an operator returning ``names`` leaves as they are."""
    return [c for c in df.columns if c not in set(names)]


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, made longer until no taken column has it."""
    while name in taken:
        name += "_"
    return name


def by_text(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    compute: Callable[[list[str | None]], Sequence],
    keep: Sequence[str] | None = None,
    prepare: Callable[[], object] | None = None,
) -> DataFrame:
    """Columns computed from whole texts, next to the kept columns.

    ``compute`` gets the texts of one Arrow batch and gives one sequence per field;
    with ``prepare`` it also gets what that makes once per task. Input columns named
    like a new field are replaced.
    """
    names = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    body = free_name("__text", keep)
    source = df.select(*[col(c) for c in keep], col(text).cast("string").alias(body))
    schema = T.StructType([*[source.schema[i] for i in range(len(keep))], *fields])
    kinds = [_arrow_type(f.dataType) for f in fields]
    place = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (prepare(),) if prepare else ()
        for batch in batches:
            values = compute(batch.column(place).to_pylist(), *made)
            new = [pa.array(v, type=k) for v, k in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], *new], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written to the shared folder with a number of their own.

    Repeated rows get different numbers. The numbers are fixed by the committed files,
    so later passes agree whatever the cluster does.
    """
    row = free_name("__row", df.columns)
    return settle(df.withColumn(row, F.monotonically_increasing_id()), name), row


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (a, b) with the smallest node of its component.

    Fewer rows than nodes, with the same components as the links.
    """
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """``node`` with ``root``, the smallest node it is connected to, for all nodes of
    the links (``a``, ``b``) that are not roots themselves.

    Large stars and small stars in turn: every neighbour is linked to the smallest
    one, which halves paths in each round. Minima are combined before the shuffle and
    joined back, so a node with very many links is never one group; every round is
    written to the shared folder.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        "links",
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").filter("b > a").select(
            F.col("b").alias("a"), F.least("m", "a").alias("b")
        ).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # The mark is taken on the settled copy, so that each round runs once.
        edges = settle(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        mark = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
