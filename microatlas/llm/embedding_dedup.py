"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so a threshold on the cosine is a
distance epsilon. Vectors are projected on the leading principal dimensions, with the length of
what is left as one coordinate more; there they are no farther apart than they are. They are
sorted by their cells in a grid of width epsilon.
The sorted sequence is cut into blocks. Intervals of the sequence are joined
recursively from the whole down to pairs of blocks; two intervals whose boxes are more than
epsilon apart, or that share no group, are left out with all that is in them. The pairs that
stay are compared in tiles of neighbouring blocks, so that a block travels once a tile, not
once a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import col, components, in_one, numbered, others, out_of, star_edges
from microatlas.runtime import settle

FAN = 16
BLOCK = 512
#: Directions carried by the search for the leading ones beyond those asked for.
SPARE = 4
#: Bytes of one side of a tile, as a task holds it in doubles.
TILE_BYTES = 32 << 20


def number_type(df: DataFrame, vector: str) -> str:
    """How vectors are held: as they come, which for floats is half of doubles."""
    return "<f4" if df.select(col(vector)).schema[0].dataType == T.ArrayType(T.FloatType()) else "<f8"


def units_of(raw: bytes, rows: int, kind: str) -> np.ndarray:
    """Held vectors as rows of length one, in double precision."""
    v = np.frombuffer(raw, kind).reshape(rows, -1).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # no square over- or underflows
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def keyed(df: DataFrame, vector: str, label: str, keep: list[str]) -> DataFrame:
    """Kept columns with ``digest`` of (label, vector) and ``raw``, the vector's numbers;
    both null where it links with nothing."""
    kind = number_type(df, vector)
    source = df.select(*[col(c) for c in keep], col(label).cast("string").alias("__label"), col(vector).cast("array<double>").alias("__vector"))
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("grp", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, digests, raws = [], [], []
            vectors = batch.column(len(keep) + 1)
            for i, name in enumerate(batch.column(len(keep)).to_pylist()):
                group = digest = raw = None
                item = vectors[i].values
                if name is not None and item is not None and len(item) and not item.null_count:
                    v = item.to_numpy(zero_copy_only=False)
                    if np.isfinite(v).all() and v.any():
                        raw = v.astype(kind).tobytes()
                        group = f"{len(v):09d}:{name}"
                        digest = hashlib.blake2b(group.encode() + b"\0" + raw, digest_size=16).digest()
                groups.append(group)
                digests.append(digest)
                raws.append(raw)
            new = [pa.array(groups, pa.string()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=schema.names)

    return source.mapInArrow(run, schema)


def principal_axes(entries: DataFrame, kind: str, dimensions: int) -> np.ndarray:
    """Orthonormal columns near the leading eigenvectors of the second moments of all
    vectors (shorter ones padded with zeros).

    Two passes multiply the moments by a few directions; a task sums its own products, and
    vector length times directions of numbers reach the driver, never the moments. What the
    axes miss costs skipped blocks, not links.
    """
    longest = entries.agg(F.max(F.octet_length("raw"))).first()[0] or 0
    n = longest // np.dtype(kind).itemsize
    directions = np.random.default_rng(0).normal(size=(n, min(n, dimensions + SPARE)))
    if not n:
        return directions
    directions = np.linalg.qr(directions)[0]
    directions = np.linalg.qr(_moments_times(entries, kind, directions))[0]
    small = directions.T @ _moments_times(entries, kind, directions)
    return directions @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :dimensions]


def _moments_times(entries: DataFrame, kind: str, directions: np.ndarray) -> np.ndarray:
    """The sum of x (x . d) over all vectors x, for each direction d."""
    n, k = directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, k))
        for batch in batches:
            by_length: dict[int, list[bytes]] = {}
            for raw in batch.column(0).to_pylist():
                by_length.setdefault(len(raw), []).append(raw)
            for same in by_length.values():
                m = units_of(b"".join(same), len(same), kind)
                total[: m.shape[1]] += m.T @ (m @ directions[: m.shape[1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * k)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(n * k)
    for i, v in entries.select("raw").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out.reshape(n, k)


def grid_blocks(entries: DataFrame, kind: str, axes: np.ndarray, epsilon: float, block: int = BLOCK) -> DataFrame:
    """The vectors in grid order, cut into blocks of one group each: ``seq`` (the block's
    place), ``grp``, box ``low``/``high`` on the axes and the length beside them, ``ids``,
    ``copies`` and ``vectors``."""
    k = axes.shape[1] + 1

    def point(v: np.ndarray) -> np.ndarray:
        p = v @ axes[: len(v)]
        rest = -(axes @ p)
        rest[: len(v)] += v
        return np.append(p, math.sqrt(rest @ rest))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [units_of(r, 1, kind)[0] for r in batch.column(3).to_pylist()]
            places = np.array([point(v) for v in points]).reshape(-1, k)
            cells = np.floor(places / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(places), pa.list_(pa.float64()))],
                names=["id", "copies", "grp", "raw", "cell", "point"],
            )

    schema = "id bigint, copies bigint, grp string, raw binary, cell array<int>, point array<double>"
    ordered = entries.select("id", "copies", "grp", "raw").mapInArrow(project, schema).orderBy("grp", "cell", "id")
    fields = "part bigint, nth bigint, grp string, low array<double>, high array<double>, ids array<bigint>, copies array<bigint>, vectors binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, group = TaskContext.get().partitionId(), 0, [], None

        def row() -> pa.RecordBatch:
            points = np.array([r[4] for r in held])
            values = (part, nth, group, points.min(0).tolist(), points.max(0).tolist(), [r[0] for r in held], [r[1] for r in held], b"".join(r[3] for r in held))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            for r in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]):
                if held and (r[2] != group or len(held) == block):
                    yield row()
                    held, nth = [], nth + 1
                group = r[2]
                held.append(r)
        if held:
            yield row()

    blocks = settle(ordered.mapInArrow(cut, fields), "grid-blocks")
    # One row per partition enters this window.
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return settle(blocks.join(settle(starts, "block-starts"), "part").withColumn("seq", F.col("start") + F.col("nth")).drop("part", "nth", "start"), "blocks")


def _near(epsilon: float, k: int):
    """Whether the boxes of rows x and y share a group and are within epsilon."""
    gaps = [
        F.greatest(F.lit(0.0), F.col("y.low")[d] - F.col("x.high")[d], F.col("x.low")[d] - F.col("y.high")[d]) for d in range(k)
    ]
    square = sum((g * g for g in gaps), F.lit(0.0))
    groups = (F.col("x.first") <= F.col("y.last")) & (F.col("y.first") <= F.col("x.last"))
    return groups & (square <= epsilon * epsilon + 1e-9)


def block_pairs(blocks: DataFrame, epsilon: float, k: int) -> DataFrame:
    """Pairs (``i`` <= ``j``) of blocks that may hold a link.

    Intervals are FAN times longer on every level. The pairs of a level are opened into
    those of their parts, and what is provably distant is not opened.
    """
    spark = blocks.sparkSession
    levels = [settle(blocks.select("seq", F.col("grp").alias("first"), F.col("grp").alias("last"), "low", "high"), "intervals")]
    while levels[-1].count() > FAN:
        boxes = [F.array(*[fold(F.col(side)[d]) for d in range(k)]).alias(side) for side, fold in (("low", F.min), ("high", F.max))]
        upper = levels[-1].groupBy(F.shiftright("seq", int(math.log2(FAN))).alias("seq")).agg(F.min("first").alias("first"), F.max("last").alias("last"), *boxes)
        levels.append(settle(upper, "intervals"))
    top = spark.range(FAN).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(FAN - 1))).alias("j"))
    pairs = top
    for level, nodes in enumerate(reversed(levels)):
        if level:
            child = lambda c: F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)
            pairs = pairs.select(F.explode(child("i")).alias("i"), "j").select("i", F.explode(child("j")).alias("j")).filter("i <= j")
        x, y = nodes.alias("x"), nodes.alias("y")
        kept = pairs.join(x, F.col("i") == F.col("x.seq")).join(y, F.col("j") == F.col("y.seq")).filter(_near(epsilon, k))
        pairs = settle(kept.select("i", "j"), "interval-pairs")
    return pairs


def tile_side(vector_bytes: int, block: int) -> int:
    """Blocks along a tile, a power of two: as many as ``TILE_BYTES`` hold, at most ``FAN``."""
    fit = max(1, TILE_BYTES // max(1, vector_bytes * block))
    return min(FAN, 1 << (fit.bit_length() - 1))


def join_blocks(blocks: DataFrame, pairs: DataFrame, kind: str, threshold: float, side: int = FAN) -> DataFrame:
    """For the pairs of blocks, rows (``a``, ``b``, ``n``): with ``b`` a star edge of the
    links found, with ``n`` the links of ``a`` counted with copies.

    A tile is ``side`` by ``side`` pairs. Its task holds the first blocks of the pairs and
    streams the second ones, each with the list of those it meets.
    """
    tile = [F.expr(f"{c} div {side}").alias(t) for c, t in (("i", "ti"), ("j", "tj"))]
    none = F.lit(None).cast("array<bigint>").alias("meets")
    held = pairs.select(*tile, F.lit(0).alias("second"), F.col("i").alias("seq"), none).distinct()
    # A list has at most ``side`` entries.
    streamed = pairs.select(*tile, "i", F.col("j").alias("seq")).groupBy("ti", "tj", "seq").agg(F.sort_array(F.collect_list("i")).alias("meets"))
    needed = settle(held.unionByName(streamed.withColumn("second", F.lit(1))), "tiles")
    tiles = needed.select("ti", "tj").distinct().count()
    tasks = max(1, min(tiles, max(4 * blocks.sparkSession.sparkContext.defaultParallelism, tiles // FAN)))
    sent = needed.join(blocks.select("seq", "ids", "copies", "vectors"), "seq")
    order = ["ti", "tj", "second", "seq"]
    dealt = sent.select(*order, "meets", "ids", "copies", "vectors").repartition(tasks, "ti", "tj").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                ti, tj, second, seq, meets = (batch.column(c)[r].as_py() for c in range(5))
                if (ti, tj) != at:
                    at, first = (ti, tj), {}
                ids, copies = (batch.column(c)[r].values.to_numpy() for c in (5, 6))
                own = ids, copies, units_of(batch.column(7)[r].as_py(), len(ids), kind)
                if not second:
                    # What is held must not keep its Arrow batch.
                    first[seq] = ids.copy(), copies.copy(), own[2]
                    continue
                for i in meets:
                    yield from compared(first[i], own, i == seq)

    def compared(x: tuple, y: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        if x[2].shape[1] != y[2].shape[1]:
            return
        linked = x[2] @ y[2].T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        u, v = np.nonzero(linked)
        if not len(u):
            return
        found = [(x[0], np.bincount(u, y[1][v], len(x[0])).astype(np.int64))]
        if not same:
            found.append((y[0], np.bincount(v, x[1][u], len(y[0])).astype(np.int64)))
        for ids, n in found:
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(n[some])], names=["a", "b", "n"])
        a, b = star_edges(x[0][u], y[0][v])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])

    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicates(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
    dimensions: int = 4, block: int = BLOCK, keep: list[str] | None = None,
) -> DataFrame:
    """Every row with ``n_links``, ``component_id`` and ``kept``.

    Rows link when labels are equal and not null and the cosine, in double precision, is
    at least ``threshold`` (above 0). Vectors of different lengths do not link, nor do those that are null,
    empty, zero or hold nulls, NaN or infinities. Copies of a vector are one entry of
    the join and link with each other. ``component_id`` is the smallest non-null id of
    the component, ``kept`` whether it is the row's own (rows with a null id: false).
    Repeated rows stay; an empty table gives none. Input columns named like a result are
    replaced; the vector is returned only if it is among ``keep``.
    """
    new = ["n_links", "component_id", "kept"]
    kept = [c for c in (keep if keep is not None else others(df, [vector])) if c not in new]
    source = df.select(in_one(kept).alias("whole_row"), col(id_column).alias("own"), col(label).alias("label"), col(vector).alias("vector"))
    rows = settle(keyed(source, "vector", "label", ["whole_row", "own"]), "embeddings")
    valid = rows.filter("digest IS NOT NULL")
    # One entry for each distinct vector, combined before the shuffle.
    entries = valid.groupBy("digest").agg(F.min("own").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("grp").alias("grp"), F.first("raw").alias("raw"))
    entries, number = numbered(entries, "vectors")
    units = entries.select(F.col(number).alias("id"), "copies", "grp", "raw", "digest", "low")
    kind = number_type(df, vector)
    epsilon = math.sqrt(2 - 2 * threshold)
    axes = principal_axes(units, kind, dimensions)
    blocks = grid_blocks(units, kind, axes, epsilon, block)
    pairs = block_pairs(blocks, epsilon, axes.shape[1] + 1)
    found = settle(join_blocks(blocks, pairs, kind, threshold, tile_side(8 * len(axes), block)), "links")
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    rooted = units.select("id", "digest", "low", "copies").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").join(counts, "id", "left").select(
        "digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links")
    )
    out = rows.select("whole_row", "own", "digest").join(settle(named, "vector-components"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("own")).otherwise(F.col("component_id"))
    return out.select(
        *out_of("whole_row", kept), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("own"), F.lit(False)).alias("kept"),
    )
