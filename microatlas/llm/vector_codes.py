"""Vector compression by codebooks of the vectors' parts, in exact integers.

Every part of the vectors is laid out once: its points are sorted along a Hilbert curve
and cut into flat blocks, each a row with all its points, their smallest box and their
sums. A round of the codebooks reads the blocks. From a block's box it is known which
entries are farther from all of it than the one nearest to its middle; the others are the
block's shortlist. A shortlist of one takes the block's stored sums as they are; otherwise
a small kernel finds the nearest entry of the shortlist for every point. All numbers are
integers, and sums are the same in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import col, in_one, numbered, others, out_of
from microatlas.runtime import settle

#: Scaled components beyond this have no exact squared distance in 64 bits.
GREATEST = 1 << 25
EXACT = float(1 << 53)  # integers below it are exact in doubles


@dataclass(frozen=True)
class Settings:
    """``scale`` makes integers of components, ``entries`` is at most 256 (two hex digits)."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    block: int = 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of coordinates below ``2**bits``) on a Hilbert curve.

    Coordinates are turned into the curve's index from the highest bit down: where a
    coordinate's bit is set, the lower bits of the first one are inverted, else exchanged
    with its own; then a Gray code over the coordinates is undone.
    """
    x = cells.T.astype(np.uint64)
    n = len(x)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for i in range(n):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(bit)) & one != 0, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key


def integers(df: DataFrame, vector: str, keep: list[str], settings: Settings) -> DataFrame:
    """Kept columns with ``size`` and ``raw``, the scaled integers of the valid vectors;
    ``raw`` is null where a component is too great. Other rows are dropped."""
    source = df.select(*[col(c) for c in keep], col(vector).cast("array<double>").alias("vector"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("size", T.IntegerType()), T.StructField("raw", T.BinaryType())])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rows, sizes, raws = batch.column(at), [], [], []
            for i in range(batch.num_rows):
                item = vectors[i].values
                if item is None or item.null_count:
                    continue
                v = item.to_numpy(zero_copy_only=False)
                if np.isfinite(v).all():
                    whole = np.floor(v * settings.scale)
                    rows.append(i)
                    sizes.append(len(v))
                    raws.append(whole.astype("<i4").tobytes() if (np.abs(whole) <= GREATEST).all() else None)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:at], pa.array(sizes, pa.int32()), pa.array(raws, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def _matrix(raws: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<i4").reshape(len(raws), size)


def ranges(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and greatest value of every component: one row per task and component,
    combined by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0).to_pylist(), size)
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))], names=["i", "low", "high"])

    found = rows.select("raw").mapInArrow(run, "i bigint, low bigint, high bigint").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    at = sorted((r.i, r.low, r.high) for r in found)
    return np.array([r[1] for r in at]), np.array([r[2] for r in at])


def blocks(rows: DataFrame, size: int, settings: Settings) -> DataFrame:
    """The points of each part in Hilbert order, cut into flat blocks and settled:
    ``part``, ``ids`` and ``points`` of the block, its box ``low``/``high`` and ``sums``."""
    low, high = ranges(rows, size)
    width = size // settings.parts
    wide = max(1, min(width, 32))  # coordinates of a key: those that vary most
    bits = min(16, 64 // wide)
    axes = []
    for p in range(settings.parts):
        spread = (high - low)[p * width : (p + 1) * width]
        axes.append(np.sort(np.argsort(-spread, kind="stable")[:wide]) + p * width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1).to_pylist(), size)
            for p, own in enumerate(axes):
                cells = ((m[:, own] - low[own]).astype(np.int64) << bits) // (high[own] - low[own] + 1)
                key = (hilbert_keys(cells, bits) ^ np.uint64(1 << 63)).view(np.int64)
                points = np.ascontiguousarray(m[:, p * width : (p + 1) * width])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(m), p, np.int32)), pa.array(key), batch.column(0), pa.array([x.tobytes() for x in points], pa.binary())],
                    names=["part", "key", "id", "point"],
                )

    dealt = rows.select("id", "raw").mapInArrow(deal, "part int, key bigint, id bigint, point binary")
    # The number breaks ties, so that very many equal points fill several ranges.
    ordered = dealt.repartitionByRange("part", "key", "id").sortWithinPartitions("part", "key", "id")
    names = ["part", "ids", "points", "low", "high", "sums"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        part = None
        out: list[tuple] = []

        def close() -> None:
            m = _matrix([x for _, x in held], width).astype("<i8")
            ids = np.array([i for i, _ in held], "<i8")
            out.append((part, ids.tobytes(), b"".join([x for _, x in held]), m.min(0).tobytes(), m.max(0).tobytes(), m.sum(0).tobytes()))
            held.clear()

        def sent() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(columns)], names=names)

        for batch in batches:
            for p, i, x in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)]):
                if held and (p != part or len(held) == settings.block):
                    close()
                part = p
                held.append((i, x))
            if out:
                yield sent()
        if held:
            close()
            yield sent()

    return settle(ordered.mapInArrow(cut, "part int, ids binary, points binary, low binary, high binary, sums binary"), "hilbert-blocks")


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each box (rows of ``low`` and ``high``), which entries may be nearest to a point in it.

    The entry nearest to the box's middle stands against every other one at the corner that
    suits the other best; an entry that is farther even there is farther everywhere.
    """
    middle = (low + high) / 2
    best = book[((middle[:, None, :] - book[None]) ** 2).sum(2).argmin(1)][:, None, :]
    corner = np.where(book[None] > best, high[:, None, :], low[:, None, :])
    return ((corner - book[None]) ** 2).sum(2) <= ((corner - best) ** 2).sum(2)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest row of ``book`` for each point, the lower of equals, and the
    squared distance. In doubles where they hold every sum exactly, else in integers."""
    greatest = float(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * greatest * greatest * max(1, points.shape[1]) < EXACT else np.int64
    x, c = points.astype(kind), book.astype(kind)
    table = (c * c).sum(1)[None] - 2 * (x @ c.T)
    at = table.argmin(1)
    return at, ((x * x).sum(1) + table[np.arange(len(x)), at]).astype(np.int64)


def _opened(batch: pa.RecordBatch, width: int, books: np.ndarray):
    """Part, ids, points, sums and shortlist of each block of a batch."""
    parts = batch.column(0).to_numpy()
    sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8").reshape(-1, width) for c in (3, 4, 5)]
    step = max(1, (1 << 20) // max(1, width * books.shape[1]))
    for at in range(0, len(parts), step):
        for p in np.unique(parts[at : at + step]):
            own = at + np.flatnonzero(parts[at : at + step] == p)
            for i, near in zip(own.tolist(), shortlists(sides[0][own], sides[1][own], books[p])):
                ids = np.frombuffer(batch.column(1)[i].as_py(), "<i8")
                points = np.frombuffer(batch.column(2)[i].as_py(), "<i4").reshape(len(ids), width).astype(np.int64)
                yield int(p), ids, points, sides[2][i], np.flatnonzero(near)


def next_books(laid: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round.

    Every task sums up its points by entry; the sums of all tasks, at most one row per
    entry and component, reach the driver. Entries without points stay.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for p, ids, points, whole, near in _opened(batch, width, books):
                if len(near) == 1:
                    sums[p, near[0]] += whole
                    counts[p, near[0]] += len(ids)
                else:
                    at = near[nearest(points, books[p][near])[0]]
                    np.add.at(sums[p], at, points)
                    counts[p] += np.bincount(at, minlength=entries)
        table = np.concatenate([counts[:, :, None], sums], axis=2)
        p, e, i = (x.ravel() for x in np.indices(table.shape))
        used = counts[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (p, e, i, table.ravel())], names=["p", "e", "i", "s"])

    summed = laid.mapInArrow(run, "p bigint, e bigint, i bigint, s bigint").groupBy("p", "e", "i").agg(F.sum("s").alias("s")).collect()
    table = np.zeros((parts, entries, width + 1), np.int64)
    for p, e, i, s in summed:
        table[p, e, i] = s
    counts = table[:, :, :1]
    return np.where(counts > 0, table[:, :, 1:] // np.maximum(counts, 1), books)


def assigned(laid: DataFrame, books: np.ndarray) -> DataFrame:
    """``id``, ``part``, ``entry`` and squared distance ``square`` of every point."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, ids, points, _, near in _opened(batch, width, books):
                at, square = nearest(points, books[p][near])
                found.append((ids, np.full(len(ids), p, np.int32), near[at].astype(np.int32), square))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["id", "part", "entry", "square"])

    return laid.mapInArrow(run, "id bigint, part int, entry int, square bigint")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", keep: list[str] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Every valid row with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    ``code`` has two hex digits per part; ``error`` is the squared distance to the entries,
    ``label_error`` its sum over rows with an equal label, nulls together. Codebooks begin
    as the parts of the rows with the smallest ids (null ids last, equal ids by their
    vectors; fewer rows make smaller codebooks). Rows whose vector is null or holds null or
    non-finite components are dropped. All others stay, repeated rows too; where a vector's
    length is not the commonest one that the number of parts divides (of equally common
    ones the shortest; empty vectors have none), or a component is beyond 2**25 after scaling,
    code and error are null and the codebooks do not see it. An empty table gives none. Input
    columns named like a result are replaced; the vector is returned only if it is among ``keep``.
    """
    new = ["code", "error", "label_error", "codebooks_sha256"]
    kept = [c for c in (keep if keep is not None else others(df, [vector])) if c not in new]
    source = df.select(in_one(kept).alias("whole_row"), col(id_column).alias("own"), col(label).alias("label"), col(vector).alias("vector"))
    rows, number = numbered(integers(source, "vector", ["whole_row", "own", "label"], settings), "vectors")
    rows = rows.withColumnRenamed(number, "id")
    usual = rows.filter(F.col("raw").isNotNull() & (F.col("size") > 0) & (F.col("size") % settings.parts == 0))
    sizes = usual.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size = sizes[0][0] if sizes else settings.parts
    fit = usual.filter(F.col("size") == size)
    first = fit.select("own", "raw").orderBy(F.col("own").asc_nulls_last(), "raw").limit(settings.entries).collect()
    width = size // settings.parts
    seeds = _matrix([r.raw for r in first], size).astype(np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(first), settings.parts, width).transpose(1, 0, 2))
    if first:
        laid = blocks(fit, size, settings)
        for _ in range(settings.rounds):
            books = next_books(laid, books)
        points = assigned(laid, books)
    else:
        points = rows.sparkSession.createDataFrame([], "id bigint, part int, entry int, square bigint")
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))).cast("bigint"))), 2, "0") for p in range(settings.parts)]
    coded = points.groupBy("id").agg(F.concat(*digits).alias("code"), F.sum("square").alias("error"))
    named = settle(rows.select("id", "whole_row", "label").join(coded, "id", "left"), "vector-codes")
    sums = settle(named.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own_label"), "label-errors")
    # One row per label on one side: AQE splits a label that very many rows have.
    out = named.join(sums, F.col("label").eqNullSafe(F.col("own_label")))
    return out.select(*out_of("whole_row", kept), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
