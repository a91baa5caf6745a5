"""Near-duplicates by SimHash fingerprints, searched with pivot distance tables.

A fingerprint's row of the pivot table holds its Hamming distances to a fixed set of
reference fingerprints. By the triangle inequality two fingerprints within ``radius``
bits differ by at most ``radius`` in every coordinate, so a pair whose largest
coordinate difference is greater is discarded without looking at it; survivors are
verified bit by bit.

The table is not scanned for all pairs. Fingerprints are cut into ``blocks`` bands: two
within ``radius`` bits agree on at least ``blocks - radius`` of them, so they meet under
a key of that many bands. Under a key, rows are sorted by the first pivot distance and
compared only inside its window. Keys with very many fingerprints are tiled over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import by_text, col, components, in_one, numbered, others, out_of, star_edges
from microatlas.runtime import settle

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 4) -> tuple[int, int]:
    """64 majority bits over the XXH64 of all shingles, and the number of words.

    Words are split at ASCII white space after lower-casing A-Z. A text with fewer
    words than a shingle has one shingle, the whole sequence; one without words, or
    null, has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[min(words_per_shingle, len(words)) - 1 :]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(at + CHUNK, n)].tolist(), stops[at : at + CHUNK].tolist())
        raw = b"".join([digest(joined[s:e], SEED) for s, e in pairs])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big"), len(words)


def references(count: int) -> np.ndarray:
    """Fixed reference fingerprints, well spread: a mixed counter."""
    x = (np.arange(1, count + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def with_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = 4) -> DataFrame:
    """``df`` with ``fp`` (the 64 bits as a signed long)."""

    def compute(texts):
        return [np.array([fingerprint(t, words)[0] for t in texts], np.uint64).view(np.int64)]

    return by_text(df, text, [T.StructField("fp", T.LongType())], compute, keep)


def pivot_table(fingerprints: DataFrame, pivots: int) -> DataFrame:
    """Each distinct ``fp`` with ``pivot``, one byte for the distance to each reference."""
    points = references(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ points[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in table], pa.binary())], names=["fp", "pivot"]
            )

    return fingerprints.mapInArrow(run, "fp bigint, pivot binary")


def _bands(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each band."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [(sum(widths[i + 1 :]), w) for i, w in enumerate(widths)]


def blocks_for(fingerprints: int, radius: int, crowd: int = 64, most: int = 12) -> int:
    """How many bands: as few as let a key be shared by about ``crowd`` fingerprints.

    The links are the same with any number above ``radius``. More bands make longer keys but
    more of them: 15 keys of 21 bits for 6 bands and 4 bits, 70 of 32 for 8.
    """
    for blocks in range(radius + 2, most + 1):
        bits = sum(sorted(width for _, width in _bands(blocks))[: blocks - radius])
        if fingerprints >> bits <= crowd:
            return blocks
    return max(most, radius + 1)


def full_buckets(dealt: DataFrame, deals: int, tile: int) -> tuple[DataFrame, Column]:
    """Hash buckets of keys with more than ``tile`` of the ``deals`` rows, and a row's bucket.

    Nearly every key is rare, so a count by key holds about as many groups as rows. A bucket
    has about a quarter of ``tile`` rows, and no fewer than any key in it: a key with more than
    ``tile`` rows is in a full bucket, and mostly there is none.
    """
    bucket = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(max(1, 4 * deals // tile)))
    full = dealt.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    return settle(full.select("bucket"), "full-buckets"), bucket


def candidates(distinct: DataFrame, count: int, radius: int, pivots: int, blocks: int, tile: int) -> DataFrame:
    """Rows dealt to the keys (and tiles of a key) under which they are compared.

    A key holding more than ``tile`` of the ``count`` fingerprints is cut into parts by hash; a row
    goes to every tile that its part shares with another, so that all pairs of the key
    meet and no task has more than two parts.
    """
    bands = _bands(blocks)
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            shift, width = bands[i]
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    each = F.explode(F.array(*keys)).alias("key")
    counted = distinct.select("fp", each)
    dealt = pivot_table(distinct, pivots).select("fp", "pivot", each)
    full, bucket = full_buckets(counted, count * len(keys), tile)
    if full.isEmpty():
        return dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
    crowded = settle(
        counted.withColumn("bucket", bucket).join(full, "bucket", "left_semi")
        .groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
        .select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts")),
        "crowded-keys",
    )
    placed = dealt.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")),
    )
    return placed.withColumn("own", own).select(
        "fp", "pivot", "key", F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(tiles).alias("tiles")
    ).select("fp", "pivot", "key", F.explode("tiles").alias("at")).select("fp", "pivot", "key", "at.i", "at.j")


def _links_of(fp: np.ndarray, key: np.ndarray, pivot: np.ndarray, radius: int):
    """Star edges of the links inside each run of equal keys.

    Rows come sorted by key and first pivot distance. Step k compares every row with
    the k-th after it; a row leaves when its window ends.
    """
    rows, label, found = np.arange(len(fp)), np.arange(len(fp)), []
    step = 1
    first = pivot[:, 0].astype(np.int16)
    while len(rows):
        rows = rows[rows + step < len(fp)]
        other = rows + step
        inside = (key[rows] == key[other]) & (first[other] - first[rows] <= radius)
        rows = rows[inside]
        a, b = rows, rows + step
        apart = label[a] != label[b]  # pairs known to be connected need no further proof
        a, b = a[apart], b[apart]
        for p in range(1, pivot.shape[1]):
            near = np.abs(pivot[a, p].astype(np.int16) - pivot[b, p]) <= radius
            a, b = a[near], b[near]
        linked = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if linked.any():
            found.append((a[linked], b[linked]))
            label = np.arange(len(fp))
            node, root = star_edges(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            label[node] = root
            found = [(node, root)]
        step += 1
    return found[0] if found else (rows, rows)


def links(
    fingerprints: DataFrame, radius: int = 4, pivots: int = 16, blocks: int | None = None, tile: int = 4096, distinct: bool = False
) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints ``fp`` that connect just what
    pairs within ``radius`` bits connect.

    Of a clique only a star is emitted: at most as many rows as there are fingerprints
    under a key. Without ``blocks`` the number of bands follows that of the fingerprints.
    ``distinct`` says that they are distinct and settled already.
    """
    own = fingerprints.select("fp")
    own = own if distinct else settle(own.distinct(), "distinct-fingerprints")
    count = own.count()
    blocks = blocks_for(count, radius) if blocks is None else blocks
    if blocks <= radius:
        raise ValueError("there must be more bands than differing bits")
    dealt = candidates(own, count, radius, pivots, blocks, tile)
    sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "pivot", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            fp = batch.column(0).to_numpy().view(np.uint64)
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(fp), -1)
            a, b = _links_of(fp, _runs(batch), raw, radius)
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            run_of = _runs(batch)
            cut = int(np.searchsorted(run_of, run_of[-1]))
            if cut:
                yield from flush(_joined([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
            if len(held) > 1 and not _same_run(held[0], held[-1]):
                yield from flush(_joined(held[:-1]))
                held = held[-1:]
        if held:
            yield from flush(_joined(held))

    return sorted_rows.mapInArrow(run, "a bigint, b bigint")


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each run of equal (key, i, j)."""
    new = np.zeros(batch.num_rows, bool)
    for i in (2, 3, 4):
        v = batch.column(i).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _same_run(x: pa.RecordBatch, y: pa.RecordBatch) -> bool:
    return all(x.column(i)[x.num_rows - 1] == y.column(i)[0] for i in (2, 3, 4))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4, keep: list[str] | None = None, **search
) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    The component's id is the smallest non-null id in it (null if it has none). Null
    and wordless texts have fingerprint zero and are linked like any other; repeated
    rows stay; an empty table gives none. Input columns named like a result are
    replaced. The text itself is returned only if it is among ``keep``.
    """
    new = ["fingerprint", "component_id"]
    keep = [c for c in (keep if keep is not None else others(docs, [text])) if c not in new]
    source = docs.select(in_one(keep).alias("whole_row"), col(id_column).alias("own"), col(text).alias("body"))
    return _grouped(source, radius, words, search).select(
        *out_of("whole_row", keep), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _grouped(source: DataFrame, radius: int, words: int, search: dict) -> DataFrame:
    """``whole_row`` and ``own`` (the id) with ``fp``, its component's ``root`` and
    ``component_id``."""
    marked = settle(with_fingerprints(source, "body", ["whole_row", "own"], words), "fingerprints")
    groups = settle(marked.groupBy("fp").agg(F.min("own").alias("low")), "fingerprint-groups")
    roots = components(links(groups, radius, distinct=True, **search)).withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = settle(rooted.join(lows, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return marked.join(named, "fp")


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4, **search
) -> DataFrame:
    """One row of each group of near-duplicates, all its columns unchanged.

    The row with the smallest id stays, null ids last; of repeated rows one stays. Null and
    wordless texts have fingerprint zero and are one group with what lies near it; an empty
    table gives none.
    """
    rows, row = numbered(docs, "documents")
    source = rows.select(in_one([row]).alias("whole_row"), col(id_column).alias("own"), col(text).alias("body"))
    found = _grouped(source, radius, words, search)
    order = F.struct(F.col("own").isNull().alias("late"), "own", out_of("whole_row", [row])[0].alias("row"))
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*[col(c) for c in docs.columns])
