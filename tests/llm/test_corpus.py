"""Operators over the whole corpus: against plain Python, and on odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from microatlas.llm import common, embedding_dedup, mixing, packing, sharding, simhash, warc
from microatlas.llm.queries import tokenizer_path

from .conftest import prose, rows


def clashing(df, names):
    return df.withColumns({n: F.lit("old") for n in names})


def closed(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def lowest(ids, root):
    low = {}
    for i, r in zip(ids, root):
        low[r] = min((x for x in (i, low.get(r)) if x is not None), default=None)
    return [low[r] for r in root]


# --- components


def test_components_of_paths_stars_and_cliques(spark):
    path = [(i, i + 1) for i in range(100, 180)]
    star = [(500, 500 + i) for i in range(1, 60)]
    clique = [(a, b) for a in range(900, 912) for b in range(900, 912)]
    edges = spark.createDataFrame([*path, *star, *clique, (-5, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in common.components(edges).collect()}
    want = {i: 100 for i in range(101, 181)} | {500 + i: 500 for i in range(1, 60)} | {i: 900 for i in range(901, 912)} | {3: -5}
    assert got == want
    assert common.components(edges.filter("a > 10000")).collect() == []


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_star_edges_keep_components(pairs):
    a, b = (np.array(x) for x in zip(*pairs))
    node, root = common.star_edges(a, b)
    before, after = closed(26, pairs), closed(26, list(zip(node.tolist(), root.tolist())))
    assert before == after and len(node) < len(set(a.tolist()) | set(b.tolist()))


# --- SimHash


def plain_fingerprint(text, k=4):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_plain_fingerprints_and_links(docs, none):
    found = simhash.near_duplicates(clashing(docs, ["fp", "component_id"]), keep=["doc_id", "text", "fp"]).collect()
    data = rows()
    fps = [plain_fingerprint(r[1]) for r in data]
    links = [(a, b) for a in range(len(data)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    roots = closed(len(data), links)
    component = lowest([r[0] for r in data], roots)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([(r.doc_id, r.text, r.fingerprint, r.component_id) for r in found], key=key) == sorted(
        [(r[0], r[1], f"{f:016x}", c) for r, f, c in zip(data, fps, component)], key=key
    )
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for _, c in set(zip(roots, component)))


@pytest.mark.parametrize("tile", [4, 4096])
def test_simhash_links_equal_all_pairs(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base[:20]:  # chains and crowds around some of them
        y = int(x)
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), tile=tile).collect()
    place = {x: i for i, x in enumerate(signed)}
    pairs = [(place[r.a], place[r.b]) for r in found]
    assert closed(len(fps), pairs) == closed(
        len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    )


def test_bands_follow_the_fingerprints_and_links_stay(spark):
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**9, 10**10, 10**12)] == [6, 6, 7, 8, 9]
    for blocks in range(6, 13):  # keys never part a pair within the radius
        assert sum(w for _, w in simhash._bands(blocks)) == 64
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = [{(r.node, r.root) for r in common.components(simhash.links(df, blocks=b)).collect()} for b in (None, 7, 8)]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(fps) - len(set(closed(len(fps), pairs)))


def test_only_rows_of_full_buckets_are_counted_by_key(spark):
    rare = spark.range(40_000).select((F.col("id") % 20_000 * 977).alias("key"))  # each key twice
    full, _ = simhash.full_buckets(rare, 40_000, 256)
    assert full.count() == 0
    crowd = rare.unionByName(spark.range(900).select((F.col("id") % 3 - 5).alias("key")))  # three keys 300 times
    full, bucket = simhash.full_buckets(crowd, 40_900, 256)
    left = crowd.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in left if r["count"] > 256} == {-5: 300, -4: 300, -3: 300}
    assert sum(r["count"] for r in left) < 2_000


@pytest.mark.parametrize("tile", [8, 64])
def test_simhash_links_of_crowded_keys(spark, tile):
    rng = np.random.default_rng(8)
    low = rng.choice(1 << 24, 400, replace=False).astype(np.uint64)  # 40 upper bits in common: six keys with all 400
    fps = np.concatenate([low, low[:60] ^ np.uint64(0b10011), rng.integers(0, 2**63, 300, dtype=np.uint64)])
    fps = np.unique(fps).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    found = {(r.node, r.root) for r in common.components(simhash.links(df, tile=tile)).collect()}
    bits = np.bitwise_count(fps[:, None] ^ fps[None, :])
    roots = closed(len(fps), [(int(a), int(b)) for a, b in np.argwhere(bits <= 4) if a > b])
    assert found == {(int(fps[i]), int(fps[r])) for i, r in enumerate(roots) if i != r}


# --- embeddings


def plain_embeddings(data, threshold):
    good = {}
    for i, (_, v, label) in enumerate(data):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    links = [
        (a, b) for a in good for b in good
        if a > b and data[a][2] == data[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold
    ]
    count = Counter(x for p in links for x in p)
    component = lowest([r[0] for r in data], closed(len(data), links))
    return [(r[0], count[i], component[i], r[0] is not None and r[0] == component[i]) for i, r in enumerate(data)]


@pytest.mark.parametrize("block", [4, 512])
def test_embedding_join_equals_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    data = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=8) * (0.02, 0.18, 0.35)[i % 3]
        data.append((i, [float(np.float32(x)) for x in v], i % 2))
    data += [(300 + i, data[0][1], 0) for i in range(9)] + [(400, data[0][1], None), (None, data[0][1], 0), (5, data[0][1], 0)]
    data += [(410, None, 0), (411, [], 0), (412, [0.0] * 8, 0), (413, [math.nan] + [1.0] * 7, 0), (414, [None] + [1.0] * 7, 0)]
    data += [(415, [math.inf] + [1.0] * 7, 0), (416, [1.0, 2.0], 0), (417, [2.0, 4.0], 0), (418, [1e-30] * 8, 1), (419, [1e30] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int")
    found = embedding_dedup.near_duplicates(clashing(df, ["kept", "digest"]), keep=["vec_id", "digest"], block=block)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([tuple(r) for r in found.drop("digest").collect()], key=key) == sorted(plain_embeddings(data, 0.93), key=key)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []
    assert {r.n_links for r in embedding_dedup.near_duplicates(df.filter("label is null")).collect()} == {0}


def few_dimensions(spark, n=1500):
    """Unit vectors that three of their eight dimensions tell apart, as entries of the join."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(n, 3)) * (4, 3, 2), rng.normal(size=(n, 5)) * 0.02], axis=1)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("<f8")
    entries = spark.createDataFrame([(i, 1, "g", bytearray(x.tobytes())) for i, x in enumerate(v)], "id bigint, copies bigint, grp string, raw binary")
    return v, entries.repartition(4).cache()


def test_axes_are_orthonormal_and_lead(spark):
    v, entries = few_dimensions(spark)
    axes = embedding_dedup.principal_axes(entries, "<f8", 3)
    assert np.allclose(axes.T @ axes, np.eye(3))
    best = np.linalg.eigvalsh(v.T @ v)[::-1][:3].sum()
    assert ((v @ axes) ** 2).sum() > 0.999 * best
    assert embedding_dedup.principal_axes(entries.limit(0), "<f8", 3).shape == (0, 0)


def test_most_pairs_of_blocks_are_skipped_and_tiles_agree(spark):
    v, entries = few_dimensions(spark)
    threshold = 0.99
    epsilon = math.sqrt(2 - 2 * threshold)
    axes = embedding_dedup.principal_axes(entries, "<f8", 3)
    blocks = embedding_dedup.grid_blocks(entries, "<f8", axes, epsilon, 16)
    pairs = embedding_dedup.block_pairs(blocks, epsilon, 4)
    n, kept = blocks.count(), {(r.i, r.j) for r in pairs.collect()}
    assert len(kept) < n * (n + 1) / 2 / 3
    place = {i: r.seq for r in blocks.collect() for i in r.ids}
    linked = np.argwhere(np.triu(v @ v.T >= threshold, 1))
    assert {tuple(sorted((place[a], place[b]))) for a, b in linked} <= kept
    want = Counter(linked.ravel().tolist())
    for side in (1, 4, 16):
        found = embedding_dedup.join_blocks(blocks, pairs, "<f8", threshold, side).collect()
        count = Counter()
        for r in found:
            count[r.a] += r.n or 0
        assert +count == want, side


def test_a_tile_is_bounded_by_its_bytes():
    assert [embedding_dedup.tile_side(8 * d, 512) for d in (0, 1, 64, 1024, 4096, 10**6)] == [16, 16, 16, 8, 2, 1]


# --- packing


def test_pieces_hold_the_library_ids(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    found = packing.pack(clashing(docs, ["piece", "offset"]), tokenizer_path("word_bpe_49k.json"), keep=["doc_id", "text"]).collect()
    want = Counter()
    for r in rows():
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[(r[0], r[1], p, at, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.text, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    gapless([(r.sequence_id, r.offset, r.length) for r in found], 2048)
    assert packing.pack(none, tokenizer_path("word_bpe_49k.json")).collect() == []


def gapless(placed, capacity):
    by = defaultdict(list)
    for s, o, n in placed:
        by[s].append((o, n))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


TEXT = st.text(st.sampled_from(list("abzAZéÉßñ .,;'!<|>0123\n\t\x0b\x1c\x85\xa0…œ—日𝒳'sre")) | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_word_memory_gives_the_library_ids(texts):
    for text, ids in zip(texts, map(ENCODER, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ENCODER.library.encode(text, add_special_tokens=False).ids


ENCODER = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=25))
def test_plan_places_every_rank_once_and_packs_tightly(histogram):
    runs, total = packing.plan(histogram, 60)
    placed = []
    for n, count in histogram.items():
        starts = [r[0] for r in runs.get(n, [])]
        assert starts == sorted(starts)
        for rank in range(count):
            first, sequence, each, offset = runs[n][np.searchsorted(starts, rank, side="right") - 1]
            nth = rank - first
            placed.append((sequence + nth // each, offset + nth % each * n, n))
    assert gapless(placed, 60) == total
    items = sum(n * c for n, c in histogram.items())
    large, pairs = sorted(n for n, c in histogram.items() for _ in range(c) if 3 * n > 60), 0
    low, high = 0, len(large) - 1
    while low < high:  # the smallest with the largest: as many pairs as there can be
        fits = large[low] + large[high] <= 60
        pairs, low, high = pairs + fits, low + fits, high - 1
    # A sequence opened for a short piece means that the others are two thirds full.
    assert total <= max(len(large) - pairs, 1.5 * items / 60 + 1)


# --- sharding


def test_shards_are_contiguous_and_near_equal(docs, none):
    n = 5
    found = sharding.shards(clashing(docs, ["shard", "size"]), n_shards=n, keep=["doc_id", "text", "shard"])
    got = found.orderBy("shard", "slot").collect()
    assert len(got) == len(rows())
    for r in got:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert ids == sorted(ids)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    before, total = 0, sum(r.size for r in got)
    for r in got:
        assert r.shard == min(n - 1, (2 * before + r.size) * n // (2 * total))
        before += r.size
    assert sharding.shards(none).collect() == []


def test_shards_of_many_even_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text")).repartition(7)
    sizes = {r[0]: r[1] for r in sharding.shards(df).groupBy("shard").agg(F.sum("size")).collect()}
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * (96 + 16)


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return target


def test_mix_reaches_targets_with_whole_rows(docs, none):
    check_mix(clashing(docs, ["size", "hash"]), rows())
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []


def check_mix(df, data):
    import hashlib

    found = mixing.mix(df, keep=["doc_id", "text", "source"]).collect()
    size = lambda t: len((t or "").split()) if t is None or t.isascii() else len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size(r[1])
    target = plain_targets(sizes)
    want = Counter()
    for s in sizes:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        own = [(hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:15], r) for r in data if r[3] == s]
        for _, r in sorted(own, key=lambda x: x[0]):
            n = size(r[1])
            taken = n * min(3, whole + (2 * before + n <= 2 * rest))
            want[(r[0], r[1], s, n, sizes[s], round(target[s], 6), taken)] += 1
            before += n
    got = Counter((r.doc_id, r.text, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in found)
    assert got == want
    assert all(r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 for r in found)


def test_mix_splits_a_crowd_of_repeated_rows(spark):
    data = [(1, "a b c d", None, "hot", 7)] * 300 + [(i, prose(i, 5 + i % 9), None, "abc"[i % 3], 1) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    check_mix(df, data)
    assert mixing.mixed(df).columns == df.columns


# --- WARC


PAGES = [
    (5, "http://a/5", "same"), (9, "http://a/9", "same"), (2, None, "same"), (7, "http://a/7\r\nX: 1", "other é"), (8, "", None),
    (1, "http://a/1", ""), (9, "http://a/9", "same"), (None, None, None), (None, "http://n", "alone"), (None, None, "alone"),
    (3, "http://a/3", "x" * 300_000), (4, "http://a/4", "x" * 300_000), (2**62, "http://far", "far"), (-(2**62), "http://low", "low"),
]


def plain_records(least):
    out, groups = Counter(), defaultdict(list)
    for page, _, html in PAGES:
        groups[html or ""].append(page)
    for html, pages in groups.items():
        raw = html.encode()
        first = max((p for p in pages if p is not None), default=None)
        used = False
        for page in pages:
            response = len(raw) < least or (page == first and not used)
            used |= response
            out[(page, len(raw), warc.bare_digest(raw), "response" if response else "revisit", None if response else first)] += 1
    return out


@pytest.mark.parametrize(("least", "roll"), [(0, 1), (5, 100_000), (0, 16 << 20)])
def test_archives_hold_all_records(spark, tmp_path, least, roll):
    pages = clashing(spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3), ["digest", "shard"])
    small = warc.Settings(shard_bytes=1000, roll_bytes=roll, min_payload=least)
    manifest = warc.write(pages, f"{tmp_path}/a", small)
    back = warc.read(spark, f"{tmp_path}/a", with_payload=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == plain_records(least)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in back)
    names = {r.name for r in manifest.collect()}
    assert {p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".gz"} == names and len(names) > 2
    again = warc.write(pages.repartition(5), f"{tmp_path}/b", small)
    assert sorted((r.name, r.sha256) for r in again.collect()) == sorted((r.name, r.sha256) for r in manifest.collect())
    import gzip

    some = b"".join(gzip.decompress((tmp_path / "a" / n).read_bytes()) for n in sorted(names))
    assert some.count(b"WARC/1.1\r\n") == len(PAGES) and b"\r\nX: 1" not in some


def test_pages_of_one_id_fill_as_many_shards_as_others(spark, tmp_path):
    shards = {}
    for name, page in (("null", None), ("seven", 7), ("own", None), ("copies", 7)):
        data = [
            (i if name == "own" else page, None if name == "copies" else f"http://h/{i}", "same" if name == "copies" else f"{i:05d}" * 100)
            for i in range(400)
        ]
        pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(3)
        manifest = warc.write(pages, f"{tmp_path}/{name}", warc.Settings(shard_bytes=20_000)).collect()
        shards[name] = len({r.name.split("-")[1] for r in manifest})
        back = Counter((r.page_id, r.record_type) for r in warc.read(spark, f"{tmp_path}/{name}").collect())
        if name == "copies":
            assert back == {(7, "response"): 1, (7, "revisit"): 399}
        else:
            assert back == Counter((r[0], "response") for r in data)
    # Rows that nothing tells apart stay together.
    assert shards == {"null": 21, "seven": 21, "own": 21, "copies": 1}
    few = warc.write(pages.union(pages.withColumn("page_id", F.lit(8))), f"{tmp_path}/few", warc.Settings(shard_bytes=1, max_shards=2))
    assert len({r.name.split("-")[1] for r in few.collect()}) == 2


def test_same_payload_at_many_addresses_has_one_response(spark, tmp_path):
    """A crowd without ids and with one payload is spread by address; one record is whole."""
    data = [(None, f"http://h/{i}", "same") for i in range(300)] + [(None, "http://h/299", "same"), (None, None, "same")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    manifest = warc.write(pages, f"{tmp_path}/a", warc.Settings(shard_bytes=20_000)).collect()
    assert len({r.name.split("-")[1] for r in manifest}) > 5
    back = warc.read(spark, f"{tmp_path}/a").collect()
    assert [r.url for r in back if r.record_type == "response"] == ["http://h/99"] and len(back) == 302


def test_archives_of_no_pages_and_damaged_ones(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").collect() == []
    manifest = warc.write(pages, f"{tmp_path}/a").collect()
    file = tmp_path / "a" / manifest[0].name
    file.write_bytes(file.read_bytes()[:-20])
    with pytest.raises(Exception, match="record"):
        warc.read(spark, f"{tmp_path}/a").collect()


INNER = ["part", "nth", "digest", "root", "low", "fp", "row", "whole", "key", "hash", "id", "own", "before", "place", "n", "seq", "raw", "text_", "__live", "__row", "__n", "__t", "__o", "__text", "__c0", "whole_row"]


def test_columns_named_like_inner_ones_stay(docs):
    from microatlas.llm import language_id, quality, secret_scan, token_counts

    more = clashing(docs, INNER)
    word, piece = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
    vectors = more.withColumn("embedding", F.array(F.lit(1.0), F.col("n_chars").cast("double"))).withColumn("label", F.lit(1))
    found = {
        "simhash": simhash.near_duplicates(more), "sharding": sharding.shards(more), "mixing": mixing.mix(more),
        "packing": packing.pack(more, word), "tokens": token_counts.count_tokens(more, piece), "quality": quality.score(more),
        "secrets": secret_scan.find_secrets(more), "embeddings": embedding_dedup.near_duplicates(vectors, "doc_id"),
        "language": language_id.identify(more, F.lit(False), settings=language_id.Settings(epochs=1)),
        "kept": simhash.keep_one(more), "mixed": mixing.mixed(more), "good": quality.keep_good(more), "masked": secret_scan.redact(more),
    }
    for name, rows_ in found.items():
        assert [c for c in INNER if c in rows_.columns] == INNER, name
        assert {tuple(r) for r in rows_.select(*INNER).distinct().collect()} == {("old",) * len(INNER)}, name
