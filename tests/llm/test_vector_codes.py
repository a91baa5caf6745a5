"""Vector codes against plain integer arithmetic, and on odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from microatlas.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of every row and the codebooks' digest, by loops."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], name) for i, v, name in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))
    if not kept:
        return Counter(), hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for _, v, _ in kept] for p in range(parts)]
    books = [points[:entries] for points in cut]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((square(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x in cut[p]:
                own[near(x, books[p])[1]].append(x)
            books[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if own[e] else old for e, old in enumerate(books[p])]
    found = [[near(x, books[p]) for x in cut[p]] for p in range(parts)]
    errors = [sum(found[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = Counter()
    for (_, _, name), e in zip(kept, errors):
        by_label[name] += e
    out = Counter((i, "".join(f"{found[p][k][1]:02x}" for p in range(parts)), errors[k], by_label[name]) for k, (i, _, name) in enumerate(kept))
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def made(n=330, width=8):
    rng = np.random.default_rng(3)
    near = rng.normal(0, 1, (6, width))
    rows = [(i * 3 - 40, [float(x) for x in near[i % 6] + rng.normal(0, 0.02, width)], (i % 4) or None) for i in range(n)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(90)]  # a crowd of copies
    rows += [rows[1], rows[1], (rows[2][0], [0.5] * width, 2), (None, [0.25] * width, 3), (None, None, None)]  # ties, repeated rows
    rows += [(7, None, 1), (8, [None] + [0.1] * (width - 1), 1), (9, [float("nan")] * width, 1), (10, [float("inf")] + [0.0] * (width - 1), 1), (11, [0.0] * width, None)]
    return rows


@pytest.mark.parametrize(("entries", "block"), [(256, 64), (5, 7)])
def test_codes_equal_plain_arithmetic(spark, entries, block):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vc.compress(df, keep=["vec_id"], settings=vc.Settings(entries=entries, block=block)).collect()
    want, digest = plain(rows, entries=entries)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_and_no_rows_and_misfits(spark):
    rows = [(4, [0.1, -0.2, 0.3, 0.4], None), (2, [1.0, 2.0, 3.0, 4.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, digest = plain(rows)
    assert Counter(tuple(r)[:4] for r in vc.compress(df, keep=["vec_id"]).collect()) == want
    assert vc.compress(df.limit(0)).collect() == []
    odd = spark.createDataFrame([*rows, (1, [0.5] * 8, 1), (0, [0.5] * 3, 1), (5, [], 1), (6, [1e30, 0.0, 0.0, 0.0], 1)], SCHEMA)
    got = {r.vec_id: r for r in vc.compress(odd, keep=["vec_id"]).collect()}
    assert {i for i, r in got.items() if r.code is None and r.error is None} == {0, 1, 5, 6} and got[2].codebooks_sha256 == digest
    assert Counter(tuple(got[i])[:4] for i in (2, 4)) == want
    none = spark.createDataFrame([(1, [0.5] * 3, 1)], SCHEMA)
    assert [tuple(r)[:4] for r in vc.compress(none, keep=["vec_id"]).collect()] == [(1, None, None, None)]


def test_columns_named_like_inner_ones_stay(spark):
    from pyspark.sql import functions as F

    names = ["id", "raw", "size", "own", "label", "part", "key", "point", "whole_row", "__row", "entry", "own_label", "vector"]
    df = spark.createDataFrame(made(20), SCHEMA).withColumns({n: F.lit("old") for n in names})
    got = vc.compress(df)
    assert {tuple(r) for r in got.select(*names).distinct().collect()} == {("old",) * len(names)}
    assert "embedding" not in got.columns and "code" in got.columns


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 40))
def test_shortlists_lose_no_nearest_entry(seed, width, entries):
    rng = np.random.default_rng(seed)
    book = rng.integers(-30, 30, (entries, width))
    points = rng.integers(-30, 30, (12, width)) // int(rng.integers(1, 6))
    near = vc.shortlists(points.min(0)[None], points.max(0)[None], book)[0]
    table = ((points[:, None] - book[None]) ** 2).sum(2)
    assert near[table.argmin(1)].all() and near[(table == table.min(1, keepdims=True)).any(0)].all()
    own = np.flatnonzero(near)
    at, square = vc.nearest(points, book[own])
    assert (own[at] == table.argmin(1)).all() and (square == table.min(1)).all()


def test_shortlists_are_short_where_points_lie_together():
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (256, 8))
    points = book[rng.integers(0, 256, 500), None] + rng.integers(-9, 9, (500, 64, 8))
    near = vc.shortlists(points.min(1), points.max(1), book)
    assert near.sum(1).mean() < 1.5


def test_great_numbers_stay_exact():
    book = np.array([[1 << 25, -(1 << 25)] * 40, [(1 << 25) - 1, 0] * 40])
    at, square = vc.nearest(book[::-1] + 1, book)
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, c)) for c in book.tolist()] for p in (book[::-1] + 1).tolist()]
    assert [min(range(2), key=lambda e: (w[e], e)) for w in want] == at.tolist() and [min(w) for w in want] == square.tolist()


@pytest.mark.parametrize(("width", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(width, bits):
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij")).reshape(width, -1).T
    key = vc.hilbert_keys(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()
