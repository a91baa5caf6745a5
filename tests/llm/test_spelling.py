"""Spelling variants against all edits of all words, and on odd rows."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from microatlas.llm import queries, spelling

SCHEMA = "doc_id bigint, text string"


def plain_words(data, drop=97):
    low = {c: c + 32 for c in range(65, 91)}
    total = Counter()
    for own, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain(words):
    letters = sorted(set("".join(words)))

    def near(w):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        return [x for x in edits - {w} if x in words]

    form, n_near = {}, {}
    for w, n in words.items():
        found = near(w)
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, n_near[w], words[form[w]] if w in form else None) for w, n in words.items())


def crowd():
    """Words with one beginning or one end, chains of forms, and letters beyond ASCII."""
    tails = ["abc", "abd", "abcd", "bc", "ébc", "ebc", "zzz", "zz", "z÷z", "zzzz", "xyzzy", "xyzz", "yzzy"]
    words = ["inter" + t for t in tails] + [t + "ation" for t in tails] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "abaaa"]
    out = {w: 3 + i % 4 for i, w in enumerate(words)}
    out |= {"chaina": 3, "chainb": 6, "chanb": 12, "chanèb": 24, "chaèb": 50, "Àchabÿ": 4, "Àchabþ": 8}
    return out


@pytest.mark.parametrize("limit", [spelling.CROWD, 2, 0])
def test_pairs_equal_all_edits(spark, limit):
    words = crowd()
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = spelling.near_pairs(df, crowd=limit).collect()
    assert len({(r.a, r.b) for r in got}) == len({frozenset((r.a, r.b)) for r in got}) == len(got)
    want = {w: 0 for w in words}
    for r in got:
        assert (r.a_n, r.b_n) == (words[r.a], words[r.b])
        want[r.a] += 1
        want[r.b] += 1
    assert want == {r[0]: r[4] for r in plain(words)}


word = st.text(alphabet="abé", min_size=5, max_size=9)


@settings(max_examples=4, deadline=None)
@given(st.sets(word, min_size=30, max_size=120), st.sampled_from([1, 50]))
def test_random_words_equal_all_edits(spark, found, limit):
    words = {w: 3 + len(w) for w in found}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = Counter()
    for r in spelling.near_pairs(df, crowd=limit).collect():
        got.update([r.a, r.b])
    assert {w: got[w] for w in words} == {r[0]: r[4] for r in plain(words)}


def test_texts_with_odd_rows(spark):
    words = crowd()
    text = " ".join(f"{w}," for w, n in words.items() for _ in range(n))
    shouted = text.upper().replace("CHAIN", "chain")  # also upper-case letters beyond A to Z
    data = [(1, text), (2, shouted), (2, shouted), (None, text), (3, None), (4, ""), (5, "12 ×÷ !"), (6, "chanb" * 3000 + " chanb"), (7, "x\n" * 400)]
    data += [(10 + i, "colour color colours") for i in range(400)]  # a hot word, some of it with a letter lost
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({n: F.lit("old") for n in ("word", "n", "id", "key", "root", "l")})
    got = sorted((tuple(r) for r in spelling.variants(df).collect()))
    assert got == plain(plain_words(data))
    assert spelling.variants(df.limit(0)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "a bc")], SCHEMA)).collect() == []


def test_chains_lead_to_their_ends(spark):
    links = [(i, i + 1) for i in range(37)] + [(100 + i, 100) for i in range(1, 60)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in links], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(df).collect()}
    assert got == {str(i): "37" for i in range(37)} | {str(100 + i): "100" for i in range(1, 60)}


def test_given_documents_equal_all_edits(spark, sf):
    data = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_spelling_variants"](spark, sf).collect())
    assert got == plain(plain_words(data))
