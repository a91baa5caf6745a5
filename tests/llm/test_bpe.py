"""Chunked encoding against the tokenizers library, and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from microatlas.llm import bpe
from microatlas.llm.queries import tokenizer_path

from .conftest import prose, rows

PATH = tokenizer_path("byte_bpe_50k.json")
SMALL = bpe.Chunking(bits=4, least=8, most=64, filter_bits=16)
PIECES = [
    "a", "the", " ", "  ", "\n", "\t", "\x0b", "\xa0", "\x85", "é", "日本", "<|endoftext|>", "<|endof", "text|>", "'s", "'", "!", "12", "3", " x",
    "\x1c", "😀", "　", "ſ", "́", "\r\n", "Straße", "don't", "᠎", " ", "﻿", "x" * 70,
]
texts = st.lists(st.sampled_from(PIECES), max_size=60).map("".join) | st.text(max_size=80)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def library_ids(vocabulary, text):
    return vocabulary.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(0, 10**9))
def test_words_and_joins_equal_the_library(text, seed):
    vocabulary = VOCABULARY
    want = library_ids(vocabulary, text)
    encode = bpe.Encoder(vocabulary)
    assert encode([text])[0].tolist() == want
    rng = random.Random(seed)
    at = sorted({0, len(text), *[rng.randrange(len(text) + 1) for _ in range(rng.randrange(6))]})
    chunks = [text[a:b] for a, b in zip(at, at[1:])]
    assert bpe.join_chunks([encode(chunks)], vocabulary)[0].tolist() == want
    assert vocabulary.decode(np.array(want, int)) == vocabulary.library.decode(want, skip_special_tokens=False) == text


VOCABULARY = bpe.Vocabulary(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode_as_by_the_library(ids):
    assert VOCABULARY.decode(np.array(ids, int)) == VOCABULARY.library.decode(ids, skip_special_tokens=False)


def test_long_parts_and_forgotten_words(vocabulary):
    class Small(bpe.Encoder):
        KNOWN, PART = 20, 50

    text = prose(5, 800) + " " + " " * 200 + "y" * 300
    encode = Small(vocabulary)
    for body in (text, prose(6, 900), "z" * 500, prose(6, 900)):
        assert encode([body])[0].tolist() == library_ids(vocabulary, body)


def test_joins_without_words_are_widened(vocabulary):
    text = "日本語テキスト" * 60 + "x" * 300
    for size in (3, 10, 50):
        chunks = [text[i : i + size] for i in range(0, len(text), size)]
        assert bpe.join_chunks([vocabulary.encode(chunks)], vocabulary)[0].tolist() == library_ids(vocabulary, text)


def test_joins_that_disagree_are_widened(vocabulary):
    """Wrong ids beside a join are found and mended by widening the stretch."""
    text = prose(9, 60)
    chunks = [ids.copy() for ids in vocabulary.encode([text[:150], text[150:]])]
    at = vocabulary.boundaries(chunks[0])
    word = vocabulary.raw(chunks[0][at[-2] : at[-1]])
    alone = np.concatenate(vocabulary.encode([chr(b) for b in word]))
    chunks[0] = np.concatenate([chunks[0][: at[-2]], alone, chunks[0][at[-1] :]])
    assert len(alone) > at[-1] - at[-2]
    assert bpe.join_chunks([chunks], vocabulary)[0].tolist() == library_ids(vocabulary, text)


@given(st.text(max_size=400) | st.text(alphabet="ab é日", max_size=2000))
def test_chunks_are_whole_characters_within_bounds(text):
    raw = text.encode()
    ends = bpe.cuts(raw, SMALL)
    assert ends == sorted(set(ends)) and (ends[-1:] == [len(raw)] or not raw)
    sizes = np.diff([0, *ends])
    assert (sizes <= SMALL.most + 3).all() and (sizes[:-1] >= SMALL.least).all()
    for a, b in zip([0, *ends], ends):
        raw[a:b].decode()


def test_a_shared_passage_has_the_same_chunks():
    passage = prose(7, 400)
    one, other = ({raw[a:b] for a, b in zip([0, *e], e)} for raw, e in ((r, bpe.cuts(r)) for r in ((prose(1, 90) + passage).encode(), (prose(2, 333) + passage).encode())))
    assert sum(len(c) for c in one & other) > 0.7 * len(passage)


def plain(data):
    library, out = VOCABULARY.library, Counter()
    for i, text in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("rule", [bpe.Chunking(), SMALL, bpe.Chunking(bits=4, least=8, most=64, filter_bits=15)])
def test_round_trip_equals_the_library(spark, docs, rule):
    got = bpe.round_trip(docs, PATH, keep=["doc_id"], rule=rule).collect()
    assert Counter(tuple(r) for r in got) == plain([(r[0], r[1]) for r in rows()])


def test_given_documents_equal_the_library(spark, sf):
    from microatlas.llm import queries

    data = queries.documents(spark, sf).select("doc_id", "text").collect()
    got = queries.QUERIES["op12_bpe_round_trip"](spark, sf).collect()
    assert Counter(tuple(r) for r in got) == plain(data)


def test_each_shared_chunk_goes_through_the_table_once(spark, tmp_path, monkeypatch):
    passage = prose(11, 500)
    data = [(i, prose(100 + i, 50) + passage + prose(200 + i, 40)) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    written = {}
    keep = bpe.settle

    def settle(frame, name="settled"):
        written[name] = keep(frame, name)
        return written[name]

    monkeypatch.setattr(bpe, "settle", settle)
    rule = bpe.Chunking(bits=8, least=64)
    assert Counter(tuple(r) for r in bpe.round_trip(df, PATH, keep=["doc_id"], rule=rule).collect()) == plain(data)
    table = written["chunk-ids"].collect()
    assert len(table) == len({r.chunk for r in table}) > 3 and written["sharing-documents"].count() == 40


def test_ids_and_texts_of_rows(spark, docs, none):
    more = docs.withColumns({n: F.lit("old") for n in ("digest", "chunk", "ids_", "whole_row", "own", "packed", "decoded")})
    found = bpe.encode(more, PATH, keep=["doc_id", "text", "digest", "chunk", "whole_row", "packed"])
    for r in bpe.decode(found, PATH).collect():
        assert (r.ids, r.decoded) == (library_ids(VOCABULARY, r.text or ""), r.text or "") and r.digest == r.packed == "old"
    assert bpe.encode(none, PATH).collect() == [] and bpe.round_trip(none, PATH).collect() == []
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(tokenizer_path("word_bpe_49k.json"))
