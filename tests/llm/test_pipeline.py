"""The pipeline and the registered queries, stage by stage against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, connect
from microatlas.llm import queries, secret_scan
from microatlas.llm.queries import tokenizer_path
from microatlas.runtime import settle

from .conftest import SCHEMA, rows
from .test_corpus import closed, gapless, plain_fingerprint, plain_targets
from .test_texts import plain_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_deduped(data):
    fps = [plain_fingerprint(r[1], 4) for r in data]
    links = [(a, b) for a in range(len(data)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    groups = defaultdict(list)
    for i, root in enumerate(closed(len(data), links)):
        groups[root].append(i)
    return [data[min(g, key=lambda i: (data[i][0] is None, data[i][0] or 0, i))] for g in groups.values()]


def plain_redacted(data, rules=secret_scan.Rules()):
    owners, repositories = defaultdict(set), defaultdict(set)
    found = [secret_scan.scan(r[1], rules.min_bits)[1] for r in data]
    for r, wide in zip(data, found):
        for *_, value in wide:
            owners[value].add(r[3])
            repositories[value].add((r[3], r[2]))
    out = []
    for r, wide in zip(data, found):
        live = [(s, e) for s, e, v in wide if len(owners[v]) <= rules.max_owners and len(repositories[v]) <= rules.max_repositories]
        text = secret_scan.masked(r[1], live, "[secret]") if live else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if live else r[4]))
    return out


def plain_mixed(data):
    import hashlib
    import re

    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size(r)
    target, out = plain_targets(sizes), []
    for s in sizes:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        own = [(hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:15], i) for i, r in enumerate(data) if r[3] == s]
        for _, i in sorted(own):
            out += [data[i]] * min(3, whole + (2 * before + size(data[i]) <= 2 * rest))
            before += size(data[i])
    return out


def plain_pieces(data):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for r in data:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            out[(r[0], p, at, len(own), zlib.crc32(own.tobytes()))] += 1
    return out


PLAIN = [lambda data: [r for r in data if plain_quality(r[1])[6]], plain_deduped, plain_redacted, plain_mixed]


@pytest.fixture(scope="module", params=["made", "given"])
def folder(request, spark, sf, tmp_path_factory):
    if request.param == "given":
        return sf
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_stage_equals_its_plain_version(spark, folder):
    docs = queries.documents(spark, folder)
    data = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    key = lambda r: tuple(map(str, r))
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], PLAIN, strict=True):
        docs = settle(stage(spark, docs, folder), "stage")
        assert docs.columns == COLUMNS, name
        data = plain(data)
        assert sorted(map(key, docs.collect())) == sorted(map(key, data)), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    want = plain_pieces(data)
    for out in (last, corpus_pipeline.run(spark, folder)):
        found = out.collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
        n = gapless([(r.sequence_id, r.offset, r.length) for r in found], 2048)
        assert n <= 1.1 * sum(r.length for r in found) / 2048 + 1


def test_stages_take_no_rows(spark, folder):
    docs = queries.documents(spark, folder).filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    sf = sf.replace("sf0.001", "sf0.01")
    assert compare(queries.QUERIES[name](spark, sf), connect(sf).sql(queries.ORACLE[name])) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_has_a_row_per_document(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    want = queries.documents(spark, sf).count()
    assert found.select("doc_id").distinct().count() == want
    assert name == "op7_best_fit_packing" or found.count() == want
