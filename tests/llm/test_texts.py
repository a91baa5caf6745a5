"""Operators on single texts: against plain Python, and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from microatlas.llm import language_id, quality, secret_scan, token_counts
from microatlas.llm.queries import tokenizer_path

from .conftest import prose, rows

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df, names):
    return df.withColumns({n: F.lit("old") for n in names})


# --- quality rules


def plain_quality(text, rules=quality.Rules()):
    text = text or ""
    words = SPLIT.findall(text)
    chars = sum(map(len, words))
    lines = Counter()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        inside = sum(map(len, SPLIT.findall(line)))
        if lines[line] and inside:
            dup_lines, dup_chars = dup_lines + 1, dup_chars + inside
        lines[line] += 1

    def grams(n):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    times = Counter(grams(3))
    repeat = {i + k for i, g in enumerate(grams(3)) if times[g] > 1 for k in range(3)}
    shares = [dup_chars / max(chars, 1)]
    for n, _ in rules.coverage:
        seen, marked = set(), set()
        for i, g in enumerate(grams(n)):
            if g in seen:
                marked.update(range(i, i + n))
            seen.add(g)
        shares.append(sum(len(words[i]) for i in marked) / max(chars, 1))
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    kept = not failed and all(s <= x for s, x in zip(shares, [rules.lines, *[x for _, x in rules.coverage]]))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), chars, symbols, dup_lines, len(repeat), failed, kept, *shares


def test_quality_equals_plain_counts(docs, none):
    found = quality.score(clashing(docs, ["kept", "n_words"]), keep=["doc_id", "text", "kept"])
    got = sorted(tuple(r) for r in found.drop("doc_id").fillna("<null>", ["text"]).collect())
    want = sorted(((r[1] if r[1] is not None else "<null>"), *plain_quality(r[1])) for r in rows())
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert np.allclose([g[8:] for g in got], [w[8:] for w in want])
    assert quality.score(none).collect() == []


def test_quality_verdict_uses_coverage_of_later_occurrences(spark):
    passage, rest = prose(9, 30), prose(10, 120)
    texts = [rest + " " + prose(11, 30), rest + "\n" + passage + "\nx y z\n" + passage, " ".join([passage, rest[:300], passage, passage])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in quality.score(df).collect()}
    assert verdicts == {i: plain_quality(t)[5:7] for i, t in enumerate(texts)}
    assert verdicts[0] == (False, True) and verdicts[1] == (False, False)
    assert [r.doc_id for r in quality.keep_good(df).collect()] == [0]
    assert quality.keep_good(df).columns == df.columns


# --- token counts


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(docs, none, tmp_path, name):
    count = token_counts.counter(tokenizer_path(name))
    cache = f"{tmp_path}/cache"
    found = token_counts.count_tokens(clashing(docs, ["digest"]), tokenizer_path(name), cache, keep=["doc_id", "text"], limit=300)
    got = sorted((r.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())
    want = sorted((r[1] or "", len((r[1] or "").encode()), (n := count([r[1] or ""])[0]), n > 300) for r in rows())
    assert got == want
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows()})
    # All contents are known now, under another spelling of null too; nothing is encoded again.
    again = token_counts.count_tokens(docs.fillna("", ["text"]), tokenizer_path(name), cache, keep=["doc_id"])
    assert again.count() == len(rows()) and docs.sparkSession.read.parquet(cache).count() == stored.count()
    assert token_counts.count_tokens(none, tokenizer_path(name)).collect() == []


# --- secrets


def plain_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


def test_secrets_base_spans_equal_plain_search(docs, none):
    found = secret_scan.find_secrets(clashing(docs, ["spans", "live", "base"]), keep=["text", "base"])
    for r in found.collect():
        want = plain_base(r.text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("live")] == want
        assert r.base == "old"
    assert found.count() == len(rows())
    assert secret_scan.find_secrets(none).collect() == []


def test_secrets_of_one_owner_are_live_and_shared_ones_are_examples(spark):
    own, shared = "q7Rt2LmX9sVb4KpZ", "AB12cd34EF56gh78"
    data = [(1, f"token = {own}", "a", "r"), (2, f"see {own} in 日本 {own}", "a", "r"), (3, f"password: {shared}", "a", "r")]
    data += [(10 + i, f"password: {shared}", f"o{i}", "r") for i in range(5)] + [(20, None, None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string")
    found = {r.doc_id: r for r in secret_scan.find_secrets(df, keep=["doc_id"]).collect()}
    assert [found[i].n_live for i in (1, 2, 3, 10, 20)] == [1, 2, 0, 0, 0]
    assert found[1].spans == "assign:0:24,live:8:24" and found[2].spans == "live:4:20,live:27:43"
    masked = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert masked[1] == "token = [secret]" and masked[2] == "see [secret] in 日本 [secret]"
    assert masked[3] == f"password: {shared}" and masked[20] is None
    assert secret_scan.redact(df).columns == df.columns


def test_masking_joins_overlapping_spans():
    assert secret_scan.masked("abcdefgh", [(1, 4), (3, 6)], "*") == "a*gh"
    assert secret_scan.masked("abcdefgh", [(0, 8), (2, 3)], "*") == "*"
    assert secret_scan.masked("abcdefgh", [(1, 2), (4, 5)], "*") == "a*cd*fgh"


# --- languages


def test_language_of_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    from microatlas.llm.queries import op1_language_id

    found = op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    got = found.filter("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert got[0] >= 0.97 and got[1] > 150
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_language_on_odd_rows(docs, none):
    settings = language_id.Settings(epochs=2)
    found = language_id.identify(clashing(docs, ["score"]), F.lit(False), keep=["text"], settings=settings).collect()
    assert len(found) == len(rows())
    for r in found:
        letter = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == letter and (letter or (r.score == 0 and not r.accepted))
    nothing = language_id.identify(docs, F.lit(True), keep=["text"], settings=settings)  # no row to learn from
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.identify(none, F.lit(False), settings=settings).collect() == []


def test_language_rejection_is_calibrated():
    rng = np.random.default_rng(1)
    settings = language_id.Settings(per_class=50, bucket_bits=6, epochs=4)
    samples = []
    for i in range(400):
        k = i % 2
        noisy = i % 10 == 0  # its label says nothing
        buckets = rng.integers(0, 32, 40) + 32 * (k if not noisy else rng.integers(0, 2, 40))
        used, times = np.unique(buckets, return_counts=True)
        samples.append((used, times / times.sum(), "ab"[k], i % 4 == 0))
    model = language_id.train(samples, settings)
    held = [s for s in samples if s[3]]
    scores = np.array([language_id._softmax((s[1] @ model.table[s[0]] + model.bias) / model.temperature) for s in held])
    accepted = scores.max(1) >= model.threshold
    wrong = np.array(["ab"[i] for i in scores.argmax(1)]) != np.array([s[2] for s in held])
    assert accepted.sum() > 60 and wrong[accepted].mean() <= settings.max_error
    assert 0 < model.temperature and math.isfinite(model.threshold)


def test_ids_do_not_steer_the_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    marked = docs.withColumn("held", held)
    moved = marked.withColumn("doc_id", F.col("doc_id") + 1_000_000).repartition(3)
    a, b = (sorted(tuple(r) for r in language_id.identify(d, F.col("held"), keep=["text"]).collect()) for d in (marked, moved))
    assert a == b


def test_copies_and_bounds_of_the_language_sample(spark):
    rows = [("one two three", "en")] * 300 + [(f"un deux trois {i} " + "abc xyz " * i, "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string")
    settings = language_id.Settings(per_class=40, max_texts=50, max_features=6)
    found = language_id.sample(df, "text", "lang", F.lit(True), settings)
    assert sum(s[2] == "en" for s in found) <= 1 and 1 <= sum(s[2] == "fr" for s in found) <= 50
    assert all(len(s[0]) <= 6 for s in found)
    with pytest.raises(ValueError, match="max_classes"):
        language_id.sample(df, "text", "lang", F.lit(True), language_id.Settings(max_classes=1))


def test_features_scores_and_calibration_equal_a_plain_version(spark, sf):
    """Table, softmax, temperature and threshold against loops over the trained weights."""
    settings = language_id.Settings(per_class=60, epochs=2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language_id.sample(docs, "text", "lang", F.lit(True), settings)
    model = language_id.train(found, settings)
    subwords = language_id.Subwords(settings)
    for text in ("Der schnelle Fuchs 12 über", "a", "", "12 !", None):
        buckets = [int(b) for part in subwords(text) for b in part]
        logits = model.logits(text, subwords)
        if not buckets:
            assert logits is None
            continue
        plain = [sum(float(model.table[b][k]) for b in buckets) / len(buckets) + float(model.bias[k]) for k in range(len(model.classes))]
        assert np.allclose(logits, plain)
    held = [s for s in found if s[3]]
    logits = [(s[1] @ model.table[s[0]] + model.bias, model.classes.index(s[2])) for s in held]

    def loss(t):
        return -sum(np.log(max(np.exp(x[y] / t - np.logaddexp.reduce(x / t)), 1e-12)) for x, y in logits) / len(logits)

    assert loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.05, 20, 60)) + 1e-9
    scored = [(language_id._softmax(x / model.temperature), y) for x, y in logits]
    taken = [p.argmax() != y for p, y in scored if p.max() >= model.threshold]
    assert np.mean(taken) <= settings.max_error


def test_a_second_count_in_a_session_encodes_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer, cache = tokenizer_path("piece_bpe_32k.model"), token_counts.session_cache(spark)

    def counted():
        return sorted(tuple(r) for r in token_counts.count_tokens(docs, tokenizer, cache, keep=["doc_id"]).collect())

    first = counted()
    stored = spark.read.parquet(cache).count()

    def never(texts):
        raise AssertionError("a stored text was encoded")

    monkeypatch.setattr(token_counts, "counter", lambda tokenizer: never)
    assert counted() == first
    assert spark.read.parquet(cache).count() == stored > 0
