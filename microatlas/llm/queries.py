"""The registered queries of the operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microatlas.llm import (
    bpe, embedding_dedup, language_id, mixing, packing, quality, secret_scan, sharding, simhash, spelling, token_counts,
    vector_codes, warc,
)

Build = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # A null id counts as the empty text: it is held out.
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    held_out = fold == 0
    found = language_id.identify(docs.withColumn("held_out", held_out), held_out, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.write_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), keep=["doc_id"])


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), keep=["doc_id"])


def op9_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(documents(spark, sf_dir), keep=["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT r, coalesce(count(*) FILTER (WHERE again), 0) AS n_dup_lines,
         coalesce(sum(chars) FILTER (WHERE again), 0) AS dup_chars
  FROM (
    SELECT r, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
           row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AND chars > 0 AS again
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs))
  GROUP BY r),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
threes AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS again
  FROM (SELECT r, i, word || ' ' || lead(word) OVER by_place || ' ' || lead(word, 2) OVER by_place AS g
        FROM words WINDOW by_place AS (PARTITION BY r ORDER BY i)) WHERE g IS NOT NULL),
repeating AS (SELECT * FROM words WHERE r IN (SELECT r FROM threes WHERE again)),
grams AS (
  SELECT r, 3 AS n, i, again AS marks FROM threes
  {grams}),
marked AS (
  SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM grams WHERE marks),
shares AS (
  SELECT r, count(*) FILTER (WHERE n = 3) AS n_repeat_words,
         {sums}
  FROM marked JOIN words USING (r, i) GROUP BY r),
base AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         l.n_dup_lines::BIGINT AS n_dup_lines, coalesce(s.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (l.dup_chars / greatest(word_chars, 1))::DOUBLE AS dup_line_share,
         {ratios}
  FROM docs d JOIN lines l ON d.r = l.r LEFT JOIN shares s ON d.r = s.r)
SELECT * EXCLUDE (r), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND dup_line_share <= {lines} AND {limits} AS kept
FROM base
"""


def op4_sql(rules: quality.Rules = quality.Rules()) -> str:
    lengths = dict(rules.coverage)
    return OP4_SQL.format(
        grams="\n  ".join(
            f"UNION ALL SELECT r, {n}, i, row_number() OVER (PARTITION BY r, g ORDER BY i) > 1 FROM (SELECT r, i, word"
            + "".join(f" || ' ' || lead(word, {k}) OVER by_place" for k in range(1, n))
            + " AS g FROM repeating WINDOW by_place AS (PARTITION BY r ORDER BY i)) WHERE g IS NOT NULL"
            for n in lengths
        ),
        sums=",\n         ".join(f"sum(length(word)) FILTER (WHERE n = {n}) AS c{n}" for n in lengths),
        ratios=",\n         ".join(f"(coalesce(s.c{n}, 0) / greatest(word_chars, 1))::DOUBLE AS dup_{n}gram_share" for n in lengths),
        lines=rules.lines,
        limits=" AND ".join(f"dup_{n}gram_share <= {x}" for n, x in lengths.items()),
    )


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (3 * source_size)::DOUBLE AS most FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY most / weight, place) AS nth
  FROM weighed),
level AS (SELECT level FROM levels WHERE level * weight <= most ORDER BY nth LIMIT 1),
plan AS (
  SELECT source, source_size, least(most, level.level * weight) AS target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - whole * source_size AS rest
  FROM levels, level),
placed AS (
  SELECT d.doc_id, d.size, p.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * least(3, whole + (2 * before + size <= 2 * rest)::INT))::BIGINT AS taken
FROM placed
"""

OP2_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
quads AS (
  SELECT *, list_transform(range(8), lambda q: ('0x' || substr(hex, (5 * q + 1)::INT, 5))::BIGINT) AS twenty FROM hashed),
named AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((twenty[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM quads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER (PARTITION BY hex) THEN max(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM named
"""

OP5_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(e, e)) AS norm FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
       least(vec_id, (SELECT min(b) FROM reached WHERE a = vec_id)) AS component_id,
       vec_id = least(vec_id, (SELECT min(b) FROM reached WHERE a = vec_id)) AS kept
FROM embeddings
"""

OP11_FIRST = """
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[(p * len(v) // 4 + 1)::INT : ((p + 1) * len(v) // 4)::INT] AS x FROM kept, range(4) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM parts WHERE r < 256)"""

OP11_ROUND = """
found{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x,
         min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + e)::BIGINT AS best
  FROM parts JOIN book{k} USING (p) GROUP BY r, p),
book{next} AS MATERIALIZED (
  SELECT p, e, coalesce(n.c, o.c) AS c
  FROM book{k} o LEFT JOIN (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS c
    FROM (SELECT p, best % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM found{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY ALL)
    GROUP BY p, e) n USING (p, e))"""

OP11_LAST = """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM kept JOIN (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM found{k} GROUP BY r) USING (r),
     (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda y: y::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS digest FROM book{k})
"""


def op11_sql(rounds: int = 4) -> str:
    steps = [OP11_FIRST, *[OP11_ROUND.format(k=k, next=k + 1) for k in range(rounds + 1)]]
    return "WITH " + ",".join(steps) + OP11_LAST.format(k=rounds)


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b
  FROM lowered),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b::BIGINT[]), lambda c, x: xor(t[((xor(c, x) & 255) + 1)::INT], c >> 8))) AS h FROM bytes, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS MATERIALIZED (
  SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM gone x JOIN gone y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
led AS (SELECT word, word AS at FROM formed UNION ALL SELECT l.word, f.form FROM led l JOIN formed f ON l.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN led l ON f.word = l.word JOIN formed e ON l.at = e.word WHERE e.form IS NULL
"""

QUERIES: dict[str, Build] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_warc_round_trip, op3_token_counts, op4_quality_rules, op5_embedding_near_dedup, op6_secret_scan,
        op7_best_fit_packing, op8_simhash_near_dedup, op9_byte_balanced_shards, op10_source_mix,
        op11_vector_codes, op12_bpe_round_trip, op13_spelling_variants,
    )
}
ORACLE: dict[str, str] = {
    "op2_warc_round_trip": OP2_SQL, "op4_quality_rules": op4_sql(), "op5_embedding_near_dedup": OP5_SQL, "op10_source_mix": OP10_SQL,
    "op11_vector_codes": op11_sql(), "op13_spelling_variants": OP13_SQL,
}
