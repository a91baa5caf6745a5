"""Secrets in texts, judged by who else has them.

Three fixed kinds of spans are always reported. Besides, every credential-like string is
a candidate: its hash is counted over the whole corpus by distinct repositories and
owners. What many owners share is a copied example; what hardly anyone else has and looks
random is live, and each of its places is reported, whatever stands around it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import by_text, col, free_name, numbered, others
from microatlas.runtime import settle

BASE = ("assign", "access", "hex")
#: An occurrence of a string that few owners have, added by the method.
LIVE = "live"
KINDS = (*BASE, LIVE)

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WIDE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_WHOLE = re.compile(r"[0-9]\.$")
_UNDOTTED = re.compile(r"[^.]{16,}")

_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_PART = re.compile(r"[A-Za-z0-9]+")
#: A number, a word or words in camel case, with up to four digits behind.
_PLAIN = re.compile(r"[0-9]+|[A-Z]+[0-9]{0,4}|[a-z][0-9]{0,4}|(?:(?:[A-Z][a-z])?[A-Z]?[a-z]{2,}+[0-9]{0,4}+)++(?:[A-Z][a-z]){0,2}")


@dataclass(frozen=True)
class Rules:
    """``max_owners``, ``max_repositories``: a string in more of them is an example.
    ``min_bits``: entropy of its characters, in bits each, from which it looks random."""

    max_owners: int = 2
    max_repositories: int = 4
    min_bits: float = 3.0


def looks_random(value: str, min_bits: float) -> bool:
    """No few characters over and over, and either several letters and digits and no path,
    the shape of a UUID, or half of it or more outside words and numbers."""
    digits, letters, n = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value), len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    if value.isdigit():  # ten characters hold less than the sixteen of a hex string
        return bits >= min_bits * math.log2(10) / 4
    if bits < min_bits:
        return False
    if "." not in value and digits >= 3 and letters >= 3 and 10 * sum(c in "/_-" for c in value) <= n or _UUID.fullmatch(value):
        return True
    parts = _PART.findall(value)
    odd = sum(len(x) for x in parts if not _PLAIN.fullmatch(x))
    return 2 * odd >= sum(map(len, parts))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, the secret itself) of the fixed kinds; end exclusive, in code
    points."""
    out = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                out.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 18:
                out.append(("access", m.start(), m.end(), m[0]))
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def wide_strings(text: str) -> Iterator[tuple[tuple[int, int], str]]:
    """((start, end), string) of the long strings, and of the long parts of dotted ones."""
    for m in _WIDE.finditer(text):
        bare = m[0].strip(".")  # full stops and dots of omission
        start = m.start() + len(m[0]) - len(m[0].lstrip("."))
        if len(bare) >= 16:
            # With one odd part, the others are words of a sentence, host or path around it.
            if "." not in bare or sum(any(not _PLAIN.fullmatch(x) for x in _PART.findall(p)) for p in bare.split(".")) > 1:
                yield (start, start + len(bare)), bare
            if "." in bare:
                for part in _UNDOTTED.finditer(bare):
                    if not part[0].isdigit():
                        yield (start + part.start(), start + part.end()), part[0]


def scan(text: str | None, min_bits: float) -> tuple[list[tuple], list[tuple]]:
    """The base spans, and the candidates (start, end, hash): access and assign values, and what looks random."""
    if not text:
        return [], []
    base = base_spans(text)
    found = dict(wide_strings(text))
    named = set()  # what a keyword or its prefix calls a credential needs no look
    for kind, start, end, value in base:
        if kind == "hex" and value.isdigit() and _WHOLE.search(text[max(0, start - 2) : start]):
            continue  # the fraction of a decimal number
        bare = value.rstrip(".")  # the full stop of a sentence is no part of a secret
        place = (end - len(value), end - len(value) + len(bare))
        if bare:
            found[place] = bare
            if kind != "hex":
                named.add(place)
    wide = [
        (s, e, int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
        for (s, e), v in sorted(found.items())
        if (s, e) in named or looks_random(v, min_bits)
    ]
    return base, wide


def spelled(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.LongType())])
_BASE_SPAN = T.StructType([T.StructField("kind", T.StringType()), *_SPAN.fields[:2]])


def scanned(docs: DataFrame, text: str, keep: list[str], min_bits: float) -> DataFrame:
    fields = [T.StructField("base", T.ArrayType(_BASE_SPAN)), T.StructField("wide", T.ArrayType(_SPAN))]

    def compute(texts):
        found = [scan(t, min_bits) for t in texts]
        return (
            [[{"kind": k, "start": s, "end": e} for k, s, e, _ in b] for b, _ in found],
            [[{"start": s, "end": e, "value": v} for s, e, v in w] for _, w in found],
        )

    return by_text(docs, text, fields, compute, keep)


def ownership(candidates: DataFrame) -> DataFrame:
    """Each candidate ``value`` with its distinct ``owners`` and ``repositories``.

    Pairs are made distinct first, which combines before the shuffle: a string that a
    third of all rows hold arrives as few rows. A null owner or repository counts as one.
    """
    pairs = candidates.select("value", "owner", "repository").distinct()
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("owner", "repository")]
    return pairs.groupBy("value").agg(
        F.count_distinct(named[0]).alias("owners"), F.count_distinct(F.struct(*named)).alias("repositories")
    )


def _judged(docs: DataFrame, text: str, owner: str, repository: list[str], keep: list[str], rules: Rules) -> tuple[DataFrame, str]:
    """Kept columns with ``base``, ``wide`` and the candidate places that are ``live``
    (null if none), settled; and the name of the row number."""
    repo = F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("\x1e")) for c in repository])
    source = docs.select(*[col(c) for c in keep], col(text).alias("__own_text"), F.struct(col(owner).cast("string").alias("owner"), repo.alias("repository")).alias("__by"))
    rows, row = numbered(scanned(source, "__own_text", [*keep, "__by"], rules.min_bits), "secret-scan")
    places = rows.select(row, F.col("__by.owner").alias("owner"), F.col("__by.repository").alias("repository"), F.explode("wide").alias("at")).select(
        row, "owner", "repository", "at.start", "at.end", "at.value"
    )
    alone = ownership(places).filter((F.col("owners") <= rules.max_owners) & (F.col("repositories") <= rules.max_repositories)).select("value")
    # One row's places are bounded by its text.
    live = places.join(settle(alone, "live-values"), "value", "left_semi").groupBy(row).agg(F.collect_list(F.struct("start", "end")).alias("live"))
    return rows.drop("__by").join(settle(live, "live-places"), row, "left"), row


def find_secrets(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
    keep: list[str] | None = None, rules: Rules = Rules(),
) -> DataFrame:
    """Every row with n_assign, n_access, n_hex, n_live, base_sha256 and spans.

    ``spans`` lists kind:start:end by start, then kind; base spans always stay, places of
    owner-specific strings are added as ``live``. Null and empty texts have none (the
    digest is that of the empty string). Repeated rows are scanned one by one but share
    owner and repository; null owners are one owner. An empty table gives none. Input
    columns named like a result are replaced; the text is returned only if kept.
    """
    counts = [f"n_{k}" for k in KINDS]
    new = [*counts, "base_sha256", "spans"]
    kept = [c for c in (keep if keep is not None else others(docs, [text])) if c not in new]
    names = {c: f"__c{i}" for i, c in enumerate(kept)}
    found, _ = _judged(docs.select(*[col(c).alias(n) for c, n in names.items()], col(text).alias("__t"), col(owner).alias("__o"), *[col(c).alias(f"__r{i}") for i, c in enumerate(repository)]), "__t", "__o", [f"__r{i}" for i in range(len(repository))], list(names.values()), rules)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def listed(spans):
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), rank[x["kind"]].alias("r"), x["end"].alias("e"), x["kind"].alias("k"))))
        return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])))

    empty = F.array().cast(T.ArrayType(_BASE_SPAN))
    live = F.coalesce(F.transform("live", lambda x: F.struct(F.lit(LIVE).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), empty)
    both = found.withColumn("live", live)

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return both.select(
        *[F.col(n).alias(c) for c, n in names.items()], *[count(k) for k in BASE], F.size("live").cast("bigint").alias("n_live"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "live")).alias("spans"),
    )


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
    length: str | None = "n_chars", mark: str = "[secret]", rules: Rules = Rules(),
) -> DataFrame:
    """The rows with live secrets masked in their texts; copied examples stay.

    All rows and columns stay, whatever their names; ``length``, if it is a column, is the
    new text's number of characters where the text changed. Null and empty texts stay;
    equal rows are masked alike; a null owner is an owner; an empty table gives none.
    """
    rows, row = numbered(docs, "documents")
    shared = [col(c).alias(f"__r{i}") for i, c in enumerate(repository)]
    narrow = rows.select(col(row).alias("__n"), col(text).alias("__t"), col(owner).alias("__o"), *shared)
    found, _ = _judged(narrow, "__t", "__o", [f"__r{i}" for i in range(len(repository))], ["__n"], rules)
    live = free_name("__live", docs.columns)
    masks = found.filter("live IS NOT NULL").select(F.col("__n").alias(row), F.col("live").alias(live))
    joined = rows.join(settle(masks, "masks"), row, "left")
    # Only rows with a live secret go through Python.
    texts = F.col(live).isNotNull()
    changed = joined.filter(texts)
    same = joined.filter(~texts).select(*[col(c) for c in docs.columns])
    return same.unionByName(_masked_rows(changed, live, docs, text, length, mark))


def _masked_rows(changed: DataFrame, live: str, docs: DataFrame, text: str, length: str | None, mark: str) -> DataFrame:
    place, at = docs.columns.index(text), len(docs.columns)
    source = changed.select(*[col(c) for c in docs.columns], F.col(live))

    def run(batches):
        for batch in batches:
            spans = batch.column(at).to_pylist()
            texts = [masked(t, [(x["start"], x["end"]) for x in s], mark) for t, s in zip(batch.column(place).to_pylist(), spans)]
            columns = [*batch.columns[:place], pa.array(texts, pa.string()), *batch.columns[place + 1 : at]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:at])

    out = source.mapInArrow(run, docs.schema)
    if length in docs.columns:
        out = out.withColumn(length, F.length(col(text)).cast(docs.schema[length].dataType))
    return out
