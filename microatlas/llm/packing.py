"""Best-fit packing of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the plan is made on their histogram:
at most one row per length, whatever the corpus holds. Pieces above a third of the
capacity can share a sequence with one other such piece at most: from the longest
down, each takes the longest partner that fits, a maximum matching. Shorter pieces, longest
first, fill the smallest remaining gap that holds them, and open a new sequence only
when none does. The plan says which ranks of a length go where; ranks come from counts
per task, without sorting.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import col, in_one, others, out_of
from microatlas.runtime import settle

CAPACITY = 2048
SEPARATOR = 0


#: What the word memory relies on; any other tokenizer gets whole texts.
_WORD_BPE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "suffix": "</w>",
}


def _splits_at_spaces(spec: dict) -> bool:
    try:
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        found = {
            "normalizer": [n["type"] for n in spec["normalizer"]["normalizers"]],
            "pattern": split["pattern"]["Regex"],
            "suffix": spec["model"]["end_of_word_suffix"],
        }
        return found == _WORD_BPE and split["invert"] and level["type"] == "ByteLevel" and not level["use_regex"]
    except (KeyError, TypeError, ValueError):
        return False


_LETTER = "a-z\xdf-\xf6\xf8-\xff"


class Words(dict):
    """Ids of the words seen, little-endian, made when a word is first asked for.

    Words of lower-case letters, digits and ASCII marks are cut as the splitter does
    and go straight to the library's model; others go through all of the library.
    """

    _letters = re.compile(f"[{_LETTER}]+")
    _simple = re.compile(f"[{_LETTER}!-@\\[-`{{-~]+")
    _pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")

    def __init__(self, library, older: dict[str, bytes]) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.model, self.older = library, library.model, dict(older)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self.level)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if self._letters.fullmatch(word):
                ids = self._piece(word)
            elif self._simple.fullmatch(word):
                pieces = self._pieces.findall(word)
                ids = b"".join([self[p] for p in pieces]) if len(pieces) > 1 else self._piece(word)
            else:
                ids = self.whole(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts, as the library gives them, with a memory of words.

    The tokenizer splits at white space before anything else and never merges across
    it, so a text's ids are those of its words in a row. Texts in Latin-1 are lower-cased
    first, as the normaliser would. Texts with the strings of special tokens go to the
    library as they are.
    """

    KNOWN = 400_000  # words in each of two generations: about 200 MB
    LONG = 1 << 20
    _rare_space = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.by_words = _splits_at_spaces(json.loads(self.library.to_str()))
        self.words = Words(self.library, {})

    def _words(self, text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
            if len(raw) == len(raw.translate(None, self._rare_space)):
                return text.lower().split()
        except UnicodeEncodeError:
            pass
        return [w for w in re.split("[ \t\n\r]+", text) if w]

    def _parts(self, text: str) -> Iterator[str]:
        """The text cut at spaces, so that no list of words gets very long."""
        start = 0
        while len(text) - start > self.LONG and (stop := text.find(" ", start + self.LONG)) >= 0:
            yield text[start:stop]
            start = stop
        yield text[start:]

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        if not self.by_words or "<|" in text:
            return self.words.whole(text)
        if len(self.words) > self.KNOWN:
            self.words = Words(self.library, self.words)
        known = self.words.__getitem__
        return b"".join([b"".join(map(known, self._words(part))) for part in self._parts(text)])


def pieces(docs: DataFrame, text: str, tokenizer: str, capacity: int, keep: Sequence[str]) -> DataFrame:
    """Kept columns with piece, start, length and ids_crc32, and the piece's place among
    those of its length in its task (``part``, ``nth``), settled."""
    source = docs.select(*[col(c) for c in keep], col(text).cast("string").alias("__text"))
    new = [(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth")]
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("piece", T.IntegerType()), *[T.StructField(*f) for f in new]])
    tail = np.array([SEPARATOR], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = WordEncoder(tokenizer), TaskContext.get().partitionId()
        counts = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for i, ids in enumerate(map(encode, batch.column(len(keep)).to_pylist())):
                ids += tail
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((i, p, at // 4, n, zlib.crc32(own), part, int(counts[n])))
                    counts[n] += 1
            table = np.array(rows, np.int64).reshape(-1, 7)
            place = pa.array(table[:, 0])
            columns = [batch.column(c).take(place) for c in range(len(keep))]
            columns += [pa.array(table[:, 1].astype(np.int32)), *[pa.array(table[:, c].copy()) for c in range(2, 7)]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return settle(source.mapInArrow(run, schema), "pieces")


def plan(histogram: Mapping[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its runs (first rank, first sequence, pieces per sequence,
    offset of the first), and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c}
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
    done = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    sizes: list[int] = []
    total = 0

    def place(n: int, sequence: int, each: int, offset: int, count: int) -> None:
        runs[n].append((done[n], sequence, each, offset))
        done[n] += count
        left[n] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        i = bisect_left(large, capacity - n + 1) - 1
        while i >= 0 and not (left[large[i]] - (large[i] == n)):
            i -= 1
        mate = large[i] if i >= 0 else None
        if mate is None:
            bins = left[n]
            place(n, total, 1, 0, bins)
            leave(capacity - n, total, bins)
        elif mate == n:
            bins = left[n] // 2
            place(n, total, 2, 0, 2 * bins)
            leave(capacity - 2 * n, total, bins)
        else:
            bins = min(left[n], left[mate])
            place(n, total, 1, 0, bins)
            place(mate, total, 1, n, bins)
            leave(capacity - n - mate, total, bins)
        total += bins

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(sizes, n)
            if i < len(sizes):
                gap = sizes[i]
                sequence, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[i]
            else:
                gap, sequence, bins = capacity, total, -(-left[n] // (capacity // n))
                total += bins
            each = gap // n
            full = min(bins, left[n] // each)
            if full:
                place(n, sequence, each, capacity - gap, full * each)
                leave(gap - each * n, sequence, full)
            if full < bins:
                rest = left[n]  # fewer than fill one more sequence
                if rest:
                    place(n, sequence + full, rest, capacity - gap, rest)
                    leave(gap - rest * n, sequence + full, 1)
                    full += 1
                leave(gap, sequence + full, bins - full)
    return runs, total


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, keep: Sequence[str] | None = None
) -> DataFrame:
    """One row per piece: the kept columns, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``.

    A document is its token ids and a separator; only longer ones than the capacity
    are cut. Null, empty and wordless texts are the separator alone. Repeated rows are packed one
    by one; an empty table gives none. Input columns named like a result are replaced;
    the text is returned only if it is among ``keep``.
    """
    new = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = [c for c in (keep if keep is not None else others(docs, [text])) if c not in new]
    source = docs.select(in_one(kept).alias("whole_row"), col(text).alias("text"))
    cut = pieces(source, "text", tokenizer, capacity, ["whole_row"])
    counts = settle(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    # One row per task and length enters the window of a length.
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = settle(counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")), "length-starts")
    # One row per length: bounded by the capacity.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = plan(histogram, capacity)
    tables = {n: np.array(r, np.int64).reshape(-1, 4) for n, r in runs.items()}
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    source = ranked.select("whole_row", "piece", "start", "length", "ids_crc32", "rank")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            out = np.zeros((2, batch.num_rows), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                rows = tables[int(n)]
                own = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - own[:, 0]
                out[0, mine] = own[:, 1] + nth // own[:, 2]
                out[1, mine] = own[:, 3] + nth % own[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=schema.names)

    return source.mapInArrow(run, schema).select(*out_of("whole_row", kept), *new)
