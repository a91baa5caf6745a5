"""Byte-level BPE of a corpus with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 32 bytes says so, so that a passage is cut
alike wherever it stands. A chunk that more than one document holds is encoded once, into
a table of ids by chunk digest; documents without such a chunk are encoded where
they are read. A document of several chunks then has wrong ids at its chunk joins, as
a cut may part a word. Each join is repaired: the text from some words before it to some
words after it is encoded again, and the new ids must agree with the chunks' own in
the outermost words; where they do not, the stretch is widened, at last to the whole text.

A word here begins at a boundary between an ASCII mark, letter or digit and ASCII white
space. The splitter of a byte-level tokenizer never has a piece across such a
boundary, nor looks back over it, so the ids on both sides are those of the two texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import col, in_one, others, out_of
from microatlas.llm.simhash import references
from microatlas.runtime import settle

_SPACE = " \t\n\v\f\r"
#: White space beyond ASCII, and what only some call white space.
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PAGE = 15  # bits of a page of the filter: 4 KB


@dataclass(frozen=True)
class Chunking:
    """Chunks have ``least`` to ``most`` bytes, and a cut after one in ``2**bits`` of them.

    ``filter_bits`` gives the size of the bitmap of shared chunks, 16 MB for 27 at any
    corpus; where it fills up, more chunks go through the table than need to.
    """

    bits: int = 9
    least: int = 128
    most: int = 8192
    filter_bits: int = 27


_GEAR = (references(256) >> np.uint64(32)).astype(np.uint32)


def cuts(raw: bytes, rule: Chunking = Chunking()) -> list[int]:
    """Where the chunks of a UTF-8 text end. No cut parts a character."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if n <= rule.least:
        return [n] if n else []
    found: list[np.ndarray] = []
    step = 1 << 20
    for at in range(0, n, step):
        low = max(0, at - 31)
        h = _GEAR[b[low : at + step]]
        for s in (1, 2, 4, 8, 16):  # the sum of 32 table entries, each shifted by its age
            h[s:] += h[:-s] << np.uint32(s)
        here = np.flatnonzero(h >> np.uint32(32 - rule.bits) == 0) + low + 1
        found.append(here[here > at])
    places = np.concatenate(found)
    out: list[int] = []
    last = 0

    for p in [*places.tolist(), n]:
        while p - last > rule.most:
            last = _whole(raw, last + rule.most)
            out.append(last)
        if p - last >= rule.least or (p == n and p > last):
            last = _whole(raw, p)
            out.append(last)
    return out


def _whole(raw: bytes, p: int) -> int:
    """The next place that parts no character."""
    while p < len(raw) and raw[p] & 0xC0 == 0x80:
        p += 1
    return p


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks_of(raw: bytes, rule: Chunking) -> tuple[list[bytes], list[bytes]]:
    """The chunks and their digests."""
    ends = cuts(raw, rule)
    parts = [raw[a:b] for a, b in zip([0, *ends], ends)]
    return parts, [chunk_digest(p) for p in parts]


def slot_of(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "little") & ((1 << bits) - 1)


# --- the vocabulary and the library


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: bytes that print stand for
    themselves, the rest follow each other from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What the bytes of each id are, and the library that encodes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        level = spec.get("pre_tokenizer") or {}
        if level.get("type") != "ByteLevel" or not level.get("use_regex", True) or level.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = byte_alphabet()
        names = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_of[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.shown = [b"%d," % i for i in range(len(self.bytes_of))]
        self.code = "H" if len(self.bytes_of) <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        space = set(_SPACE.encode())
        self.starts_space = np.array([bool(b) and b[0] in space for b in self.bytes_of])
        self.ends_mark = np.array([bool(b) and 0x21 <= b[-1] <= 0x7E for b in self.bytes_of])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The library's own ids."""
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text as the library's decode gives it, special tokens included."""
        return self.raw(ids).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b"".join(map(self.shown.__getitem__, ids.tolist()))[:-1]

    def boundaries(self, ids: np.ndarray) -> np.ndarray:
        """Places between ids where a word ends and white space begins."""
        return np.flatnonzero(self.ends_mark[ids[:-1]] & self.starts_space[ids[1:]]) + 1


_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"


class Pieces(dict):
    """Ids, as bytes, of the pieces and words seen, made when one is first asked for.

    Words of common characters are cut as the splitter does, and their pieces go straight to
    the library's model; other words go through all of the library.
    """

    _common = re.compile(f"[{_SPACE}\x21-\x7e{_LETTER}\u2010-\u2027]*")
    cut = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.tokenize = vocabulary, vocabulary.library.model.tokenize
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.special = vocabulary.special

    def plain(self, text: str) -> bool:
        """Whether the splitter is known on all of the text."""
        return self._common.fullmatch(text) is not None and not any(x in text for x in self.special)

    def __missing__(self, word: str) -> bytes:
        if self.plain(word):
            pieces = self.cut.findall(word)
            if len(pieces) > 1:
                return b"".join([self[x] for x in pieces])
            ids = array(self.vocabulary.code, [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.shown))]).tobytes()
        else:
            ids = self.vocabulary.encode([word])[0].tobytes()
        if len(word) <= Encoder.LONG:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, as the library gives them, with a memory of pieces and words.

    Texts of common characters are cut into the splitter's pieces, others into words, see the
    module. Texts with white space beyond ASCII, or what some call white space, go to the
    library whole.
    """

    KNOWN = 600_000  # remembered pieces: about 80 MB
    LONG = 64
    PART = 1 << 20

    _word = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
    _end = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
    _odd = re.compile(f"[{_ODD_SPACE}]")

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.known = vocabulary, Pieces(vocabulary)

    def _parts(self, text: str) -> Iterator[str]:
        """The text cut between words into parts that bound the memory."""
        at = 0
        while len(text) - at > self.PART:
            found = self._end.search(text, at + self.PART)
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:] if at else text

    def _ids(self, text: str) -> np.ndarray:
        if self._odd.search(text):
            return self.vocabulary.encode([text])[0]
        split = self.known.cut if self.known.plain(text) else self._word
        raw = b"".join([b"".join(map(self.known.__getitem__, split.findall(part))) for part in self._parts(text)])
        if len(self.known) > self.KNOWN:
            self.known.clear()
        return np.frombuffer(raw, self.vocabulary.kind)

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self._ids(text) for text in texts]


# --- chunk joins


def _plan(chunks: list[np.ndarray], marks: list[np.ndarray], width: int, vocabulary: Vocabulary):
    """Kept stretches of the chunks' ids, and between them the texts to be encoded again
    with the ids they must begin and end with.

    A chunk with too few words for two stretches is encoded again whole.
    """
    out: list[np.ndarray | tuple[bytes, np.ndarray, np.ndarray]] = []
    none = chunks[0][:0]
    text: list[bytes] = []  # of the open stretch
    first, is_open = none, False
    for i, (ids, at) in enumerate(zip(chunks, marks)):
        last = i == len(chunks) - 1
        head = 0 if i == 0 else int(at[width]) if len(at) > width else None
        tail = len(ids) if last else int(at[-1 - width]) if len(at) > width else None
        if head is None or tail is None or head > tail:
            text.append(vocabulary.raw(ids))
            is_open = True
            continue
        if is_open:
            text.append(vocabulary.raw(ids[:head]))
            out.append((b"".join(text), first, ids[int(at[width - 1]) : head]))
            text, is_open = [], False
        out.append(ids[head:tail])
        if not last:
            text, first, is_open = [vocabulary.raw(ids[tail:])], ids[tail : int(at[-width])], True
    if is_open:
        out.append((b"".join(text), first, none))
    return out


def join_chunks(documents: list[list[np.ndarray]], vocabulary: Vocabulary, width: int = 1) -> list[np.ndarray]:
    """Ids of whole documents from those of their chunks, every join repaired."""
    out: list[np.ndarray] = [np.zeros(0, vocabulary.kind)] * len(documents)
    todo = [i for i, chunks in enumerate(documents) if chunks]
    marks = {i: [vocabulary.boundaries(c) for c in documents[i]] for i in todo}
    while todo:
        plans = {i: _plan(documents[i], marks[i], width, vocabulary) for i in todo}
        windows = [part[0].decode() for i in todo for part in plans[i] if isinstance(part, tuple)]
        again = iter(vocabulary.encode(windows))
        apart = []
        for i in todo:
            pieces, agree = [], True
            for part in plans[i]:
                if isinstance(part, tuple):
                    _, first, last = part
                    part = next(again)
                    agree &= np.array_equal(part[: len(first)], first) and (not len(last) or np.array_equal(part[-len(last) :], last))
                pieces.append(part)
            if agree:
                out[i] = np.concatenate(pieces)
            else:
                apart.append(i)
        todo, width = apart, 2 * width
    return out


# --- the corpus


def _first_seen(batches: Iterator[pa.RecordBatch], remembered: int = 200_000) -> Iterator[tuple[list[bytes], list[str]]]:
    """Digests and texts this task has not met yet, as far as it remembers."""
    seen: set[bytes] = set()
    for batch in batches:
        keys, texts = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key not in seen:
                seen.add(key)
                keys.append(key)
                texts.append(text)
        if len(seen) > remembered:
            seen.clear()
        yield keys, texts


def contents(docs: DataFrame, text: str) -> DataFrame:
    """``digest`` and ``text`` of every row; null is the empty text."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    return docs.select(F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("text"))


def shared_filter(texts: DataFrame, rule: Chunking) -> bytes:
    """A bitmap (compressed) with a bit for every chunk that several documents hold.

    Counts are combined per task, then by digest; what reaches the driver is the bitmap, of
    a size that ``rule`` fixes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bodies in _first_seen(batches):
            times: dict[bytes, int] = {}
            for body in bodies:
                for d in set(chunks_of(body.encode(), rule)[1]):
                    times[d] = times.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64())], names=["chunk", "n"])

    counted = texts.mapInArrow(count, "chunk binary, n bigint").groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([slot_of(d, rule.filter_bits) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found >> _PAGE), pa.array((found & ((1 << _PAGE) - 1)).astype(np.int32))], names=["page", "bit"])

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            page, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(page).tolist():
                pages.setdefault(p, np.zeros(1 << _PAGE, bool))[bit[page == p]] = True
        for p, bits in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], names=["page", "bits"])

    spread = counted.select("chunk").mapInArrow(slots, "page bigint, bit int").distinct().repartition("page")
    whole = np.zeros((1 << rule.filter_bits) >> 3, np.uint8)
    for page, bits in spread.mapInArrow(paged, "page bigint, bits binary").collect():
        at = page << (_PAGE - 3)
        whole[at : at + (1 << (_PAGE - 3))] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


class _Filter:
    def __init__(self, packed: bytes, rule: Chunking) -> None:
        self.bitmap, self.bits = zlib.decompress(packed), rule.filter_bits

    def __call__(self, digests: Sequence[bytes]) -> list[bool]:
        out = []
        for d in digests:
            slot = slot_of(d, self.bits)
            out.append(bool(self.bitmap[slot >> 3] & (128 >> (slot & 7))))
        return out


#: What is made of texts' digests and ids, and its schema.
Emit = Callable[[Vocabulary, list[bytes], list[np.ndarray]], pa.RecordBatch]
_IDS = "digest binary, ids array<int>"
_SUMS = "digest binary, n_tokens bigint, ids_sha256 binary, decoded_sha256 binary"


def _sums_batch(vocabulary: Vocabulary, keys: list[bytes], ids: list[np.ndarray]) -> pa.RecordBatch:
    """Number of ids, and the digests of the decimal ids joined by commas and of the text they decode to."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(vocabulary.listed(x)).digest() for x in ids], pa.binary()),
            pa.array([hashlib.sha256(vocabulary.decode(x).encode()).digest() for x in ids], pa.binary()),
        ],
        names=["digest", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _ids_batch(_: Vocabulary, keys: list[bytes], ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *[len(x) for x in ids]]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, values)], names=["digest", "ids"])


def _by_size(keys: list[bytes], bodies: list, most: int = 1 << 20) -> Iterator[tuple[list[bytes], list]]:
    at = size = 0
    for i, body in enumerate(bodies):
        size += len(body)
        if size >= most or i == len(bodies) - 1:
            yield keys[at : i + 1], bodies[at : i + 1]
            at, size = i + 1, 0


def encode_contents(texts: DataFrame, tokenizer: str, rule: Chunking = Chunking(), emit: Emit = _ids_batch, schema: str = _IDS) -> DataFrame:
    """``digest`` and ``ids`` (or what ``emit`` makes of them) of the distinct texts among
    (``digest``, ``text``).

    A text that several tasks read may be there more than once, with equal ids.
    """
    packed = shared_filter(texts, rule)

    def unshared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, hit = Vocabulary(tokenizer), _Filter(packed, rule)
        encode = Encoder(vocabulary)
        for keys, bodies in _first_seen(batches):
            own = [i for i, body in enumerate(bodies) if not any(hit(chunks_of(body.encode(), rule)[1]))]
            for some, parts in _by_size([keys[i] for i in own], [bodies[i] for i in own]):
                yield emit(vocabulary, some, encode(parts))

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, squeeze = _Filter(packed, rule), zstandard.ZstdCompressor(level=3)
        for keys, bodies in _first_seen(batches):
            out: list[tuple] = []
            for key, body in zip(keys, bodies):
                raw = body.encode()
                parts, digests = chunks_of(raw, rule)
                hits = hit(digests)
                if any(hits):
                    ends = np.cumsum([len(p) for p in parts]).astype("<i8").tobytes()
                    shared = np.array([int(h) for h in hits], np.uint8).tobytes()
                    out.append((key, squeeze.compress(raw), ends, shared, list(dict.fromkeys(d for d, h in zip(digests, hits) if h))))
            kinds = [pa.binary()] * 4 + [pa.list_(pa.binary())]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "packed", "ends", "shared", "chunks"])

    pending = settle(
        texts.mapInArrow(sharing, "digest binary, packed binary, ends binary, shared binary, chunks array<binary>"), "sharing-documents"
    )

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sent = zstandard.ZstdDecompressor(), set()
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for raw, ends, shared in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for part in _marked(open_.decompress(raw), ends, shared):
                    d = chunk_digest(part)
                    if d not in sent:
                        sent.add(d)
                        found[d] = part
            if len(sent) > 200_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["chunk", "body"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(Vocabulary(tokenizer))
        for batch in batches:
            ids = encode([b.decode() for b in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], names=["chunk", "own"])

    once = pending.select("packed", "ends", "shared").mapInArrow(texts_of, "chunk binary, body binary").groupBy("chunk").agg(F.first("body").alias("body"))
    table = settle(once.mapInArrow(encode_chunks, "chunk binary, own binary"), "chunk-ids")
    none = F.lit(None).cast("binary")
    asked = pending.select("digest", F.explode("chunks").alias("chunk")).join(table, "chunk")
    rows = pending.select("digest", none.alias("chunk"), none.alias("own"), "packed", "ends", "shared").unionByName(
        asked.select("digest", "chunk", "own", none.alias("packed"), none.alias("ends"), none.alias("shared"))
    )
    # A document's row comes before those of its chunks; a document's chunks are bounded by its text.
    met = rows.repartition("digest").sortWithinPartitions("digest", F.col("chunk").asc_nulls_first())

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, open_ = Vocabulary(tokenizer), zstandard.ZstdDecompressor()
        encode = Encoder(vocabulary)

        def finished(group: list[tuple]) -> pa.RecordBatch:
            layouts = [(_split(raw, ends), np.frombuffer(shared, np.uint8), own) for _, raw, ends, shared, own in group]
            fresh = [p for parts, marked, _ in layouts for p, m in zip(parts, marked) if not m]
            made = iter(encode([p.decode() for p in fresh]))
            whole = [
                [np.frombuffer(own[chunk_digest(p)], vocabulary.kind) if m else next(made) for p, m in zip(parts, marked)]
                for parts, marked, own in layouts
            ]
            return emit(vocabulary, [g[0] for g in group], join_chunks(whole, vocabulary))

        group: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for key, chunk, own, raw, ends, shared in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if key != last:
                    if size >= 1 << 20:
                        yield finished(group)
                        group, size = [], 0
                    text = open_.decompress(raw)
                    group.append((key, text, ends, shared, {}))
                    size += len(text)
                    last = key
                elif chunk is not None:
                    group[-1][4][chunk] = own
        if group:
            yield finished(group)

    return texts.mapInArrow(unshared, schema).unionByName(met.mapInArrow(repair, schema))


def _split(raw: bytes, ends: bytes) -> list[bytes]:
    places = np.frombuffer(ends, "<i8").tolist()
    return [raw[a:b] for a, b in zip([0, *places], places)]


def _marked(raw: bytes, ends: bytes, shared: bytes) -> list[bytes]:
    return [p for p, m in zip(_split(raw, ends), shared) if m]


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with ``decoded``, the text of the ids; null ids give null."""
    kept = [c for c in (keep if keep is not None else df.columns) if c != "decoded"]
    source = df.select(in_one(kept).alias("whole_row"), col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            texts = [vocabulary.decode(lists[i].values.to_numpy()) if lists[i].is_valid else None for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["whole_row", "decoded"])

    schema = T.StructType([source.schema["whole_row"], T.StructField("decoded", T.StringType())])
    return source.mapInArrow(run, schema).select(*out_of("whole_row", kept), "decoded")


def _each(docs: DataFrame, found: DataFrame, text: str, keep: list[str] | None, new: list[str]) -> DataFrame:
    kept = [c for c in (keep if keep is not None else others(docs, [text])) if c not in new]
    body = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(in_one(kept).alias("whole_row"), F.unhex(F.sha2(body, 256)).alias("digest"))
    one = found.groupBy("digest").agg(*[F.first(c).alias(c) for c in new])
    # Settled, so that a text of very many rows is split by AQE on the rows' side.
    return rows.join(settle(one, "encoded"), "digest").select(*out_of("whole_row", kept), *new)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, rule: Chunking = Chunking()) -> DataFrame:
    """Every row with ``ids``, those of the tokenizers library without added tokens.

    Null is the empty text and has no ids; strings of special tokens inside texts become
    their ids, as is the library's default. Equal texts are encoded once and each of their rows
    returned; an empty table gives none. Input columns named like a result are replaced; the
    text is returned only if it is among ``keep``. ``tokenizer`` is the file of a byte-level
    BPE without normaliser; any other is an error. Texts may have any length: memory
    holds one whole text and its ids at a time.
    """
    return _each(docs, encode_contents(contents(docs, text), tokenizer, rule), text, keep, ["ids"])


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, rule: Chunking = Chunking()) -> DataFrame:
    """Every row with ``n_tokens`` and the digests of its ids and of what they decode to.

    As ``encode``; only digests, not ids, meet the rows.
    """
    sums = ["n_tokens", "ids_sha256", "decoded_sha256"]
    found = _each(docs, encode_contents(contents(docs, text), tokenizer, rule, _sums_batch, _SUMS), text, keep, sums)
    named = {c: F.lower(F.hex(c)) if c != "n_tokens" else F.col(c) for c in sums}
    return found.select(*[col(c) for c in found.columns if c not in named], *[e.alias(c) for c, e in named.items()])
