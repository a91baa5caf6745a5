"""WARC archives written by a deterministic sharded writer, and read back.

Records are dealt to shards by ranges of a key of id, digest and address. The ranges are cut
at equal steps of the bytes summed in the order of that key, so the same records always make
the same files and no id is too frequent to be split. A shard's records are
sorted, and each file is rolled when its compressed size is reached. Headers and digests are
made anew from the records. A file is written under a temporary name and moved to its
own when complete; the manifest, committed by Spark, lists the files that count. A
task that runs twice moves the same bytes to the same name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microatlas.llm.common import col
from microatlas.llm.sharding import with_prefix_sums
from microatlas.runtime import scratch_path, settle

#: Compressed bytes read by a task, where there are enough files for all cores.
READ_BYTES = 64 << 20
RESPONSE, REVISIT = "response", "revisit"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    """``shard_bytes``: payload bytes dealt to a shard; ``max_shards``: shards grow instead
    of becoming more, which bounds the table of their first keys (37 bytes each);
    ``roll_bytes``: compressed size at which a file ends; ``min_payload``: payloads from this
    size on are written once; ``date``: the date of all records, fixed so that reruns give the
    same bytes."""

    shard_bytes: int = 32 << 20
    max_shards: int = 32_768
    roll_bytes: int = 16 << 20
    min_payload: int = 0
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def filesystem(uri: str):
    """The file system of a path that all executors share, and the path there."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    return fs.FileSystem.from_uri(uri)


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}|{digest}')}>"


def _header_value(text: str) -> str:
    """A value that cannot break out of its header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page, url, payload: bytes, digest: str, first: tuple | None, date: str) -> bytes:
    """One WARC record. ``first`` is (page, url) of the response that a revisit is of."""
    target = _header_value(url) if url else f"urn:page:{'' if page is None else page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {REVISIT if first else RESPONSE}",
        f"WARC-Record-ID: {record_id(page, url, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{bare_digest(block)}",
    ]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if first:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(*first, digest)}"]
        if first[1]:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_value(first[1])}")
        if first[0] is not None:
            lines.append(f"X-Refers-To-Page-Id: {first[0]}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _eight_bytes(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def place_key(page: Column, digest: Column, url: Column) -> Column:
    """37 bytes in the order of the id, null first, then of the digest; a hash of the address
    tells apart what is left."""
    numbered = F.concat(F.unhex(F.lit("01")), _eight_bytes(page.bitwiseXOR(F.lit(-(1 << 63)))))
    return F.concat(F.coalesce(numbered, F.unhex(F.lit("00" * 9))), digest, _eight_bytes(F.xxhash64(url)))


def first_keys(records: DataFrame, target: int, most: int) -> list[bytes]:
    """The first key of every shard, in order, from ``key`` and ``size``: a shard takes the
    next ``target`` bytes, or a ``most``-th of all if that is more.

    One key is never cut. At most ``most`` keys reach the driver.
    """
    sums = records.groupBy("key").agg(F.sum("size").alias("size"))
    sums = settle(sums, "record-keys")
    placed = with_prefix_sums(sums, "size", ["key"])
    total = sums.agg(F.sum("size")).first()[0] or 0
    step = max(target, -(-total // most), 1)
    cuts = placed.groupBy(F.expr(f"before div {step}").alias("shard")).agg(F.min("key").alias("key"))
    return sorted(bytes(r[0]) for r in cuts.select("key").collect())


def in_shards(records: DataFrame, firsts: list[bytes]) -> DataFrame:
    """``records`` with ``shard`` in place of their last column, ``key``."""
    names = [*records.columns[:-1], "shard"]
    schema = records.drop("key").withColumn("shard", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, keys = batch.columns
            shard = [max(0, bisect_right(firsts, k) - 1) for k in keys.to_pylist()]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(shard, pa.int32())], names=names)

    return records.mapInArrow(run, schema)


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha1(payload))


def decisions(known: DataFrame, min_payload: int) -> DataFrame:
    """The (``id``, ``url``, ``digest``) that are not a single response, with the ``first_id``
    and ``first_url`` they are revisits of, from distinct ones with their ``rows`` and bytes ``n``.

    Where the response itself is repeated, one of its rows is the response.
    """
    known = known.filter(F.col("n") >= min_payload)
    # Nulls come first in a struct's order: a null id is the largest only among nulls.
    first = known.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("first"), F.sum("rows").alias("all")).filter("all > 1")
    single = F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("rows") == 1)
    return known.join(first.select("digest", "first"), "digest").filter(~single).select(
        "id", "url", "digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")
    )


_MANIFEST = "name string, bytes bigint, sha256 string, records bigint, first_id bigint, last_id bigint"


def write(
    pages: DataFrame, root: str, settings: Settings = Settings(), id_column: str = "page_id", url: str = "url", payload: str = "html"
) -> DataFrame:
    """Archives of all rows under ``root``; returns the committed manifest.

    Null payloads are empty. Rows are sorted by id (nulls first), digest and url within
    a shard; an id, or no id, that many rows have goes to as many shards as its bytes fill.
    Only repeated rows stay together: they are records of their own, all but one of them
    revisits. Other columns are not written. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    body = F.coalesce(col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        col(id_column).cast("bigint").alias("id"), col(url).cast("string").alias("url"), body.alias("payload"), _digest(body).alias("digest")
    )
    narrow = rows.select("id", "url", "digest", F.octet_length("payload").cast("bigint").alias("n"))
    known = settle(narrow.groupBy("id", "url", "digest").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "page-digests")
    key = place_key(F.col("id"), F.col("digest"), F.col("url")).alias("key")
    firsts = first_keys(known.select(key, ((F.col("n") + 512) * F.col("rows")).alias("size")), settings.shard_bytes, settings.max_shards)

    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    records = rows.select("id", "digest", F.lit(1).alias("kind"), "url", "payload", none("bigint").alias("first_id"), none("string").alias("first_url"), key)
    decided = decisions(known, settings.min_payload).select(
        "id", "digest", F.lit(0).alias("kind"), "url", none("binary").alias("payload"), "first_id", "first_url", key
    )
    # Decisions travel in the same shuffle as the records and arrive before theirs.
    both = in_shards(records.unionByName(decided), firsts)
    dealt = both.repartitionById(max(1, len(firsts)), F.col("shard")).sortWithinPartitions("shard", "id", "digest", "url", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = filesystem(root)
        disk.create_dir(base, recursive=True)
        out = _Roller(disk, base, settings)
        decided, origin, used = None, None, False
        for batch in _slices(batches):
            for page, raw, kind, link, content, first, first_link, shard in zip(*[c.to_pylist() for c in batch.columns]):
                if kind == 0:
                    decided, origin, used = (page, raw, link), (first, first_link), False
                    continue
                of = None
                if decided == (page, raw, link):
                    of = origin
                    if origin == (page, link) and not used:
                        of, used = None, True  # the response itself
                digest = bare_digest(content)
                out.add(shard, page, record(page, link, content, digest, of, settings.date))
            yield from out.done()
        out.close()
        yield from out.done()

    manifest = dealt.mapInArrow(run, _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    return read_manifest(spark, root)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Roller:
    """Files of a shard, one gzip member per record."""

    def __init__(self, disk, base: str, settings: Settings) -> None:
        self.disk, self.base, self.settings = disk, base, settings
        self.shard, self.number, self.sink, self.rows = None, 0, None, []

    def add(self, shard: int, page: int | None, data: bytes) -> None:
        if self.sink and (shard != self.shard or self.size >= self.settings.roll_bytes):
            self.close()
        if not self.sink:
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.first = shard, 0, 0, page
            self.hash = hashlib.sha256()
            self.name = f"part-{shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.base}/_{self.name}.{uuid.uuid4().hex}"
            self.sink = self.disk.open_output_stream(self.temporary)
        squeeze = zlib.compressobj(self.settings.level, zlib.DEFLATED, 31)
        member = squeeze.compress(data) + squeeze.flush()
        self.sink.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page

    def close(self) -> None:
        if self.sink:
            self.sink.close()
            self.disk.move(self.temporary, f"{self.base}/{self.name}")
            self.rows.append((self.name, self.size, self.hash.hexdigest(), self.records, self.first, self.last))
            self.sink = None

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["name", "bytes", "sha256", "records", "first_id", "last_id"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*self.rows), kinds)], names=names)
            self.rows = []


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    inflate, out = zlib.decompressobj(31), []
    data = stream.read(step)
    while data:
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
        data = data or stream.read(step)
    if any(out):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes, int, bytes]:
    """Headers, block, length of the full payload, and the payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{bare_digest(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"not a whole record: {headers.get('WARC-Record-ID')}")
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return headers, block, length, body


def read(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """The records of all files in the manifest, each checked against its digests:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload,
    null for revisits)."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 7 if with_payload else 6]
    fields = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    names = [x.split()[0] for x in (fields + ", payload binary").split(", ")][: len(kinds)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = filesystem(root)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, count = [], 0, 0
                with disk.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, _, length, body = parse(data)
                        kind = headers["WARC-Type"]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == RESPONSE and (len(body) != length or bare_digest(body) != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is not whole")
                        page, of = (headers.get(h) for h in ("X-Page-Id", "X-Refers-To-Page-Id"))
                        row = (page and int(page), headers["WARC-Target-URI"], length, digest, kind, of and int(of))
                        rows.append((*row, body if kind == RESPONSE else None) if with_payload else row)
                        held, count = held + (len(body) if with_payload else 0), count + 1
                        if len(rows) >= 10_000 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if count != expected:
                    raise ValueError(f"{name} holds {count} records, not {expected}")

    manifest = read_manifest(spark, root)
    n, total = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    # The list is tiny and would be read by one task; what it names is not.
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, (total or 0) // READ_BYTES)))
    files = manifest.select("name", "records")
    return files.repartition(tasks).mapInArrow(run, fields + (", payload binary" if with_payload else ""))


def write_and_read(pages: DataFrame, root: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """The records of ``pages`` after a round trip through archives."""
    spark = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    write(pages, root, settings)
    return read(spark, root)
