"""A deterministic sharded WARC writer and its reader.

Records are sorted by page id over shards of about equal payload. The bounds of the shards
come from exact byte counts of id ranges, which are cut until each fits into a shard; an id that
is larger than a shard is spread by digest. So the same table gives the same files whatever
the cluster, and no task has more than two shards' worth, or the copies of one payload. Within a shard a file is closed once its compressed size reaches ``ROLL`` and
the next one begins. Every record is a gzip member with headers and digests made anew from
the payload; a payload that occurred before is a revisit record that refers to the page
with the smallest id.

Commit. A task writes files under names that carry its attempt, so attempts never share a
file, and returns their names; Spark commits those names of the winning attempts as the
staged manifest. A second job moves exactly those files to their final names and may be
repeated at will. The manifest of final names comes last: a reader uses nothing else.

Definitions. A null html is the empty payload. Payloads below ``least`` bytes are never
revisits. A null url gives a record without target. Pages without an id sort last; such a
page is a revisit if a page with an id has the same payload, else a response. If an id is
repeated with one payload, its first row is the response and the others revisit it. An empty
table gives an empty manifest. Columns besides id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurate.session import written

#: Payload bytes of a shard, which is the work of one task, and compressed bytes of a file.
SHARD = 16 << 20
ROLL = 8 << 20
#: Ranges of ids whose bytes are counted to place the bounds of shards.
RANGES = 1 << 14
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_MANIFEST = "shard int, number int, staged string, name string, records long, bytes long, sha256 string"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _target(url: str) -> str:
    return _CONTROL.sub(lambda x: f"%{ord(x[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1_hex: str, refers_to: int | None, name: str, date: str = DATE) -> bytes:
    """The bytes of a record; without payload it is a revisit of page ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_target(url)}")
    if payload is None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _File:
    system: fs.FileSystem
    folder: str
    shard: int
    number: int
    attempt: str
    records: int = 0
    size: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def __post_init__(self):
        self.staged = f"_staged/{self.shard:08d}-{self.number:05d}.{self.attempt}"
        self.system.create_dir(f"{self.folder}/_staged", recursive=True)
        self.out = self.system.open_output_stream(f"{self.folder}/{self.staged}", compression=None)

    def add(self, raw: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.out.write(member)
        self.digest.update(member)
        self.records += 1
        self.size += len(member)

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.number, self.staged, f"{self.shard:08d}-{self.number:05d}.warc.gz", self.records, self.size, self.digest.hexdigest()


def _writer(folder: str, least: int, roll: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        attempt = f"a{TaskContext.get().taskAttemptId()}"
        out, last, marked, unnamed = None, None, None, 0

        def closed(file: _File) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(file.close(), kinds, strict=True)], [x.split()[0] for x in _MANIFEST.split(", ")])

        for batch in batches:
            for row in range(batch.num_rows):
                shard, page_id, sha1_hex, is_page, url, html, first_id = (column[row].as_py() for column in batch.columns)
                if not is_page:
                    marked = page_id, sha1_hex, first_id
                    continue
                if out and (out.shard != shard or out.size >= roll):
                    yield closed(out)
                    number = out.number + 1 if out.shard == shard else 0
                    out, unnamed = _File(system, path, shard, number, attempt), unnamed if number else 0
                elif not out:
                    out = _File(system, path, shard, 0, attempt)
                repeated = page_id is not None and (page_id, sha1_hex) == last
                last = (page_id, sha1_hex)
                payload = html.encode()
                if marked and marked[:2] == last:
                    first_id = marked[2]
                elif repeated and len(payload) >= least:
                    first_id = page_id
                name = str(page_id) if page_id is not None and not repeated else f"{'' if page_id is None else page_id}.{shard}.{unnamed}"
                unnamed += 1
                digest = hashlib.sha1(payload).hexdigest()
                out.add(record(page_id, url, payload if first_id is None else None, len(payload), digest, first_id, name, date))
        if out:
            yield closed(out)

    return write


def _ranges(sizes: DataFrame, shard_bytes: int, ranges: int) -> list[tuple[int, int, int]]:
    """Ranges of ids in order with their bytes: least and largest id that occurs. Only a single id has more than a shard.

    Each pass cuts the ranges that are too large into as many equal parts as ``ranges`` allows, from
    the least to the largest id in them, so an id far away costs one more pass and no balance.
    """
    ends = sizes.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    open_, done = [] if ends["low"] is None else [(ends["low"], ends["high"])], []
    own = F.col("page_id").cast("decimal(20,0)")
    while open_:
        parts = max(2, ranges // len(open_))
        lows, highs = [low for low, _ in open_], [high for _, high in open_]
        at = _bisect(F.col("page_id"), lows)
        of = lambda values: F.element_at(F.array(*(F.lit(v).cast("decimal(20,0)") for v in values)), F.col("at") + 1)  # noqa: B023, E731
        inside = sizes.withColumn("at", at).where((own >= of(lows)) & (own <= of(highs)))
        part = F.floor((own - of(lows)) / of([max(1, -(-(high - low + 1) // parts)) for low, high in open_]))
        found = inside.groupBy("at", part.alias("part")).agg(F.sum("bytes").alias("total"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).collect()
        open_ = []
        for row in found:
            (open_ if row["total"] > shard_bytes and row["low"] < row["high"] else done).append((row["low"], row["high"], row["total"]))
        open_ = sorted((low, high) for low, high, _ in open_)
    return sorted(done)


def _shards(pages: DataFrame, shard_bytes: int, ranges: int) -> tuple[Column, int]:
    """The shard of a row, a number that grows with id and digest, and how many shards there are; it follows from id, url and digest."""
    sizes = written(pages.select("page_id", (F.col("size") + F.lit(512)).alias("bytes")), "sizes")
    nameless = sizes.where("page_id IS NULL").agg(F.sum("bytes")).first()[0] or 0
    # a start of a shard: its least id, its number, and how many shards the id fills if it is alone
    starts, held, n = [], shard_bytes, 0
    for low, _, total in _ranges(sizes, shard_bytes, ranges):
        if held + total > shard_bytes:
            alone = max(1, -(-total // shard_bytes))
            starts.append((low, n, alone))
            n, held = n + alone, shard_bytes if alone > 1 else 0
        held += total
    starts = starts or [(0, 0, 1)]
    n = max(n, 1)
    at = _bisect(F.col("page_id"), [low for low, _, _ in starts])
    number = at
    if any(alone > 1 for _, _, alone in starts):
        of = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in starts)), at + 1).cast("long")
        # the rows of a large id go by the first 32 bits of their digest
        share = F.conv(F.left("sha1_hex", F.lit(8)), 16, 10).cast("long") * of(2)
        number = of(1) + F.shiftright(share, 32)
    extra = -(-nameless // shard_bytes)
    if extra:
        spread = F.lit(n) + F.pmod(F.xxhash64("url", "sha1_hex"), F.lit(extra)).cast("int")
        number = F.when(F.col("page_id").isNull(), spread).otherwise(number)
    return number.cast("int"), n + extra


def _bisect(place: Column, starts: list[int]) -> Column:
    """Number of the last start at or below ``place`` (0 if none is), by a search tree of conditions."""
    if len(starts) == 1:
        return F.lit(0)
    half = len(starts) // 2
    return F.when(place < starts[half], _bisect(place, starts[:half])).otherwise(F.lit(half) + _bisect(place, starts[half:]))


def write(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = SHARD, roll: int = ROLL, date: str = DATE, ranges: int = RANGES) -> DataFrame:
    """Write a record for each row of ``pages`` (``page_id``, ``url``, ``html``) below ``folder`` and return the manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("size"), F.sha1(F.encode(payload, "UTF-8")).alias("sha1_hex"))
    groups = pages.where(F.col("size") >= least).groupBy("sha1_hex").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL").select(F.col("sha1_hex").alias("same"), "first_id")
    again = pages.where(F.col("size") >= least).select("page_id", "sha1_hex", F.when(F.col("page_id").isNull(), F.col("url")).alias("url"))
    again = again.join(groups, F.col("sha1_hex") == F.col("same")).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
    shard, n = _shards(pages, shard_bytes, ranges)
    # What a page revisits goes ahead of it through the same shuffle, which is the only one of the payloads.
    marks = again.select(shard.alias("shard"), "page_id", "sha1_hex", F.lit(False).alias("is_page"), "url", F.lit(None).cast("string").alias("html"), "first_id")
    whole = pages.select(shard.alias("shard"), "page_id", "sha1_hex", F.lit(True).alias("is_page"), "url", "html", F.lit(None).cast("long").alias("first_id"))
    dealt = whole.unionByName(marks).repartitionById(n, F.col("shard"))
    files = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha1_hex", "is_page", "url").mapInArrow(_writer(folder, least, roll, date), _MANIFEST)
    files.write.parquet(f"{folder}/_staged_manifest")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for staged, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    system.move(f"{path}/{staged}", f"{path}/{name}")
            yield batch

    spark.read.parquet(f"{folder}/_staged_manifest").mapInArrow(move, _MANIFEST).drop("staged").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an opened, unpacked archive."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">").split(".")[0]
    return int(name) if name else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in the manifest: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Digests are checked: a record whose block or payload does not match fails the job.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        system, path = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse(stream):
                        if headers["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).hexdigest())}":
                            raise ValueError(f"block of {headers['warc-record-id']} does not match its digest")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                        if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest):
                            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                        rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, _page(headers.get("warc-refers-to")), payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.parquet(f"{folder}/manifest")
    # a file may be as large as a task's work, so they are dealt one by one; a row per file
    dealt = files.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("place"))
    return dealt.repartitionById(max(1, files.count()), F.col("place")).select("name").mapInArrow(
        records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
