"""WARC records in ZIP-packaged archives, written and read in place.

Each task writes its pages to ZIP packages in the shared folder: a stored member ``archive/data.warc.gz``
(every record its own gzip member) and a stored member ``indexes/index.cdx`` (a line of JSON for each
record: page, offset, length; all lines have the same width, so any record's line is found by arithmetic). The reader
never unpacks a package: it finds the end-of-central-directory record, the ZIP64 one if there is one, walks the central
directory (ZIP64 extras included), skips the local header of a stored member, reads the lines of the index that it needs, and
then reads each record by its range.

Records of equal payloads of at least REVISIT_BYTES bytes: that with the smallest page_id is the response,
the others are revisits of it and carry the digest and the length, but no payload.

No html is shuffled. A first pass leaves page, url, digest and length of each page; of these the revisits are found by digest (counted
by partial sums first; a hot digest's rows are dealt to all tasks). A second pass over the pages writes every response: a bitmap
of fixed size tells what may be a revisit, a second one which responses the first names by chance. Only rows that both
name are sent to be compared with the list of revisits; from that list the revisits themselves are written.

A package is written under a name of the attempt and renamed when it is whole, so a repeated task leaves no
half package; which packages count is what the tasks that succeeded returned.

The shared folder may be local to all, or in any file system that pyarrow opens (s3a: and s3n: are read as s3:).

Defined results: null html is an empty payload; null and long urls are kept (line ends are percent-encoded);
null page_ids come last and read back as null; rows that repeat a page_id and a payload are each the same kind
of record; an empty table gives no package and no row; other columns are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, bitmap, discard, has_bit, meet_hot, new_path, position_of, stash, table

#: Payloads of fewer bytes are always responses.
REVISIT_BYTES = 100
#: A package is closed when its records hold so many bytes.
PACKAGE_BYTES = 16 << 20
#: Pages that a worker gets at a time.
BATCH = 128
#: Records of a package that one row of the reader's work list covers, and that one task reads at most, about.
RECORDS_A_READ, RECORDS_A_TASK = 512, 1 << 14
#: Bytes of payloads that a reader holds before it hands them on.
HELD_BYTES = 4 << 20
#: Bytes of a line of the index.
LINE = 104

_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed values of the ZIP format: signatures and layouts.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_LOCAL_FIELDS, _CENTRAL_FIELDS, _END_FIELDS = "<IHHHHHIIIHH", "<IHHHHHHIIIHHHHHII", "<IHHHHIIH"
_END64_FIELDS, _LOCATOR_FIELDS = "<IQHHIIQQQQ", "<IIQI"
_NONE32, _NONE16 = 0xFFFFFFFF, 0xFFFF


class Source:
    """Ranges of a file in any file system that pyarrow or the local system opens."""

    def __init__(self, path: str):
        fs, inner = _filesystem(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} is outside the file of {self.size} bytes")
        return self.file.read_at(length, start)

    def close(self) -> None:
        self.file.close()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("s3:" + path[4:] if path.startswith(("s3a:", "s3n:")) else path)


def package(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """A ZIP file of stored members; zip64 uses the 64-bit fields even where the 32-bit ones would do."""
    at, central = 0, b""
    for name, parts in members:
        raw = name.encode()
        size, crc = sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        wide = zip64 or size >= _NONE32 or at >= _NONE32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = _NONE32 if wide else size
        header = struct.pack(_LOCAL_FIELDS, _LOCAL, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central += struct.pack(_CENTRAL_FIELDS, _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, _NONE32 if wide else at) + raw + extra
        yield header
        yield from parts
        at += len(header) + size
    yield central
    n = len(members)
    wide = zip64 or at + len(central) >= _NONE32 or n >= _NONE16
    if wide:
        yield struct.pack(_END64_FIELDS, _END64, 44, 45, 45, 0, 0, n, n, len(central), at)
        yield struct.pack(_LOCATOR_FIELDS, _LOCATOR, 0, at + len(central), 1)
    yield struct.pack(_END_FIELDS, _END, 0, 0, _NONE16 if wide else n, _NONE16 if wide else n, _NONE32 if wide else len(central), _NONE32 if wide else at, 0)


def members(source: Source) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, length) of each stored member, from the directories at the end of the file."""
    tail_at = max(0, source.size - 22 - _NONE16)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(struct.pack("<I", _END))
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(struct.pack("<I", _END), 0, end)
    if end < 0:
        raise ValueError("no end-of-central-directory record")
    _, _, _, _, count, size, start, _ = struct.unpack_from(_END_FIELDS, tail, end)
    if count == _NONE16 or size == _NONE32 or start == _NONE32:
        signature, _, place, _ = struct.unpack(_LOCATOR_FIELDS, source.read(tail_at + end - 20, 20))
        if signature != _LOCATOR:
            raise ValueError("no ZIP64 locator before the end record")
        signature, _, _, _, _, _, _, count, size, start = struct.unpack(_END64_FIELDS, source.read(place, 56))
        if signature != _END64:
            raise ValueError("no ZIP64 end record where the locator points")
    directory, at, out = source.read(start, size), 0, {}
    for _ in range(count):
        f = struct.unpack_from(_CENTRAL_FIELDS, directory, at)
        if f[0] != _CENTRAL:
            raise ValueError("a central directory entry has another signature")
        method, packed, plain, n_name, n_extra, n_comment, local = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[at + 46 : at + 46 + n_name].decode()
        packed, plain, local = _wide(directory[at + 46 + n_name : at + 46 + n_name + n_extra], plain, packed, local)
        at += 46 + n_name + n_extra + n_comment
        if method == 0:
            head = struct.unpack(_LOCAL_FIELDS, source.read(local, 30))
            if head[0] != _LOCAL:
                raise ValueError("a local header has another signature")
            out[name] = (local + 30 + head[9] + head[10], packed)
    return out


def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int, int]:
    """The 64-bit extra holds, in this order, those of the three values that the short fields leave out."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            if plain == _NONE32:
                plain, place = struct.unpack_from("<Q", extra, place)[0], place + 8
            if packed == _NONE32:
                packed, place = struct.unpack_from("<Q", extra, place)[0], place + 8
            if local == _NONE32:
                local = struct.unpack_from("<Q", extra, place)[0]
        at += 4 + size
    return packed, plain, local


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record, as a gzip member; length is that of the whole payload, which a revisit leaves out."""
    name = lambda p: f"<urn:page:{'' if p is None else p}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    lines.append(f"Content-Length: {len(body)}")
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(whole, 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length is not the one that its header says")
    return headers, rest[:n]


def _write(folder: str, parts: list[bytes], index: list[bytes]) -> tuple[str, int]:
    fs, inner = _filesystem(folder)
    fs.create_dir(inner, recursive=True)
    name = f"{uuid.uuid4().hex}.wacz"
    with fs.open_output_stream(f"{inner}/.{name}") as f:
        for p in package([(_DATA, parts), (_INDEX, index)]):
            f.write(p)
    fs.move(f"{inner}/.{name}", f"{inner}/{name}")
    return f"{folder}/{name}", len(index)


def _line(page_id: int | None, offset: int, length: int) -> bytes:
    return json.dumps({"page": page_id, "offset": offset, "length": length}).ljust(LINE - 1).encode() + b"\n"


class Packages:
    """A task's records, gathered to packages; what is closed is in done."""

    def __init__(self, folder: str):
        self.folder, self.parts, self.index, self.held, self.done = folder, [], [], 0, []

    def add(self, page_id: int | None, one: bytes) -> None:
        self.index.append(_line(page_id, self.held, len(one)))
        self.parts.append(one)
        self.held += len(one)
        if self.held >= PACKAGE_BYTES:
            self.close()

    def close(self) -> None:
        if self.index:
            self.done.append(_write(self.folder, self.parts, self.index))
        self.parts, self.index, self.held = [], [], 0


_PACKAGE = "package string, n_records long"
_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.string())])


def _package_rows(done: list[tuple[str, int]]) -> list[pa.Array]:
    return [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())]


def write_responses(own: DataFrame, folder: str, revisits: bytes, chance: bytes) -> DataFrame:
    """package, n_records of the responses that are sure; the other pages (page_id, url, html, digest) have no package.

    own: page_id, url, html, digest, at, at2 (places in the two bitmaps)."""
    shared = own.sparkSession.sparkContext.broadcast([np.frombuffer(b, np.uint8) for b in (revisits, chance)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, maps = Packages(folder), shared.value
        for batch in batches:
            may, other = (has_bit(bits, batch.column(4 + k).to_numpy(zero_copy_only=False)) for k, bits in enumerate(maps))
            open_rows = []
            for k in range(batch.num_rows):
                page_id, url, html, digest = (batch.column(c)[k].as_py() for c in range(4))
                payload = html.encode()
                if not may[k] or len(payload) < REVISIT_BYTES:
                    out.add(page_id, record(page_id, url, payload, digest, len(payload), None, False))
                elif other[k]:
                    open_rows.append(k)
            if open_rows:
                left = batch.take(pa.array(open_rows))
                none = [None] * len(open_rows)
                yield pa.RecordBatch.from_arrays([pa.array(none, pa.string()), pa.array(none, pa.int64()), *left.columns[:4]], ["package", "n_records", *_ROW.names])
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([*_package_rows(out.done), *(pa.nulls(len(out.done), t) for t in _ROW.types)], ["package", "n_records", *_ROW.names])

    return own.mapInArrow(write, f"{_PACKAGE}, page_id long, url string, html string, digest string")


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """package, n_records: what each task wrote of records (page_id, url, html, digest, n, refers_to, revisit)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packages(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, digest, n, refers_to, revisit = (c[k].as_py() for c in batch.columns)
                out.add(page_id, record(page_id, url, (html or "").encode(), digest, n, refers_to, revisit))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays(_package_rows(out.done), ["package", "n_records"])

    return records.select("page_id", "url", "html", "digest", "n", "refers_to", "revisit").mapInArrow(write, _PACKAGE)


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (payload, if wanted) of every record of packages (package, n_records), by range reads."""
    jobs = packages.select("package", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_records") - 1, F.lit(0)), F.lit(RECORDS_A_READ).cast("long"))).alias("first"))
    total = packages.agg(F.sum("n_records"), F.sum(F.ceil(F.col("n_records") / RECORDS_A_READ))).first()
    # As many tasks as the records need, or as the cluster has cores for: job rows are tiny, so their bytes say nothing of the work.
    tasks = max(1, -(-(total[0] or 0) // RECORDS_A_TASK), min(int(total[1] or 0), packages.sparkSession.sparkContext.defaultParallelism))
    jobs = jobs.repartition(tasks, "package", "first")
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]

    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def rows_of(path: str, first: int) -> Iterator[tuple]:
        source = Source(path)
        found = members(source)
        start, size = found[_INDEX]
        if size % LINE:
            raise ValueError(f"{path}: the index has lines of another width")
        lines = source.read(start + first * LINE, min(RECORDS_A_READ * LINE, size - first * LINE)).splitlines()
        data, _ = found[_DATA]
        for entry in map(json.loads, lines):
            headers, block = parse_record(source.read(data + entry["offset"], entry["length"]))
            kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
            n = int(headers["X-Payload-Length"])
            if kind == "response" and (len(block) != n or hashlib.sha256(block).hexdigest() != digest):
                raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} is not the one that was written")
            url = headers.get("WARC-Target-URI")
            url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
            yield number(headers["WARC-Record-ID"]), url, n, digest, kind, number(headers.get("WARC-Refers-To")), *([block] if payloads else [])
        source.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for row in rows_of(path, first):
                    rows.append(row)
                    held += len(row[6]) if payloads else 0
                    if held >= HELD_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return jobs.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def revisits_of(keys: DataFrame) -> DataFrame:
    """page_id, url, digest, n, refers_to of the pages (page_id, url, digest, n) that repeat the payload of one with a smaller page_id."""
    long = keys.where(F.col("n") >= REVISIT_BYTES)
    total = keys.count()
    first = long.groupBy(F.col("digest").alias("_key")).agg(F.min("page_id").alias("_value"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _value is not null")
    met = meet_hot(long, F.col("digest"), F.xxhash64("page_id"), stash(first, "repeated"), total)
    return met.where(F.col("_value").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_value"))).select("page_id", "url", "digest", "n", F.col("_value").alias("refers_to"))


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to packages in the shared folder; package, n_records of those that count."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    with batches_of(spark, BATCH):
        own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
        own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
        keys = stash(own.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("n")), "pages")
        revisits = stash(revisits_of(keys), "revisits")
        at, at2 = position_of(F.col("page_id"), F.col("digest")), position_of(F.col("digest"), F.col("page_id"))
        bits = bitmap(revisits, at)

        @F.arrow_udf("boolean")
        def named(position: pa.Array) -> pa.Array:
            return pa.array(has_bit(np.frombuffer(bits, np.uint8), position.to_numpy(zero_copy_only=False)))

        both = lambda df: df.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"))
        same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d"))
        # Responses that the first bitmap names by chance.
        chance = keys.where((F.col("n") >= REVISIT_BYTES) & named(at)).join(both(revisits), same, "left_anti")
        written = stash(write_responses(own.withColumns({"at": at, "at2": at2}), folder, bits, bitmap(chance, at2)), "responses")
        left = written.where("package is null").select("page_id", "url", "html", "digest").join(both(revisits), same, "left_anti")
        left = left.select("*", F.octet_length("html").cast("long").alias("n"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
        repeated = revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "n", "refers_to", F.lit(True).alias("revisit"))
        others = write_packages(left.unionByName(repeated), folder)
        out = stash(written.where("package is not null").select("package", "n_records").unionByName(others), "packages")
    discard(keys, revisits, written)
    return out


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    return read_packages(archive(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
