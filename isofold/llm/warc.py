"""Zstandard WARC archives: one frame a record, compressed with a dictionary that the archive itself carries.

An archive begins with a skippable frame (magic 0x184D2A5D) whose content is the dictionary, plain or as a Zstandard
frame. Each record is a frame of its own: header lines, a blank line, the block, two line ends. The
reader takes the dictionary from the leading frame, decodes frame by frame, and validates what it decodes: version, header lines,
required fields, length, digests. Archives are written to and read from any file system that Arrow and Spark reach.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

DICTIONARY_MAGIC = 0x184D2A5D
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_FRAME = 0xFD2FB528
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed beyond this many bytes of payload.
ARCHIVE_BYTES = 32_000_000
DICTIONARY_BYTES = 64 << 10
#: Payload that a dictionary is trained on, from the head of its archive.
TRAIN_BYTES = 2_000_000
LEVEL = 3
#: What a reader asks a stream for at a time.
CHUNK_BYTES = 1 << 20


class WarcError(ValueError):
    """An archive that breaks the format."""


@dataclass
class Record:
    version: str
    headers: dict[str, str]
    block: bytes
    offset: int = 0
    problems: list[str] = field(default_factory=list)

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")


def digest(payload: bytes) -> str:
    """SHA-1 in base32, upper case, as WARC digests have it (without its label)."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing
def trained(samples: list[bytes]) -> bytes:
    """A dictionary from the samples; empty where they are too few or too small to train on."""
    if len(samples) < 8 or sum(map(len, samples)) < 16_384:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(content: bytes, compress: bool = True) -> bytes:
    if compress:
        content = zstandard.ZstdCompressor(level=LEVEL).compress(content)
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def serialized(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Writer:
    """Writes records to one archive. The dictionary, if any, leads it."""

    def __init__(self, out, dictionary: bytes = b"", level: int = LEVEL):
        self.out = out
        if dictionary:
            out.write(dictionary_frame(dictionary))
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)

    def add(self, headers: list[tuple[str, str]], block: bytes) -> None:
        self.out.write(self.packer.compress(serialized(headers, block)))


# ---------------------------------------------------------------- reading
class _Source:
    """A stream read in chunks: what was taken is let go of, so that one frame is held at a time."""

    def __init__(self, stream, chunk: int = CHUNK_BYTES):
        self.stream, self.chunk, self.held, self.at, self.offset = stream, chunk, bytearray(), 0, 0

    def has(self, n: int) -> bool:
        """Whether n more bytes are there; they are then held."""
        while len(self.held) - self.at < n:
            more = self.stream.read(max(self.chunk, n - len(self.held) + self.at))
            if not more:
                return False
            if self.at:
                del self.held[: self.at]
                self.at = 0
            self.held += more
        return True

    def look(self, start: int, size: int) -> bytes:
        return bytes(self.held[self.at + start : self.at + start + size])

    def take(self, n: int) -> bytes:
        out = self.look(0, n)
        self.at += n
        self.offset += n
        return out


def _frame_size(source: _Source) -> int:
    """The size of the Zstandard frame that comes next, from its block headers."""
    source.has(18)
    try:
        at = zstandard.frame_header_size(source.look(0, 18))
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame at {source.offset}: {e}") from e
    checksum = source.look(4, 1)[0] >> 2 & 1
    while True:
        if not source.has(at + 3):
            raise WarcError("a frame is cut off")
        head = int.from_bytes(source.look(at, 3), "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if not source.has(at):
        raise WarcError("a frame is cut off")
    return at


def read_frames(data) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame of an archive, bytes or a stream; the leading skippable frame gives the dictionary."""
    source = _Source(io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data)
    unpack = zstandard.ZstdDecompressor()
    while source.has(1):
        at = source.offset
        if not source.has(8):
            raise WarcError(f"stray bytes at {at}")
        magic, size = struct.unpack("<II", source.look(0, 8))
        if magic in _SKIPPABLE:
            if not source.has(8 + size):
                raise WarcError("the skippable frame is cut off")
            content = source.take(8 + size)[8:]
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise WarcError(f"a dictionary at {at}; only the leading frame may hold it")
                try:
                    if content[:4] == struct.pack("<I", _FRAME):
                        packed = zstandard.ZstdDecompressor().decompressobj()
                        content = packed.decompress(content)
                        if not packed.eof:
                            raise WarcError("the dictionary is cut off")
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                except zstandard.ZstdError as e:
                    raise WarcError(f"the dictionary can't be decoded: {e}") from e
            continue
        if magic != _FRAME:
            raise WarcError(f"no frame at {at}")
        frame = source.take(_frame_size(source))
        try:
            content = unpack.decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at {at} can't be decoded: {e}") from e
        yield at, content


def parsed(content: bytes, offset: int = 0) -> Record:
    """The record of a frame, validated."""
    head, blank, rest = content.partition(b"\r\n\r\n")
    if not blank:
        raise WarcError(f"the record at {offset} has no end of headers")
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        raise WarcError(f"the record at {offset} has headers that aren't UTF-8: {e}") from e
    version, *lines = head.split(b"\r\n")
    if version not in VERSIONS:
        raise WarcError(f"the record at {offset} begins with {version[:20]!r}")
    headers: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in b" \t" and last:
            headers[last] += " " + line.decode("utf-8").strip()
            continue
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"the record at {offset} has the header line {line[:40]!r}")
        last = name.lower()
        if last in headers and last != "warc-concurrent-to":
            raise WarcError(f"the record at {offset} repeats {name}")
        headers[last] = value.strip()
    if lacking := [k for k in REQUIRED if k not in headers]:
        raise WarcError(f"the record at {offset} lacks {', '.join(lacking)}")
    if not headers["content-length"].isdecimal():
        raise WarcError(f"the record at {offset} has the length {headers['content-length']!r}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"the record at {offset} says {size} bytes and has {len(rest) - 4}")
    if headers["warc-type"] not in TYPES:
        raise WarcError(f"the record at {offset} has the type {headers['warc-type']!r}")
    block = rest[:size]
    label, _, value = headers.get("warc-block-digest", "").partition(":")
    if label.lower() == "sha1" and value != digest(block):
        raise WarcError(f"the record at {offset} has another block digest than its header")
    return Record(version.decode(), headers, block, offset)


def read_archive(data) -> Iterator[Record]:
    """The records of an archive, bytes or a stream."""
    for offset, content in read_frames(data):
        yield parsed(content, offset)


def payload_of(record: Record) -> bytes:
    """The payload: of an HTTP response what follows its headers, else the block."""
    if record.headers.get("content-type", "").startswith("application/http"):
        return record.block.partition(b"\r\n\r\n")[2]
    return record.block


# ---------------------------------------------------------------- Spark
def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, bytes, refers_to) for pages (page_id, html): refers_to is the response that a revisit repeats, else null.

    Of equal payloads of at least `least_bytes` the smallest page_id is the response, to which rows without an id refer as well; where none has an id all are responses. Minima are combined before the
    shuffle, so that a payload that most pages share costs a row a task.
    """

    def measure(batches):
        for batch in batches:
            payloads = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64())], ["page_id", "digest", "bytes"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(measure, "page_id long, digest string, bytes long")
    first = own.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    out = own.join(first, (own["digest"] == first["d"]) & (own["bytes"] == first["b"]), "left")
    return out.select("page_id", "digest", "bytes", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")).alias("refers_to"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexadecimal: Column) -> Column:
    """Base32 of a digest in hexadecimal: 5 digits are 20 bits are 4 letters."""
    parts = [F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*(F.substring(F.lit(_ALPHABET), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1)) for v in parts for shift in (15, 10, 5, 0)))


def record_id(page_id: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html, refers_to) and returns (path, records) of the archives.

    Every attempt of a task writes under names of its own: the archives are those that the result lists, and what a lost attempt left is none
    of them. Call an action on the result once. A dictionary is trained on the first TRAIN_BYTES of an archive's blocks, of each its first
    128 KiB; it changes sizes, not contents. A revisit has no block; its payload's digest and the response's id are in its headers.
    """

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        waiting: list[tuple[list[tuple[str, str]], bytes]] = []
        size, turn = 0, 0

        def close():
            nonlocal waiting, size, turn
            out = io.BytesIO()
            samples, used = [], 0
            for _, block in waiting:
                if used < TRAIN_BYTES and block:
                    samples.append(block[:131072])
                    used += len(samples[-1])
            writer = Writer(out, trained(samples))
            for headers, block in waiting:
                writer.add(headers, block)
            name = f"part-{task:06d}-{turn:04d}-{attempt}.warc.zst"
            with system.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(out.getvalue())
            made = (f"{folder.rstrip('/')}/{name}", len(waiting))
            waiting, size, turn = [], 0, turn + 1
            return pa.RecordBatch.from_arrays([pa.array([made[0]]), pa.array([made[1]], pa.int64())], ["path", "records"])

        for batch in batches:
            for row, (page, url, html, refers) in enumerate(zip(*(batch.column(i) for i in range(4)))):
                page, payload, refers = page.as_py(), (html.as_py() or "").encode(), refers.as_py()
                own = record_id(page) if page is not None else record_id(f"{attempt} {turn} {len(waiting)} {row}")
                headers = [
                    ("WARC-Type", "response" if refers is None else "revisit"),
                    ("WARC-Record-ID", own),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", "".join((url.as_py() or "urn:none").split())),
                    ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
                ] + ([("X-Page-ID", str(page))] if page is not None else [])
                if refers is None:
                    headers += [("WARC-Block-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "text/html; charset=utf-8")]
                else:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers)), ("X-Refers-To-Page-ID", str(refers))]
                waiting.append((headers, payload if refers is None else b""))
                size += len(payload) if refers is None else 1000
                if size >= archive_bytes:
                    yield close()
        if waiting:
            yield close()

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), "refers_to").mapInArrow(write, "path string, records long")


def read_archives(spark: SparkSession, folder: str, what: str = "*.warc.zst", paths: DataFrame | None = None) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload binary, record_id, target_uri, date) of the records of all archives in a folder, or of `paths` (path).

    Archives of any origin: page_id and refers_to are those that `write_archives` puts into headers of its own, null in other
    archives, whose records are named by record_id and target_uri. Records of all types are rows. Archives are streamed, a frame at a time, one task for each;
    where only Spark can open the store, they are read whole. A record that breaks the format fails the read. A revisit has the digest that its header
    gives and a null payload; a digest that isn't SHA-1 is returned as it stands, with its label.
    """

    def rows(stream):
        out: list[tuple] = []
        size = 0
        for r in read_archive(stream):
            label, _, value = r.headers.get("warc-payload-digest", "").partition(":")
            payload = None if r.type == "revisit" else payload_of(r)
            if label.lower() != "sha1":
                value = r.headers.get("warc-payload-digest") or (digest(payload) if payload is not None else None)
            elif payload is not None and "warc-segment-number" not in r.headers and "warc-truncated" not in r.headers and digest(payload) != value.upper():
                raise WarcError(f"the record at {r.offset} has another payload digest than its header")
            own = [r.headers.get(k, "") for k in ("x-page-id", "x-refers-to-page-id")]
            page, refers = (int(x) if x.removeprefix("-").isdecimal() else None for x in own)
            out.append((page, r.type, refers, value, payload, r.headers["warc-record-id"], r.headers.get("warc-target-uri"), r.headers["warc-date"]))
            size += len(payload or b"") + 500
            if size > 8_000_000:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    def read_whole(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from rows(content.as_py())

    def read_streams(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at, compression=None) as f:
                    yield from rows(f)

    if paths is None:
        archives = spark.read.format("binaryFile").option("pathGlobFilter", what).load(folder)
        if not _opens(folder):
            return archives.select("content").mapInArrow(read_whole, _SCHEMA)
        # file:/x is how Hadoop writes file:///x
        paths = archives.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return paths.select("path").mapInArrow(read_streams, _SCHEMA)


def _opens(folder: str) -> bool:
    """Whether Arrow knows the folder's kind of store; the file itself isn't touched."""
    return folder.partition("://")[0] in ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


_SCHEMA = "page_id long, record_type string, refers_to long, payload_digest string, payload binary, record_id string, target_uri string, date string"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["page_id", "record_type", "refers_to", "payload_digest", "payload", "record_id", "target_uri", "date"])


#: Up to so many revisits are broadcast when pages are marked: 80 bytes each.
BROADCAST_ROWS = 300_000


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of pages (page_id, url, html).

    A null html is an empty payload. Rows that repeat a page_id are records each, all of one type and reference as their payloads say;
    rows with a null page_id are records with an id of their own, read back with a null one. An empty table makes no archive and gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    kinds = classified(own, least_bytes)
    # only revisits are looked up, by id and payload, as an id may come again with another
    revisits = written(kinds.where("refers_to is not null").select(F.col("page_id").alias("of_page"), "refers_to", F.col("digest").alias("of_digest")).distinct(), "revisits")
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = own.withColumn("own_digest", _base32(F.sha1(F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8"))))
    marked = marked.join(F.broadcast(revisits) if few else revisits, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("own_digest") == F.col("of_digest")), "left")
    made = written(write_archives(marked, folder), "archives")
    read = read_archives(spark, folder, paths=made.repartition(max(1, made.count()), "path"))
    own = written(read.select("page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to"), "records")
    responses = own.where("record_type = 'response'").groupBy(F.col("page_id").alias("response"), F.col("payload_digest").alias("full_digest")).agg(F.max("n").alias("full"))
    out = own.join(responses, (F.col("refers_to") == F.col("response")) & (F.col("payload_digest") == F.col("full_digest")), "left")
    return out.select("page_id", F.coalesce("n", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, CAST(octet_length(x) AS BIGINT) AS payload_bytes, sha1(x) AS h FROM p),
e AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('{_ALPHABET}', CAST((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS response FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN response = page_id OR response IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to FROM f
"""
