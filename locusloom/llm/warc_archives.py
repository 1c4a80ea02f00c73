"""WARC archives: written as whole-file gzip, normalised to one gzip member per record, and read back by offset.

``write_archives`` makes a record of each page and lets Spark's text writer store them, with the end of a WARC record as the line
separator and gzip as the compression: each file is a valid archive, but one gzip stream, so nothing in it can be reached alone. ``normalise``
inflates each such file once, record by record, writes every record as a member of its own, and walks the members of what it wrote for a sidecar
index of offsets. ``read_archives`` takes the members out by that index and checks their digests. Files go through Spark's readers and writers only, so a store that tasks cannot open,
repeated tasks and lost executors are Spark's matter, and the driver sees no record.

Spark's writer puts a separator behind each row; in normalised archives that is an empty gzip member, which holds no record.

Of pages with equal payloads (at least ``min_bytes`` long) the one with the largest id is a response, the others revisit it. Payloads
are compared by SHA-256. Payloads that very many pages share are joined where pages are read (at most ``HOT`` of them, as each has
more than that share of all rows); all others too where there are at most ``FEW``, else by a shuffle in which each payload has few rows.

Defined results: a null html is an empty payload; a null page id revisits the largest id of its payload, and is a response where none has one;
pages that tie on the largest id of a payload are responses each; repeated rows have a record each; a null url has no target header, and
white space, controls and other characters outside ASCII are percent-encoded in it; an empty table gives empty archives; only the named columns are read;
one record is held at a time in the normaliser, ``RECORDS`` of an archive when reading.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import cut, remove, shared_folder
from .words import in_small_batches

#: Payloads joined without a shuffle at most; records of an archive; bytes inflated at once.
HOT, RECORDS, CHUNK = 1000, 1024, 1 << 18

#: Repeated payloads up to which, once counted, all of them are joined where pages are read (some 60 bytes each).
FEW = 200_000

#: The end of a WARC record, the profile of revisits, and a gzip member that holds nothing.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08 00 00000000 00 03 0300 00000000 00000000")

#: Records written without a date of their own.
DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A record without its closing blank lines. A revisit keeps the HTTP header, which states the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END.encode() + block


def fields(head: bytes) -> dict[str, str]:
    """Header fields of a record or of HTTP, by lower-case name; the first line is left out."""
    lines = head.decode().split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def inflated(content: bytes) -> Iterator[bytes]:
    """A gzip file's bytes in pieces, over all its members."""
    data, at = memoryview(content), 0
    while at < len(data):
        tool = zlib.decompressobj(wbits=31)
        while not tool.eof:
            if at >= len(data) and not tool.unconsumed_tail:
                raise ValueError("the archive ends inside a gzip member")
            piece = tool.unconsumed_tail or data[at : at + CHUNK]
            at += 0 if tool.unconsumed_tail else len(piece)
            yield tool.decompress(piece, CHUNK)
        at -= len(tool.unused_data)


def records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each with its closing blank lines, from one pass over its stream."""
    held, pieces, end = bytearray(), inflated(content), END.encode()

    def fill(n: int) -> None:
        while len(held) < n:
            try:
                held.extend(next(pieces))
            except StopIteration:
                raise ValueError("the archive ends inside a record") from None

    while True:
        for piece in pieces:
            held += piece
            if held:
                break
        if not held:
            return
        at = -1
        while (at := held.find(end)) < 0:
            fill(len(held) + 1)
        size = at + 4 + int(fields(bytes(held[:at]))["content-length"]) + 4
        fill(size)
        yield bytes(held[:size])
        del held[:size]


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, revisit``: which page's payload each page repeats, and whether it is to be a revisit."""
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("payload"))
    long_enough = F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes
    groups = cut(rows.where(long_enough).groupBy("payload").agg(F.count("*").alias("n"), F.max("page_id").alias("largest")).where("n > 1"))
    if groups.count() <= FEW:  # no page is shuffled
        found = rows.join(F.broadcast(groups.select("payload", "largest")), "payload", "left")
        return _with_targets(found, F.col("largest"))
    n_hot = max(HOT, pages.count() // HOT)
    hot = groups.where(F.col("n") > n_hot).select("payload", F.col("largest").alias("hot"), F.lit(True).alias("is_hot"))
    rest = groups.where(F.col("n") <= n_hot).select(F.col("payload").alias("key"), "largest")
    marked = rows.join(F.broadcast(hot), "payload", "left")  # at most HOT rows
    # Rows of a hot payload have their answer, and go where a hash of their own sends them.
    alone = F.unhex(F.sha1(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))))
    joined = marked.withColumn("key", F.when(F.col("is_hot"), alone).otherwise(F.col("payload"))).join(rest, "key", "left")
    return _with_targets(joined, F.coalesce("hot", "largest"))


def _with_targets(rows: DataFrame, largest: Column) -> DataFrame:
    revisit = largest.isNotNull() & ~F.col("page_id").eqNullSafe(largest)
    return rows.select("page_id", "url", "html", F.when(revisit, largest).alias("refers_to"), revisit.alias("revisit"))


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` bytes of their last column."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write the pages' records into ``folder`` as archives of one gzip stream each."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                yield (record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), revisit.as_py(), date),)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batched(texts(batches), pa.schema([("value", pa.binary())])):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    rows = in_small_batches(with_roles(pages, min_bytes)).mapInArrow(made, "value string")
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and what is in it for each gzip member of a file that is not empty."""
    data, at = memoryview(content), 0
    while at < len(data):
        tool, begin, text = zlib.decompressobj(wbits=31), at, bytearray()
        while not tool.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a gzip member")
            text += tool.decompress(data[at : at + CHUNK])
            at += CHUNK
        at = min(at, len(data)) - len(tool.unused_data)
        if text:
            yield begin, at - begin, bytes(text)


def normalise(spark: SparkSession, folder: str, target: str) -> None:
    """Rewrite the gzip archives in ``folder`` into ``target/archives``, one member per record, and index them in ``target/index``.

    The index (``path, offset, length, record_id, record_type, digest``) names files without their folder, so that it can move with them.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column("content"):
                for text in records(content.as_py()):
                    tool = zlib.compressobj(wbits=31)
                    yield (tool.compress(text) + tool.flush(),)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for offset, length, text in members(content.as_py()):
                    head = fields(text[: text.index(END.encode())])
                    yield path.as_py().rsplit("/", 1)[1], offset, length, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-payload-digest", "")

    one = pa.schema([("member", pa.binary())])
    rows = spark.read.format("binaryFile").load(folder).select("content").mapInArrow(lambda batches: _batched(split(batches), one), "member binary")
    writer = rows.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("compression", "none").option("maxRecordsPerFile", RECORDS).text(f"{target}/archives")
    index = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("digest", pa.string())])
    found = spark.read.format("binaryFile").load(f"{target}/archives").select("path", "content")
    found.mapInArrow(lambda batches: _batched(indexed(batches), index), "path string, offset bigint, length bigint, record_id string, record_type string, digest string").write.parquet(f"{target}/index")


RECORDS_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def page_of(urn: str | None) -> int | None:
    """The page id in a record's id."""
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_record(text: bytes) -> tuple:
    """``RECORDS_READ`` of one record; a payload that does not match its digest is an error."""
    at = text.index(END.encode())
    head = fields(text[:at])
    block = text[at + 4 : at + 4 + int(head["content-length"])]
    http_at = block.index(END.encode())
    payload, digest = block[http_at + 4 :], head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        return page_of(head["warc-record-id"]), int(fields(block[:http_at])["content-length"]), digest, "revisit", page_of(head["warc-refers-to"])
    if payload_digest(payload) != digest:
        raise ValueError(f"record {head['warc-record-id']} does not match its digest")
    return page_of(head["warc-record-id"]), len(payload), digest, "response", None


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """``RECORDS_READ`` of every record of normalised archives, each inflated alone from where the index says it lies."""
    name = F.element_at(F.split("path", "/"), -1).alias("path")
    files = spark.read.format("binaryFile").load(f"{target}/archives").select(name, "content")
    index = spark.read.parquet(f"{target}/index").select("path", "offset", "length")

    def taken(content: pa.Table, places: pa.Table) -> pa.Table:
        if len(content) != 1:
            raise ValueError(f"of the archive {places['path'][0]} that the index names there are {len(content)}")
        data = memoryview(content["content"][0].as_py())
        found = [read_record(zlib.decompress(data[a : a + n], wbits=31)) for a, n in zip(places["offset"].to_pylist(), places["length"].to_pylist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in RECORDS_READ.split(", ")])

    return files.groupBy("path").cogroup(index.groupBy("path")).applyInArrow(taken, RECORDS_READ)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages, normalise the archives and read them back, in a new folder in that of ``spark.checkpoint.dir``; the streams go once normalised."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{folder}/streams", min_bytes)
    normalise(spark, f"{folder}/streams", f"{folder}/normal")
    remove(spark, f"{folder}/streams")
    return read_archives(spark, f"{folder}/normal")
