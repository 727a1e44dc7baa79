"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is Spark's text writer with the records' end as its line separator. Reading takes every place
in an archive where a record could begin (the magic may also stand inside a payload), parses it and
emits (offset, offset of its successor). The candidates of a file meet in one task, where the successors
are followed from offset 0 by pointer jumping: in round k the pointers span 2^k records and the reached set
doubles. Candidates that no chain from the file's start reaches are payload text and are dropped.

Files are bounded by bytes: records are written by class of size, and a class's files hold as many records
as fit if all are as large as the class allows. Only a record that is larger than a file should be has one of its own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, ready, remove

MAGIC = b"WARC/1."
END = "\r\n\r\n"
#: Payloads below this many bytes are always stored, never revisits.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records that one archive file holds, and the classes of record size (their largest; the last has no bound).
FILE_BYTES = 64 << 20
CLASSES = (16 << 10, 256 << 10, 4 << 20)


def _plain(value: Column) -> Column:
    """A header value: no control characters."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """One string ``record`` per page. Of equal payloads of ``least`` bytes, all but the smallest id's are revisits.

    Only ids and digests are grouped; the table of repeated digests is written first, so that Spark joins
    by its measured size and pages are shuffled only if that table is large.
    """
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    page = page.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    repeated = page.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    page = page.join(materialize(repeated, "warc-repeated"), "digest", "left")
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("id") != F.col("first"), F.lit(True))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), _plain(F.col("id")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), _plain(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), _plain(F.col("first")), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body), F.lit(END),
    )
    return page.select(F.concat(head, body).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "gzip") -> str:
    """Write the pages as archive files in folders under ``path``; ``compression`` is gzip or none."""
    own = records(pages, id_col, url_col, payload_col)
    size = F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) + F.octet_length(F.coalesce(F.col(url_col), F.lit("")))
    largest = pages.agg(F.coalesce(F.max(size), F.lit(0))).first()[0] + 4096  # a header's fixed parts have under 1 KB
    low = 0
    for i, most in enumerate([*CLASSES, None]):
        bytes_ = F.octet_length("record")
        some = own.where((bytes_ >= low) & (bytes_ < most) if most else bytes_ >= low)
        many = max(1, FILE_BYTES // most) if most else 1
        if i == 0 or largest >= low:
            some.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", many).text(f"{path}/size={i}")
        low = most
    return path


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)


def _candidate(data: bytes, at: int) -> tuple[int | None, dict[bytes, bytes], int, int]:
    """(successor offset or None, header fields, block start, block end) of a possible record."""
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None, {}, at, at
    fields = {k.lower(): v for k, v in _FIELD.findall(data[at:head_end].replace(b"\r\n", b"\n"))}
    if not fields.get(b"content-length", b"").isdigit() or b"warc-type" not in fields:
        return None, fields, at, at
    begin = head_end + 4
    end = begin + int(fields[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, fields, at, at
    return end + 4, fields, begin, end


def _inflated(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def _urn(value: bytes | None) -> str | None:
    found = re.fullmatch(rb"<urn:page:(.+)>", value or b"")
    return found[1].decode() if found else None


_EDGES = "file string, at long, next long, type string, id string, refers string, size long, digest string"


def candidates(archives: DataFrame) -> DataFrame:
    """Every possible record of ``archives(path, content)``: its offset, its successor's and what it holds."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _inflated(batch.column(1)[i].as_py())
                rows = []
                at = data.find(MAGIC)
                while at >= 0:
                    after, fields, begin, end = _candidate(data, at)
                    kind = fields.get(b"warc-type", b"").decode("latin-1")
                    split = data.find(b"\r\n\r\n", begin, end)
                    payload = memoryview(data)[split + 4 : end] if after is not None and split >= 0 else b""
                    digest = hashlib.sha256(payload).hexdigest() if kind != "revisit" else fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
                    rows.append((at, after, kind, _urn(fields.get(b"warc-record-id")), _urn(fields.get(b"warc-refers-to")), len(payload), digest))
                    at = data.find(MAGIC, at + 1)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                name = pa.array([batch.column(0)[i].as_py()] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([name, *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in _EDGES.split(", ")])

    return archives.select("path", "content").mapInArrow(kernel, _EDGES)


def on_chain(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches; ``at`` ascends, ``after`` is -1 where nothing follows.

    Pointers are places in ``at``; one more place, which points to itself, stands for the end.
    """
    n = len(at)
    place = np.minimum(np.searchsorted(at, after), n - 1)
    pointer = np.append(np.where((after > at) & (at[place] == after), place, n), n)
    reached = np.zeros(n + 1, bool)
    reached[:-1] = at == 0
    while True:
        more = reached.copy()
        more[pointer[reached]] = True
        if (more[:-1] == reached[:-1]).all():
            return reached[:-1]
        reached, pointer = more, pointer[pointer]


def reachable(edges: DataFrame) -> DataFrame:
    """The rows of ``edges(file, at, next, ...)`` on the chain from each file's offset 0, a file's rows in one task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def kept() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            at = table.column("at").to_numpy()
            after = table.column("next").fill_null(-1).to_numpy()
            return table.filter(pa.array(on_chain(at, after))).combine_chunks()

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("file")
            starts = [0, *(i for i in range(1, batch.num_rows) if names[i] != names[i - 1]), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if held and held[-1].column("file")[0] != names[a]:
                    yield from kept().to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from kept().to_batches()

    return edges.repartition("file").sortWithinPartitions("file", "at").mapInArrow(kernel, edges.schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: ``id, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit's length is that of the response with its digest which it refers to. Files are read whole
    by a task each, so an archive file must fit a task's memory; the writer bounds its files' bytes.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    found = materialize(reachable(candidates(archives.select("path", "content"))), "warc-records")
    responses = found.where("type = 'response'").select(F.col("id").alias("refers"), "digest", F.col("size").alias("full")).distinct()
    revisits = found.where("type = 'revisit'").join(responses, ["refers", "digest"], "left")
    plain = found.where("type = 'response'").select("id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    return plain.unionByName(revisits.select("id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to")))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages as archives in the shared folder and read them back, a row per page.

    ``id, payload_bytes, payload_digest, record_type, refers_to``. Null payloads count as empty. Rows that
    repeat an id and a payload are all responses if theirs is the smallest id. Pages with a null id are
    revisits of an equal payload that has an id. Null urls become empty. Very long payloads have a file of
    their own. Extra columns, whatever their names, are ignored. Empty in, empty out. The archives are deleted
    when they have been read.
    """
    ready(pages)
    kind = pages.schema[id_col].dataType
    path = write_archives(pages, new_path(pages.sparkSession, "warc"), id_col, url_col, payload_col)
    found = read_archives(pages.sparkSession, path)  # its records are written to the shared folder already
    remove(pages.sparkSession, path)
    return found.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
