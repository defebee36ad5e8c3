"""WARC records in ZIP packages: writing, and reading by ranges.

Every write task makes one package (a Zip64-capable archive) with two stored members:
``archive/data.warc.gz``, one gzip member per record, and ``indexes/index.cdx``, a line with
the offset and length of each record. Reading parses the package directory
(``zip_ranges``), locates the two members, takes the index, and reads spans of records by
byte range; spans of at most ``SPAN_BYTES`` are spread over tasks whatever package they are
in, and nothing is extracted to disk.

Of records with equal payloads of at least ``MIN_SHARED`` bytes the one with the smallest id is
the response and the others are revisits without payload that refer to it.

Defined cases: null html is an empty payload; rows that repeat the id and payload of a
response are responses too; a null id is larger than any other, is written as ``null`` and
read back as null, and is not referred to unless the payload occurs with null ids only, then
all of them are responses; an empty table gives no package and no rows; other columns are
not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensor_yield.llm import zip_ranges
from sensor_yield.llm.common import scratch, task_count
from sensor_yield.llm.files import AtomicWriter, RangeReader

MIN_SHARED = 100
SPAN_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"


def record_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to (null: a response)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    first = (rows.where(F.octet_length("html") >= MIN_SHARED).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_packages(plan: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write the planned records under ``folder`` and return the list of packages:
    path, records, bytes."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, index, at = TaskContext.get(), None, [], 0
        for batch in batches:
            c = batch.to_pydict()
            for page_id, url, html, digest, refers_to in zip(c["page_id"], c["url"], c["html"], c["digest"],
                                                             c["refers_to"], strict=True):
                if out is None:
                    path = f"{folder}/part-{context.partitionId():06d}.wacz"
                    out = AtomicWriter(path, context.taskAttemptId())
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    data = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                packed = gzip.compress(_record(page_id, url, html.encode(), digest, refers_to, date), level, mtime=0)
                data.write(packed)
                index.append(f"{at} {len(packed)}")
                at += len(packed)
        if out is None:
            return
        data.close()
        with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as lines:
            lines.write("\n".join(index).encode())
        package.close()
        out.commit()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)], "bytes": [out.size]})

    spark = plan.sparkSession
    schema = "path string, records bigint, bytes bigint"
    listing = f"{folder}/packages.parquet"
    plan.mapInArrow(write, schema).write.parquet(listing)
    return spark.read.schema(schema).parquet(listing)


def spans(packages: DataFrame) -> DataFrame:
    """path, start, lengths: neighbouring records of a package, up to SPAN_BYTES together."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                reader = RangeReader(path)
                listed = zip_ranges.members(reader)
                base = zip_ranges.data_start(reader, listed[DATA])
                lines = zip_ranges.read_member(reader, listed[INDEX]).decode().split("\n")
                reader.close()
                rows, start, lengths = [], base, []
                for at, length in (map(int, line.split()) for line in lines):
                    if lengths and base + at + length - start > SPAN_BYTES:
                        rows.append((start, lengths))
                        start, lengths = base + at, []
                    lengths.append(length)
                rows.append((start, lengths))
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(rows), "start": [r[0] for r in rows],
                    "lengths": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})

    return packages.repartition(task_count(packages.count())).mapInArrow(locate, "path string, start bigint, lengths array<bigint>")


def _parse(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    ident = lambda name: re.fullmatch(r"<urn:page:(-?\d+|null)>", fields[name])[1]
    page_id, digest = ident("WARC-Record-ID"), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record of page {page_id}: the payload does not match its digest")
    return (None if page_id == "null" else int(page_id), fields["WARC-Target-URI"], fields["WARC-Type"], digest, size,
            int(ident("WARC-Refers-To")) if revisit else None, payload)


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the listed packages; payloads are checked against their digests."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    used = len(names) if with_payload else len(names) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = RangeReader(row["path"])
                block, at, rows = reader.read(row["start"], sum(row["lengths"])), 0, []
                reader.close()
                for length in row["lengths"]:
                    rows.append(_parse(gzip.decompress(block[at:at + length])))
                    at += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kinds[i]) for i in range(used)], names[:used])

    # by bytes: the rows that name the spans are tiny, and Spark would put them all in one task
    total = packages.agg(F.sum("bytes")).first()[0] or 0
    spread = spans(packages).repartition(task_count(total // SPAN_BYTES + 1), "path", "start")
    return spread.mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as packages in the shared folder and read them back."""
    return read_packages(write_packages(record_plan(pages), folder or scratch(spark, "warc")))
