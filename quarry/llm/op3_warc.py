"""WARC archives: a writer and a Python data source.

The writer puts one record per row into a gzip member, one archive per partition, renamed into place
when whole, so a retried task replaces its file. Each member states its stored length in the gzip
extra field `sl` (skip lengths). The reader plans one partition per archive, takes filters on the
header columns, inflates a record's headers first, and jumps over the rest of a record that fails a
filter or whose payload isn't wanted: that part is neither inflated nor read. Members of other
writers, without `sl`, are inflated whole.

Ids travel as text, so they keep every digit and may be of any type; a null page_id is a record
without one. Null html is an empty payload; white space in a url becomes one space, since a header
is one line; of equal payloads without any page_id all are responses; repeated page_ids write
repeated records; other columns are left out; an empty table writes archives without records.
"""

from __future__ import annotations

import hashlib
import operator
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .common import read, shared_dir

LEAST_BYTES, DATE, CHUNK = 100, "1970-01-01T00:00:00Z", 4096
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# any file system that pyarrow reaches: file, hdfs, s3, gcs
HEADERS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(name: str | None) -> str | None:
    return unquote(name[10:-1]) if name and name.startswith("<urn:page:") else None


def member(data: bytes) -> bytes:
    """A gzip member whose extra field has its stored and its plain length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, (len(body) + 32) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return struct.pack("<4BIBBH", 31, 139, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def write_archive(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Writes records dated `date`; revisits of an equal payload carry no body."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    first = rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.join(first, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", "size", F.when(again, F.col("first").cast("string")).alias("first"))
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        tmp, n = f"{base}/.{pid}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(tmp, compression=None) as out:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    body = r.html.encode("utf-8", "surrogatepass") if r.first is None else b""
                    head = ["WARC/1.1", f"WARC-Type: {'response' if r.first is None else 'revisit'}", f"WARC-Record-ID: {urn(r.page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {'' if r.url is None else ' '.join(r.url.split())}", f"WARC-Payload-Digest: sha256:{r.digest}", "Content-Type: text/html", f"X-Payload-Bytes: {r.size}", f"Content-Length: {len(body)}"]
                    if r.first is not None:
                        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {urn(r.first)}"]
                    out.write(member("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"))
                    n += 1
        store.move(tmp, f"{base}/part-{pid:06d}.warc.gz")
        yield pd.DataFrame({"n": [n]})

    rows.mapInPandas(write, "n long").agg(F.sum("n")).collect()


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


def records(f, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers of every record of an open archive, and the payload where wanted(headers)."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        buf = f.read(CHUNK)
        stored = struct.unpack_from("<I", buf, 16)[0] if buf[3] & 4 and buf[12:14] == b"sl" else 0
        inflate, plain = zlib.decompressobj(31), bytearray()
        while True:
            plain += inflate.decompress(buf)
            if (end := plain.find(b"\r\n\r\n")) >= 0:
                break
            if not (buf := f.read(CHUNK)):
                raise ValueError("a record without an end of its headers")
        head = dict(line.split(": ", 1) for line in plain[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
        need = wanted(head)
        if need or not stored:
            while not inflate.eof and (buf := f.read(1 << 20)):
                plain += inflate.decompress(buf)
                if not need:
                    plain.clear()
        yield head, bytes(plain[end + 4 : end + 4 + int(head["Content-Length"])]) if need else None
        at = at + stored if stored else f.tell() - len(inflate.unused_data)


class WarcReader(DataSourceReader):
    COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
    COLUMNS = [x.split()[0] for x in HEADERS.split(", ")]

    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload, self.tests = folder, payload, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = self.COLUMNS.index(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.COLUMNS else None
            if column is not None and type(f) in self.COMPARE:
                self.tests.append((column, type(f).__name__, f.value))
            elif column is not None and isinstance(f, In):
                self.tests.append((column, "In", list(f.value)))
            elif column is not None and isinstance(f, IsNotNull):
                self.tests.append((column, "IsNotNull", None))
            else:
                yield f

    def passes(self, values: tuple) -> bool:
        compare = {k.__name__: v for k, v in self.COMPARE.items()} | {"In": lambda a, b: a in b, "IsNotNull": lambda a, b: True}
        return all(values[c] is not None and compare[kind](values[c], value) for c, kind, value in self.tests)

    def partitions(self):
        store, base = fs.FileSystem.from_uri(self.folder)
        return [Archive(x.path) for x in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda x: x.path) if x.path.endswith(".warc.gz")]

    def read(self, partition):
        if not hasattr(partition, "path"):
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        values = ()

        def wanted(head: dict[str, str]) -> bool:
            nonlocal values
            values = (page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI") or None, int(head.get("X-Payload-Bytes", head["Content-Length"])), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], page_of(head.get("WARC-Refers-To")))
            return self.payload and self.passes(values)

        with store.open_input_file(partition.path) as f:
            for head, body in records(f, wanted):
                if not self.passes(values):
                    continue
                if body is not None and head["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != values[3]:
                    raise ValueError(f"{partition.path}: the payload of {values[0]} differs from its digest")
                yield (*values, body) if self.payload else values


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "quarry_warc"

    def schema(self):
        return HEADERS + ", payload binary" * (self.options.get("payload", "false") == "true")

    def reader(self, schema):
        return WarcReader(self.options["folder"], self.options.get("payload", "false") == "true")


def read_archive(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The headers of all records as columns, and the payload if wanted; ids are text."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("quarry_warc").option("folder", folder).option("payload", str(payload).lower()).load()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", read(spark, sf_dir, "pages")
    write_archive(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_archive(spark, folder).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
