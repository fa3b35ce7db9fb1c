"""WARC archives: writing pages as transactions, and assembling transactions from archives.

A page becomes three records, each a gzip member of its own: a response (or, where an equal payload is stored already, a
revisit), the request, and a metadata record; the last two name the first in WARC-Concurrent-To. Reading goes the other way:
all records are parsed, requests and metadata are joined to their response or revisit through these identifiers, revisits
to the response that they refer to, and each capture becomes one nested row.

Edge cases: a null or empty html is an empty payload (as any other, the smallest page_id of its kind is the response). A
null page_id is larger than any other and is kept null. Rows that share page_id and payload get the same
values; the query gives a row for each of them. A null url is the empty URL. An empty table gives no archive and no row. Columns other than the
three named are ignored. Digests are of full payloads; very long pages are single records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.storage import AtomicFile, cut, keep, new_folder, open_filesystem, tidy
from quillmill.llm.words import chunks_of

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6f1c4f0e-5d2e-5b7e-9a55-0d6f5a0e4b11")
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{kind}/{page}/{digest}')}>"


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def transaction(page: int | None, url: str, payload: bytes, refers_to: int | None, date: str, mark: str = "", refers_mark: str = "") -> list[bytes]:
    """The capture's records: response or revisit, request, metadata. The marks tell captures of equal page and payload apart."""
    digest = payload_digest(payload)
    name = digest + mark
    uri = "".join(c for c in url if c.isprintable() and c != " ")
    capture = record_id("capture", page, name)
    common = {"WARC-Target-URI": uri, "WARC-Date": date}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = {"WARC-Record-ID": capture, **common, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        first = record({"WARC-Type": "response", **about}, http + payload)
    else:
        first = record({"WARC-Type": "revisit", **about, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id("capture", refers_to, digest + refers_mark)}, http)
    link = {"WARC-Concurrent-To": capture, **common}
    host, _, path = uri.partition("://")[2].partition("/")
    request = record({"WARC-Type": "request", "WARC-Record-ID": record_id("request", page, name), **link, "Content-Type": "application/http; msgtype=request"}, f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    metadata = record({"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", page, name), **link, "Content-Type": "application/warc-fields"}, f"pageId: {'' if page is None else page}\r\n".encode())
    return [first, request, metadata]


def _write(folder: str, date: str, each_row: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, names = None, 0, []
        for batch in chunks_of(batches, "html"):
            for row in zip(*[batch.column(c) if c == "html" else batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url", "low", "high")], strict=True):
                page, url, html, refers_to, refers_url, low, high = row
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                for copy in range(low, high):
                    file = file or AtomicFile(folder, f"pages-{TaskContext.get().partitionId():06d}-{number:04d}", "warc.gz")
                    marks = (f"/{url or ''}/{copy}", f"/{refers_url or ''}/0") if each_row else ("", "")
                    file.write(b"".join(transaction(page, url or "", payload, refers_to, date, *marks)))
                    if file.position >= ARCHIVE_BYTES:
                        names.append(file.close())
                        file, number = None, number + 1
        if file:
            names.append(file.close())
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string())})

    return run


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member of a stream."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            return
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> dict:
    """One record: the fields that assembly needs, and for responses what the payload itself says."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    out = {"kind": fields["warc-type"], "id": fields["warc-record-id"], "concurrent_to": fields.get("warc-concurrent-to"), "refers_to_id": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": None, "payload_bytes": None, "page_id": None, "request_line": None}
    if out["kind"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        out |= {"digest": payload_digest(payload), "payload_bytes": len(payload)}
        if fields["warc-payload-digest"] != f"sha1:{out['digest']}":
            raise ValueError(f"the payload of {out['id']} differs from its digest")
    elif out["kind"] == "revisit":
        http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}
        out |= {"digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(http["content-length"])}
    elif out["kind"] == "request":
        out["request_line"] = block.partition(b"\r\n")[0].decode("utf-8", "replace")
    elif out["kind"] == "metadata":
        page = block.partition(b"pageId:")[2].partition(b"\r\n")[0].strip()
        out["page_id"] = int(page) if page else None
    return out


_RECORDS = pa.schema([*[(c, pa.string()) for c in ("kind", "id", "concurrent_to", "refers_to_id", "uri", "date", "digest")], ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("request_line", pa.string())])
_RECORDS_DDL = "kind string, id string, concurrent_to string, refers_to_id string, uri string, date string, digest string, payload_bytes long, page_id long, request_line string"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(parse(raw))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return run


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", each_row: bool = False) -> tuple[str, DataFrame]:
    """Write all pages; the archives' folder and a row for each file.

    Payloads of at least `min_revisit_bytes` that are equal are stored once, with the smallest page_id.
    With `each_row` every row is a capture of its own; else rows of equal page_id and payload have the same ids.
    """
    if each_row:
        return _write_each(pages, min_revisit_bytes, date)
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("html"))
    keys = slim.select("page_id", F.sha1(html.cast("binary")).alias("sha"), (F.octet_length(html) >= min_revisit_bytes).alias("shared"))
    first = keys.filter("shared").groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    later = keys.filter("shared").join(first.select("sha", "refers_to"), "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).dropDuplicates(["page_id", "sha"])
    named = slim.withColumn("sha", F.sha1(html.cast("binary"))).alias("p").join(later.alias("l"), F.col("p.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("p.sha") == F.col("l.sha")), "left")
    folder = new_folder(pages.sparkSession, "warc")
    return folder, cut(named.select("p.page_id", "url", "html", "refers_to", F.lit(None).cast("string").alias("refers_url"), F.lit(0).alias("low"), F.lit(1).alias("high")).mapInArrow(tidy(_write(folder, date, False)), "file string"))


#: Copies of a row that one task writes in a go.
COPIES = 4096


def _write_each(pages: DataFrame, min_revisit_bytes: int, date: str) -> tuple[str, DataFrame]:
    """Rows of equal page_id, url and payload are counted and met once, and written as often as counted, in ranges dealt
    over tasks; their ids have the url and the number of the copy. Revisits refer to copy 0 of the response's first url."""
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    group = ["page_id", "url", "sha"]
    counted = keep(slim.select(*group, (F.octet_length("html") >= min_revisit_bytes).alias("shared")).groupBy(*group, "shared").agg(F.count("*").alias("n")))
    first = counted.filter("shared").groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.sum("n").alias("all"))
    first = first.filter("all > 1 and first.page_id is not null").select("sha", "first")
    refers = ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("first").isNotNull()
    about = counted.join(first, "sha", "left").select(*group, "n", *[F.when(refers, F.col(f"first.{a}")).alias(b) for a, b in (("page_id", "refers_to"), ("url", "refers_url"))])
    about = about.filter("n > 1 or refers_to is not null")
    plain = ["page_id", "url", "html", "refers_to", "refers_url"]

    def named(rows: DataFrame, how: str) -> DataFrame:
        same = F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("p.url") == F.col("a.url")) & (F.col("p.sha") == F.col("a.sha"))
        return slim.alias("p").join(rows.alias("a"), same, how).select("p.page_id", "p.url", "p.sha", "html", "refers_to", "refers_url", "n")

    once = named(about, "left").filter("n is null or n = 1").select(*plain, F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("high"))
    # Repeated rows are few or none: as a table, their size is known before payloads are shuffled for them.
    many = named(keep(about.filter("n > 1")), "inner").dropDuplicates(group)
    many = many.select(*plain, "n", "sha", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("low"))
    many = many.repartition("page_id", "url", "sha", "low").select(*plain, "low", F.least(F.col("low") + COPIES, F.col("n")).alias("high"))
    folder = new_folder(pages.sparkSession, "warc")
    return folder, cut(once.unionByName(many).mapInArrow(tidy(_write(folder, date, True)), "file string"))


def read_records(folder: str, files: DataFrame) -> DataFrame:
    """A row for each record of the archives, payloads left out."""
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "file").mapInArrow(tidy(_read(folder)), _RECORDS_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: id, uri, date, record_type, payload, request, metadata, refers_to."""
    captures = records.filter(F.col("kind").isin("response", "revisit"))
    by = lambda kind, *fields: records.filter(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("id")).agg(F.min(F.struct(F.col("id").alias("record"), *fields)).alias(kind))
    joined = captures.select("id", "uri", "date", "kind", "digest", "payload_bytes", "refers_to_id").dropDuplicates(["id"])
    joined = joined.join(by("request", "request_line"), "id", "left").join(by("metadata", "page_id"), "id", "left")
    joined = keep(joined)  # so that a response that very many revisits refer to can be met by a split join
    targets = joined.filter("kind = 'response'").select(F.col("id").alias("refers_to_id"), F.struct("metadata.page_id", "id", "uri").alias("refers_to"))
    return joined.join(targets, "refers_to_id", "left").select("id", "uri", "date", F.col("kind").alias("record_type"), F.struct("digest", F.col("payload_bytes").alias("bytes")).alias("payload"), "request", "metadata", "refers_to")


def query(spark, sf_dir: str) -> DataFrame:
    folder, files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), each_row=True)
    captures = assemble(cut(read_records(folder, files)))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"), F.col("payload.bytes").alias("payload_bytes"), F.col("payload.digest").alias("payload_digest"), "record_type", F.col("refers_to.page_id").alias("refers_to")
    )
