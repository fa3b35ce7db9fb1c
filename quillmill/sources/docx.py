"""Word documents as a data source: `spark.read.format("docx")`, and written back in the same form.

A row for each paragraph and table of a file's body, in document order. Files are listed once and dealt into partitions of `FILES`; a task
reads one file after the other. A body of up to `WHOLE` bytes is parsed at once, of a longer one there is one block at a time, as the XML streams by.
The writer makes a file of each run of rows with one path; files appear under their names only when whole, so a task that is
run again replaces what it wrote. Rows go in and out as Arrow batches.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: `kind` is paragraph, table, or broken for a file that can't be read; `cells` are a table's.
SCHEMA = "path string, at int, kind string, text string, cells array<array<string>>"
#: Files of a partition at most; of a folder with fewer than `SPREAD` times as many, as many partitions, of `FEW` files or more.
FILES, SPREAD, FEW = 2_000, 64, 50
#: Bytes of a body that is parsed at once, and of pieces that are compressed together; rows of a batch and about its letters.
WHOLE, PIECE = 4 << 20, 64 << 10
ROWS, LETTERS = 1_000, 1 << 20
# The namespace and the parts of a file.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY = "word/document.xml"
PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
#: What XML can't hold; it isn't written.
SAID = {f"{W}t": lambda e: e.text or "", f"{W}tab": lambda e: "\t", f"{W}br": lambda e: "\n", f"{W}cr": lambda e: "\n"}
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def paragraph_text(paragraph: ElementTree.Element) -> str:
    return "".join(SAID[run.tag](run) for r in paragraph.iter(f"{W}r") for run in r if run.tag in SAID)


def table_cells(table: ElementTree.Element) -> list[list[str]]:
    """Rows of cells; a cell over several columns stands in each, one over several rows in each row."""
    rows: list[list[str]] = []
    for line in table.findall(f"{W}tr"):
        row: list[str] = []
        for cell in line.findall(f"{W}tc"):
            about = cell.find(f"{W}tcPr")
            span = about.find(f"{W}gridSpan") if about is not None else None
            merge = about.find(f"{W}vMerge") if about is not None else None
            text = "\n".join(paragraph_text(p) for p in cell.findall(f"{W}p")).strip().replace("\n", " ")
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * int(span.get(f"{W}val", "1") if span is not None else 1)
        rows.append(row)
    return rows


def _block(element: ElementTree.Element) -> tuple[str, str | None, list[list[str]] | None] | None:
    """What a child of the body is, if it is a block."""
    if element.tag == f"{W}p" and (text := paragraph_text(element).strip()):
        return "paragraph", text, None
    return ("table", None, table_cells(element)) if element.tag == f"{W}tbl" else None


def _streamed(body) -> Iterator[ElementTree.Element]:
    """The children of a body, each forgotten after the next one is asked for."""
    depth, parents = 0, []
    for event, element in ElementTree.iterparse(body, ("start", "end")):
        if event == "start":
            depth += 1
            parents.append(element)
            continue
        depth -= 1
        parents.pop()
        if depth == 2 and parents[-1].tag == f"{W}body":
            yield element
            parents[-1].remove(element)


def _children(archive: zipfile.ZipFile) -> Iterator[ElementTree.Element]:
    if archive.getinfo(BODY).file_size <= WHOLE:
        try:
            root = ElementTree.fromstring(archive.read(BODY))
        except ElementTree.ParseError:
            pass  # what stands before the fault is found below
        else:
            for body in root.iterfind(f"{W}body"):
                yield from body
            return
    with archive.open(BODY) as body:
        yield from _streamed(body)


def blocks_of(stream) -> Iterator[tuple[str, str | None, list[list[str]] | None]]:
    """(kind, text, cells) of a document's body, one block after the other; empty paragraphs are left out."""
    with zipfile.ZipFile(stream) as archive:
        for element in _children(archive):
            if block := _block(element):
                yield block


def document_xml(blocks: Iterable[tuple[str, str | None, list[list[str]] | None]]) -> Iterator[str]:
    def run(text: str) -> str:
        clean = NOT_XML.sub("", text or "")
        if clean.isprintable():  # neither tabs nor breaks
            return f'<w:p><w:r><w:t xml:space="preserve">{escape(clean)}</w:t></w:r></w:p>'
        parts = [f'<w:t xml:space="preserve">{escape(p, {chr(13): "&#13;"})}</w:t>' if p not in "\t\n" or not p else "<w:tab/>" if p == "\t" else "<w:br/>" for p in re.split("([\t\n])", clean)]
        return f"<w:p><w:r>{''.join(parts)}</w:r></w:p>"

    yield f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>'
    for kind, text, cells in blocks:
        if kind == "table":
            yield "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{run(c)}</w:tc>" for c in row) + "</w:tr>" for row in cells or []) + "</w:tbl>"
        else:
            yield run(text or "")
    yield "</w:body></w:document>"


def _pieces(parts: Iterable[str]) -> Iterator[bytes]:
    """The parts in UTF-8, short ones put together."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= PIECE:
            yield "".join(held).encode()
            held, size = [], 0
    yield "".join(held).encode()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri)) if ":" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Files(InputPartition):
    paths: list[str]


class DocxReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.folder, self.files, self.schema = options["path"], int(options.get("files", FILES)), schema

    def partitions(self) -> list[Files]:
        system, base = _open(self.folder)
        found = [system.get_file_info(base)] if system.get_file_info(base).is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda p: p.rsplit("/", 1)[-1].startswith((".", "~$", "_"))
        names = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".docx") and not hidden(f.path))
        each = min(self.files, max(FEW, -(-len(names) // SPREAD)))
        return [Files(names[i : i + each]) for i in range(0, len(names), each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for row in self.rows(partition):
            held.append(row)
            letters += len(row[3] or "") + sum(len(c) for line in row[4] or [] for c in line)
            if len(held) >= ROWS or letters >= LETTERS:
                yield self.batch(held)
                held, letters = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)

    def rows(self, partition: Files) -> Iterator[tuple]:
        system, base = _open(self.folder)
        for path in partition.paths:
            name = path.removeprefix(base).lstrip("/") or path.rsplit("/", 1)[-1]
            try:
                with system.open_input_file(path) as file:
                    size = file.size()
                    if size < 22:  # the least that an archive has
                        raise zipfile.BadZipFile
                    stream = io.BytesIO(file.read()) if size <= WHOLE else io.BufferedReader(file)
                    for at, (kind, text, cells) in enumerate(blocks_of(stream)):
                        yield name, at, kind, text, cells
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                yield name, -1, "broken", None, None


class DocxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = _open(self.folder)
        system.create_dir(base, recursive=True)
        each = (row for batch in iterator for row in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "text", "cells")), strict=True))
        for path, rows in groupby(each, key=lambda r: r[0]):
            at, part = f"{base}/{path}", f"{base}/.{uuid.uuid4().hex}.part"
            with io.BufferedWriter(system.open_output_stream(part), PIECE) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                for name, content in PARTS.items():
                    archive.writestr(name, content, zipfile.ZIP_STORED)
                with archive.open(BODY, "w", force_zip64=True) as body:
                    for piece in _pieces(document_xml(r[1:] for r in rows)):
                        body.write(piece)
            system.move(part, at)
        return WriterCommitMessage()


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options, to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> DocxWriter:
        return DocxWriter(self.options)


def read_docx(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """The blocks of all .docx files of a folder."""
    spark.dataSource.register(DocxSource)
    return spark.read.format("docx").option("files", files).load(folder)


def write_docx(blocks: DataFrame, folder: str) -> None:
    """Files from blocks (path, at, kind, text, cells); all of a file's blocks meet in one task, in order. What XML can't hold is left out."""
    blocks.sparkSession.dataSource.register(DocxSource)
    ordered = blocks.select("path", F.col("at").cast("int").alias("at"), "kind", "text", "cells").repartition("path").sortWithinPartitions("path", "at")
    ordered.write.format("docx").mode("append").save(folder)


def block_text(number: Column) -> Column:
    """A block as text: a paragraph as it is, a table as Markdown under its number."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.get("cells", F.lit(0))
    body = F.transform(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), line)
    lines = F.when(F.size("cells") > 0, F.concat(F.array(line(head), line(F.transform(head, lambda _: F.lit("---")))), body)).otherwise(F.array().cast("array<string>"))
    table = F.array_join(F.concat(F.array(F.concat(F.lit("[표 "), number.cast("string"), F.lit("]"))), lines), "\n")
    return F.when(F.col("kind") == "table", table).otherwise(F.col("text"))
