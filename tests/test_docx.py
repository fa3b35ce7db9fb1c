"""Word files: what the reader makes of their XML, and round trips."""

import io
import zipfile

from pyspark.sql import functions as F

from quillmill.sources import docx

HEAD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:x="urn:x"><w:body>'


def zipped(body, name=docx.BODY):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(name, HEAD + body + "</w:body></w:document>")
    out.seek(0)
    return out


def cell(text, about=""):
    return f"<w:tc><w:tcPr>{about}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def test_paragraphs_and_tables_in_order():
    body = (
        "<w:p><w:r><w:t> one</w:t><w:tab/><w:t>two</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>three</w:t></w:r></w:hyperlink><w:r><w:delText>gone</w:delText></w:r></w:p><w:p/>"
        f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl><w:p><w:r><w:t>after</w:t></w:r></w:p><w:sectPr/>"
    )
    assert list(docx.blocks_of(zipped(body))) == [("paragraph", "one\ttwo\nthree", None), ("table", None, [["a", "b"]]), ("paragraph", "after", None)]


def test_merged_cells_and_tables_within_cells():
    inner = f"<w:tc><w:p><w:r><w:t>outer</w:t></w:r></w:p><w:p><w:r><w:t>more</w:t></w:r></w:p><w:tbl><w:tr>{cell('inner')}</w:tr></w:tbl></w:tc>"
    start, goes_on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    body = f"<w:tbl><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('x')}</w:tr><w:tr>{cell('tall', start)}{cell('1')}{inner}</w:tr><w:tr>{cell('', goes_on)}{cell('2')}{cell('3')}</w:tr></w:tbl>"
    assert list(docx.blocks_of(zipped(body))) == [("table", None, [["wide", "wide", "x"], ["tall", "1", "outer more"], ["tall", "2", "3"]])]


def test_round_trip_with_odd_letters_and_broken_files(spark, tmp_path):
    at = str(tmp_path / "d")
    texts = ["plain", "<a & b>", "tab\there", "two\nlines", "bell\x07gone ￾", "  blanks  kept  inside ", "carriage\rreturn", "é 규정 𝄞", "]]>"]
    rows = [("a.docx", i, "paragraph", t, None) for i, t in enumerate(texts)] + [("a.docx", 99, "table", None, [["h", "i"], ["1\n2", ""]]), ("b.docx", 0, "paragraph", "", None), ("c.docx", 0, "table", None, [])]
    docx.write_docx(spark.createDataFrame(rows, docx.SCHEMA).repartition(3), at)
    (tmp_path / "d" / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "d" / "other.docx").write_bytes(zipped("", "word/else.xml").getvalue())
    (tmp_path / "d" / "cut.docx").write_bytes(zipped("<w:p>").getvalue())
    (tmp_path / "d" / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "d" / "notes.txt").write_bytes(b"text")
    got = docx.read_docx(spark, at, files=1).orderBy("path", "at").collect()
    assert {r["path"] for r in got if r["kind"] == "broken"} == {"broken.docx", "other.docx", "cut.docx"}
    assert [r["text"] for r in got if r["path"] == "a.docx" and r["kind"] == "paragraph"] == ["plain", "<a & b>", "tab\there", "two\nlines", "bellgone", "blanks  kept  inside", "carriage\rreturn", "é 규정 𝄞", "]]>"]
    assert [r["cells"] for r in got if r["kind"] == "table"] == [[["h", "i"], ["1 2", ""]], []]
    docx.write_docx(spark.createDataFrame([("a.docx", 0, "paragraph", "new", None)], docx.SCHEMA), at)  # in place of the old file
    assert [r["text"] for r in docx.read_docx(spark, at).filter("path = 'a.docx'").collect()] == ["new"]


def test_blocks_as_text(spark):
    rows = [("a", 0, "table", None, [["h", "i"], ["1", "2"]]), ("a", 1, "table", None, []), ("a", 2, "paragraph", "p", None)]
    got = spark.createDataFrame(rows, docx.SCHEMA).orderBy("at").select(docx.block_text(F.col("at") + 1)).collect()
    assert [r[0] for r in got] == ["[표 1]\n| h | i |\n| --- | --- |\n| 1 | 2 |", "[표 2]", "p"]


def test_an_empty_folder(spark, tmp_path):
    assert docx.read_docx(spark, str(tmp_path)).collect() == []


def test_short_bodies_are_parsed_at_once_and_long_ones_stream(monkeypatch):
    """Both ways give the same blocks, and of a damaged body what stands before the fault."""
    body = f"<w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl><w:sdt><w:p/></w:sdt><w:p><w:r><w:t>two</w:t></w:r></w:p>"

    def found(text):
        got = []
        try:
            for block in docx.blocks_of(zipped(text)):
                got.append(block)
        except docx.ElementTree.ParseError:
            got.append("broken")
        return got

    streamed = []
    real = docx._streamed
    monkeypatch.setattr(docx, "_streamed", lambda b: streamed.append(1) or real(b))
    at_once = found(body)
    assert not streamed and [b[0] for b in at_once] == ["paragraph", "table", "paragraph"]
    damaged = found(body + "<w:p>")
    assert damaged == [*at_once, "broken"]
    monkeypatch.setattr(docx, "WHOLE", 0)
    assert found(body) == at_once and found(body + "<w:p>") == damaged and streamed


def test_rows_move_in_batches(spark, tmp_path):
    """The reader gives Arrow batches bounded by rows and letters, the writer takes them; a long run of rows is one file."""
    at = str(tmp_path / "d")
    rows = [("a.docx", i, "paragraph", f"line {i}", None) for i in range(2_500)] + [("b.docx", 0, "paragraph", "x" * (docx.LETTERS + 1), None), ("b.docx", 1, "table", None, [["h"]])]
    docx.write_docx(spark.createDataFrame(rows, docx.SCHEMA), at)
    got = docx.read_docx(spark, at).orderBy("path", "at").collect()
    assert [tuple(r) for r in got] == rows
    reader = docx.DocxReader({"path": at}, docx.to_arrow_schema(docx.read_docx(spark, at).schema))
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == len(rows) and max(sizes) == docx.ROWS and len(sizes) >= 4


def test_partitions_follow_the_number_of_files(tmp_path):
    schema = docx.pa.schema([])
    for n in range(130):
        (tmp_path / f"{n}.docx").touch()
    sizes = lambda **o: [len(p.paths) for p in docx.DocxReader({"path": str(tmp_path), **o}, schema).partitions()]
    assert sizes() == [docx.FEW, docx.FEW, 130 - 2 * docx.FEW] and sizes(files="40") == [40, 40, 40, 10]
