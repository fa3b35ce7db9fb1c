"""Fixed cases of facts, redaction, templates and files."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import facts, misc
from quillmill.sources import files


def test_addenda(spark):
    listed = "부칙\n1. 따로 정한다.\n2. 이 규정은 1982년 10월 11일부터 시행한다.\n3. 이 개정 규정은 2020년 12월 15일부터 시행하며 소급 적용한다. 시행한다\n[별지 1]\n2030. 1. 1. 시행한다"
    blocks = [listed, "부 칙(1987.  2.  9.)\n①(시행일) 이 규칙은 공포한 날로부터 시행한다.", "부칙\n공포한 날", None, "부칙 2001. 2. 3."]
    found = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b string").orderBy("i").select(facts.addenda(F.col("b"))).collect()]
    assert [a["enforced_from"] for a in found[0]] == ["1982-10-11", "2020-12-15"] and [a["retroactive"] for a in found[0]] == [False, True]
    assert [(a["header_date"], a["enforced_from"]) for a in found[1]] == [("1987-02-09", None)] and found[2:4] == [[], []]
    assert [(a["header_date"], a["text"]) for a in found[4]] == [("2001-02-03", "부칙 2001. 2. 3.")]


def test_revisions_and_answers(spark):
    block = "제2조(이름) 본문 (개정 2018. 12. 3., 2021. 9. 27.)(변경 2006. 9. 1.)"
    row = spark.createDataFrame([(block,)], "b string").select(facts.revisions(F.col("b")).alias("r")).first()
    assert row["r"] == ["2006-09-01", "2018-12-03", "2021-09-27"]
    store = spark.createDataFrame([("2024-01-01", [("2001-01-01", None, False, "2017학년도 입학생"), (None, "1999-05-05", False, "x")], {"제2조": ["2006-09-01", "2021-09-27"]})], "f string, a array<struct<header_date string, enforced_from string, retroactive boolean, text string>>, m map<string, array<string>>")
    said = lambda q: store.select(facts.answer(F.lit(q), F.col("f"), F.col("a"), F.col("m"))).first()[0]
    assert [said(q) for q in ("현행 시행일", "최근 부칙", "최초 시행", "부칙 중 2017학년도", "제2조 개정일", "제9조 개정일", "무엇")] == ["2024-01-01", "1999-05-05", "2001-01-01", "2001-01-01", "2021-09-27", None, "2024-01-01"]


def test_loose_dates(spark):
    rows = spark.createDataFrame([("2026-07-01", "2026. 7. 1. 시행"), ("2026-07-01", "2026년 07월 01일"), ("2026-07-01", "2026-08-01"), ("x", "2026")], "d string, t string")
    assert [r[0] for r in rows.select(facts.loosely_present(F.col("d"), F.col("t"))).collect()] == [True, True, False, False]


def test_formats():
    assert misc.strftime_format("yyyy-MM-dd HH:mm:ss") == "%Y-%m-%d %H:%M:%S" and misc.strftime_format("tt h") == "%p %I" and misc.strftime_format("yyyyMMdd") == "yyyyMM%d"


def test_host_classes(spark):
    hosts = ["http://db:80/x", "localhost", "10.1.2.3", "https://8.8.8.8", "a.b.c", "name", "", None]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(misc.host_class(F.col("h"), ["db"])).collect()]
    assert got == ["http://container:db", "localhost", "private-ip", "https://public-ip", "public-host", "name", "empty", "empty"]


def test_token_counts(spark):
    cases = [(12, 0, 1, 0, 57), (10, 2, 5, 3, 18), (10, 2, 8, 3, 18), (10, None, 5, None, None)]
    rows = spark.createDataFrame(cases, "p int, k int, c int, r int, t int").select(misc.token_counts(*[F.col(x) for x in "pkcrt"]).alias("x")).collect()
    assert [tuple(r["x"]) for r in rows] == [(12, 0, 45, 44), (10, 2, 8, 3), (10, 2, 8, 3), (10, 0, 5, 0)]


@pytest.mark.parametrize(("raw", "text"), [("é가".encode(), "é가"), ("가나".encode("cp949"), "가나"), (b"\xff\xfe\x00 x ", "ÿþ x"), (b"", None), (None, None), (b" \x00 ", None)])
def test_decoding(raw, text):
    assert misc.decode_bytes(raw) == text


def test_cover_density():
    assert misc.cover_density("a b".split(), ["a", "b"]) == 1.0 and misc.cover_density("a x b".split(), ["a", "b"]) == 0.5
    assert misc.cover_density("a b x a b".split(), ["a", "b"]) == pytest.approx(1 + 0.5 + 1) and misc.cover_density(["a"], ["a", "b"]) == 0.0 and misc.cover_density(["a"], []) == 0.0


def test_flattening_and_extraction(spark):
    assert misc.flatten_json({"b": {"c": 1, "d": [2, {"x": 1}, [], {}, [[3]]]}, "a": None}) == {"a": "null", "b.c": "1", "b.d[0]": "2", "b.d[1].x": "1", "b.d[2]": "[]", "b.d[3]": "{}", "b.d[4][0][0]": "3"}
    assert misc.flatten_json({}) == {} and misc.flatten_json([{"b": 1}]) == {"[0].b": "1"}
    rows = spark.createDataFrame([('so {"a": {"b": 1}} ok',), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(misc.json_object(F.col("t"))).collect()] == ['{"a": {"b": 1}}', "{}", "{}"]


def test_routes_and_json_lines(spark, tmp_path):
    names = spark.createDataFrame([("a.TXT",), ("b.doc",), ("c",), ("규정.hwp",)], "n string")
    assert [r[0] for r in names.select(files.route_of(F.col("n"))).collect()] == ["plain", None, None, "hwp"]
    (tmp_path / "x.jsonl").write_text('# note\n\n{"a": 1}\n  \n{"a": 2}\n')
    assert [r["a"] for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").orderBy("a").collect()] == [1, 2]
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "나.txt").write_text("y")
    assert [(r["name"], r["size"]) for r in files.scan_directory(spark, str(tmp_path), "*.txt").collect()] == [("나.txt", 1)]


def test_manifests_list_folders_in_tasks(spark, tmp_path, monkeypatch):
    """Files in folders, hidden ones beside them, one rewritten; no listing by the driver."""
    import os

    from pyspark.sql import DataFrameReader

    def refuse(*_, **__):
        raise AssertionError("the driver lists the files")

    monkeypatch.setattr(DataFrameReader, "load", refuse)
    frame = lambda rows: spark.createDataFrame(rows, "name string, content string").repartition(2)
    assert files.write_files(frame([(f"{i % 5}/f{i}.txt", "x" * i) for i in range(20)] + [("top.md", "a"), ("0/.hidden", "b"), ("1/_gone", "c"), ("2/sub/b%20+.txt", "dd")]), str(tmp_path)) == 24
    seen = lambda: {r["name"]: (r["size"], r["modified"]) for r in files.file_manifest(spark, str(tmp_path)).collect()}
    before = seen()
    assert {n: s for n, (s, _) in before.items()} == {f"f{i}.txt": i for i in range(20)} | {"top.md": 1, "b%20+.txt": 2}
    files.write_files(frame([("3/f3.txt", "longer")]), str(tmp_path))
    after = seen()
    assert {n for n in after if after[n] != before[n]} == {"f3.txt"} and after["f3.txt"][0] == 6
    assert abs(after["f3.txt"][1].timestamp() - os.stat(tmp_path / "3" / "f3.txt").st_mtime) < 1e-3
    assert {r["name"] for r in files.file_manifest(spark, f"{tmp_path}/2", "*.txt").collect()} == {"f2.txt", "f7.txt", "f12.txt", "f17.txt", "b%20+.txt"}
