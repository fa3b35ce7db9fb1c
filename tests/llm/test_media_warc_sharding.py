import base64
import hashlib
import io
import tarfile
import zlib

import pytest
from pyarrow import fs

from quillmill.llm import media, sharding, warc
from quillmill.llm.storage import AtomicFile, open_filesystem, shared_root

TEXTS = ["abc", "", None, "x" * 64, "abc", "é" * 1000, "z" * 200_000, "y" * 63]


def test_media_round_trip(spark, make_docs):
    rows = {r["doc_id"]: r for r in media.media_columns(make_docs(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["width"], r["height"], r["depth"]) == (64, len(payload) // 64, 8)
    assert rows[0]["media_sha256"] == rows[4]["media_sha256"] and rows[0]["feature"] == rows[4]["feature"]
    assert media.media_columns(make_docs([])).collect() == []


def test_shards_are_tar_files_and_places_are_unique(spark, make_docs):
    folder, rows = media.store_media(make_docs(TEXTS))
    system, base = open_filesystem(folder)
    names = {}
    for info in system.get_file_info(fs.FileSelector(base)):
        with tarfile.open(fileobj=io.BytesIO(system.open_input_stream(info.path).read())) as tar:
            names |= {(info.base_name, m.offset_data): m.name for m in tar.getmembers()}
    placed = rows.collect()
    assert all(names[(r["shard"], r["offset"])] == f"{r['digest']}.png" for r in placed)
    assert media.places(rows).count() == len({r["digest"] for r in placed})
    heads = {r["digest"]: r["height"] for r in media.header_columns(folder, media.places(rows)).collect()}
    assert len(heads) == len({r["digest"] for r in placed})


def test_shards_are_bounded(spark, make_docs, monkeypatch):
    whole = sorted(tuple(r)[0:2] for r in media.media_columns(make_docs(TEXTS * 3)).select("doc_id", "media_sha256").collect())
    monkeypatch.setattr(media, "SHARD_BYTES", 100)
    folder, rows = media.store_media(make_docs(TEXTS * 3))
    assert rows.select("shard").distinct().count() > 6
    assert sorted(tuple(r) for r in media.media_columns(make_docs(TEXTS * 3)).select("doc_id", "media_sha256").collect()) == whole


def test_stored_form_against_its_files(spark, make_docs):
    """media_bytes, media_sha256 and feature of each document, by reading the stored files beside Spark."""
    docs = make_docs(TEXTS)
    want = {}
    for i, text in enumerate(TEXTS):
        payload = media.padded((text or "").encode())
        png = media.encode_image(payload)
        x = list(payload)
        mean = sum(x) / len(x)
        spread = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        want[i] = len(png), hashlib.sha256(png).hexdigest(), f"mean={mean:.3f};std={spread:.3f}"
    for r in media.media_columns(docs).collect():
        assert (r["media_bytes"], r["media_sha256"], r["feature"].rpartition(";entropy")[0]) == want[r["doc_id"]]


def test_images_by_hand():
    payload = bytes(range(256)) * 3
    stored = media.encode_image(payload)
    assert media.decode_image(stored) == payload and media.image_header(stored[: media.HEADER_BYTES])["height"] == 12
    with pytest.raises(ValueError):
        media.image_header(b"GIF89a" + b"\0" * 40)


def test_atomic_file_appears_when_closed(spark):
    folder = f"{shared_root(spark)}/atomic"
    file = AtomicFile(folder, "x", "bin")
    file.write(b"abc")
    system, base = open_filesystem(folder)
    assert not any(i.base_name == file.name for i in system.get_file_info(fs.FileSelector(base)))
    assert file.close() == file.name and system.open_input_stream(f"{base}/{file.name}").read() == b"abc"


PAGES = [(3, "http://a.b/c d", "<p>x</p>"), (1, "http://a.b/", "<p>x</p>"), (2, None, None), (9, "u", ""), (4, "http://é.b/ü", "big " * 50000), (None, "http://n", "<p>x</p>"), (7, "http://a", "one"), (7, "http://a", "one"), (8, "http://r", "a\r\n\r\nb")]


def captures(spark, **more):
    folder, files = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), **more)
    return folder, files, warc.assemble(warc.read_records(folder, files)).collect()


def test_transactions(spark):
    _, _, rows = captures(spark)
    by = {r["metadata"]["page_id"]: r for r in rows}
    assert len(rows) == len({(p, h) for p, _, h in PAGES})
    for page, _, html in PAGES:
        r, raw = by[page], (html or "").encode()
        assert r["payload"]["bytes"] == len(raw) and r["payload"]["digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        assert (r["record_type"], r["refers_to"]["page_id"] if r["refers_to"] else None) == (("response", None) if page == first else ("revisit", first))
        assert r["request"]["request_line"].startswith("GET /")


def test_small_payloads_are_not_shared(spark):
    _, _, rows = captures(spark, min_revisit_bytes=5)
    kinds = {r["metadata"]["page_id"]: r["record_type"] for r in rows}
    assert kinds[9] == kinds[2] == "response" and kinds[3] == "revisit"


def test_archives_are_standard_gzip_members(spark):
    import gzip

    folder, files, _ = captures(spark)
    system, base = open_filesystem(folder)
    raw = b"".join(gzip.decompress(system.open_input_stream(f"{base}/{r['file']}", compression=None).read()) for r in files.collect())
    assert raw.count(b"WARC/1.1\r\n") == 3 * len(PAGES) and b"WARC-Concurrent-To: <urn:uuid:" in raw
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder, files = warc.write_archives(none)
    assert warc.assemble(warc.read_records(folder, files)).collect() == []


def test_sharding_laws(spark, make_docs):
    texts = [f"text {i}" for i in range(4000)] + [None, "", "é"]
    rows = sharding.assign_shards(make_docs(texts), 24, rows_per_run=100).collect()
    by = {}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["grown_shard"] in (r["shard"], 24)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r["grown_shard"] == 24 for r in rows)
    assert 0.5 < moved / (len(rows) / 25) < 1.6


def test_sharding_one_by_one_equals_jumping(spark, make_docs):
    """Growing the shard count by one from 1 to 30 moves rows only into the new shard."""
    from pyspark.sql import functions as F

    docs = make_docs([str(i) for i in range(500)])
    cols = docs.select(*[sharding.jump_shard(F.col("doc_id"), n)[f"n{n}"].alias(str(n)) for n in range(1, 31)]).collect()
    for r in cols:
        for n in range(2, 31):
            assert r[str(n)] in (r[str(n - 1)], n - 1)


def test_shards_against_jumping_beside_spark(spark, make_docs):
    """The walk of each key, drawn with the xxhash library; slots by counting."""
    import math
    import struct

    import xxhash

    def shard_of(key, count):
        at, jump, last = 0, 0, 0
        while at < count:
            last = at
            seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            draw = ((xxhash.xxh64_intdigest(struct.pack("<i", jump), seed) >> 33) + 1) / (1 << 31)
            at, jump = math.floor((at + 1) / draw), jump + 1
        return last

    ids = [*range(-40, 400), None, 2**62, -(2**63), 7, 7, None]
    rows = sharding.assign_shards(make_docs([f"t{i}" for i in ids], ids), 24, rows_per_run=20).collect()
    assert sorted((str(r["doc_id"]), r["shard"], r["grown_shard"]) for r in rows) == sorted((str(i), shard_of(i, 24), shard_of(i, 25)) for i in ids)
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_a_row_repeated_very_often_is_dealt_over_tasks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = sharding.assign_shards(make_docs(["same"] * 100 + ["other"] * 3, [5] * 100 + [5, 5, 6]), 24).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 103 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_repeated_rows_null_ids_and_no_rows(spark, make_docs):
    rows = sharding.assign_shards(make_docs(["a"] * 6, [1, 1, None, None, None, 2]), 24).collect()
    assert len(rows) == 6 and sorted(r["slot"] for r in rows if r["doc_id"] is None)[-1] >= 2
    assert sharding.assign_shards(make_docs([]), 24).collect() == []


def test_each_row_comes_back(spark, tmp_path):
    rows = [*PAGES, (None, None, None), (None, "u", ""), (None, "u", None), (None, "v", "lone"), (None, "w", "lone"), (1, "http://0", "<p>x</p>"), (1, "http://a.b/", "<p>x</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=page)
        want.append((page, len((html or "").encode()), "response" if page == first else "revisit", None if page == first else first))
    key = lambda r: tuple(map(str, r))
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
