import hashlib

from quillmill.llm import line_dedup


def brute(docs, min_length=40, min_docs=5):
    keys, out = {}, {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                keys.setdefault(key(line), set()).add(i)
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(keys.get(key(x), ())) >= min_docs and max(keys[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def test_against_brute_force(spark, make_docs):
    common = "x" * 38 + " É Y"
    docs = [(i, "\n".join([f"own line {i}", f"  {common}\t" if i % 2 else common.replace("x", "X"), "short", common] if i < 40 else [f"alone {i} " + "z" * 50])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "word " * 20000)]
    docs += [(200 + i, "rare " * 10) for i in range(4)] + [(300 + i, "é" * 40) for i in range(5)] + [(400 + i, "é" * 39) for i in range(5)]
    got = line_dedup.dedup_lines(make_docs([t for _, t in docs], [i for i, _ in docs])).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == brute(docs)


def test_hot_line_over_many_partitions(spark, make_docs):
    line = "the very same line in every document, all of them"
    got = line_dedup.dedup_lines(make_docs([f"{line}\n{i}" for i in range(3000)])).groupBy("n_dropped").count().collect()
    assert {r["n_dropped"]: r["count"] for r in got} == {1: 2999, 0: 1}


def test_repeated_rows_null_ids_and_no_rows(spark, make_docs):
    line = "l" * 45
    rows = line_dedup.dedup_lines(make_docs([line] * 6 + [line], [None, 1, 1, 2, 3, 4, 4])).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in rows) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)]
    assert line_dedup.dedup_lines(make_docs([])).collect() == []
