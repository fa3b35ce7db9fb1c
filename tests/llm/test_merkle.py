import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillmill.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves, fanout):
    """The root, and for each leaf its place and siblings at each level."""
    proofs, nodes, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            run = nodes[at - at % fanout : at - at % fanout + fanout]
            proofs[k].append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        nodes, own = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], [at // fanout for at in own]
    return nodes[0], proofs


def brute(rows, fanout=8):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    names = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in names]
    trees = [tree_of([leaf_of(r) for r in g], fanout) for g in groups]
    if not trees:
        return []
    root, tops = tree_of([t[0] for t in trees], fanout)
    out = []
    for group, (subroot, proofs), top in zip(groups, trees, tops, strict=True):
        for row, proof in zip(group, proofs, strict=True):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].translate(LOWER))
            node = leaf_of(changed)
            for place, others in proof + top:
                node = digest("".join(others[:place]) + node + "".join(others[place:]))
            out.append((row[0], leaf_of(row), subroot, root, digest("".join("".join(x[1]) for x in proof + top)), node, node == root))
    return out


def rows_of(n, langs=("en", "de", None, "é", "e", "")):
    rows = [(i * 7 % n, None if i % 11 == 0 else f"s{i % 3}", langs[min(i * i % 17, len(langs) - 1)], None if i % 5 == 0 else i, None if i % 13 == 0 else f"Text É {i}" if i % 2 else "") for i in range(n)]
    rows += [(None, "s", "en", 1, "No Id"), (None, None, None, None, None), (3, "s", "en", 1, "Same Id A"), (3, "s", "en", 1, "Same Id B")]
    return rows + [(5, "Z", "en", 4, "Twice Over")] * 5 + [(6, "long", "fr", 9, "Very LONG " * 50_000)]


def result(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = {c: F.lit(-1) for c in ("family", "index", "n", "digest", "salt", "part", "block", "proof", "leaf", "subroot", "row", "root")}
    frame.withColumns(clash).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.query(spark, str(tmp_path)).collect()]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("n", [0, 600])
def test_against_brute_force(spark, tmp_path, n):
    rows = rows_of(n) if n else []
    got = result(spark, rows, tmp_path)
    assert order(got) == order(brute(rows))
    assert not n or 0 < sum(r[-1] for r in got) < len(got)


def test_a_single_row_and_a_single_group(spark, tmp_path):
    row = (4, None, None, None, "ABC")
    got = result(spark, [row], tmp_path)
    assert got == brute([row]) and got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 1, 33), (2, 3, 100), (3, 2, 28), (8, 1, 65), (4, 2, 257)])
def test_superblocks_of_any_size_give_the_same_tree(spark, fanout, levels, n):
    rows = [(i, "s", "en" if i < n - 3 else "x", i, f"t{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = merkle.manifest(docs, fanout=fanout, levels=levels)
    want = {r[0]: r for r in brute(rows, fanout)}
    got = found.leaves.select("doc_id", "leaf", "subroot", merkle.siblings_hash(F.col("proof")), merkle.fold(F.col("leaf"), F.col("proof")), "index", "in_group").collect()
    assert found.root == want[0][3] and len(got) == n
    assert all((r[1], r[2], r[3]) == (want[r[0]][1], want[r[0]][2], want[r[0]][4]) and r[4] == found.root for r in got)
    assert sorted(r["index"] for r in got if r["in_group"] == "en") == list(range(n - 3))
    assert {(r["lang"], r["rows"]) for r in found.subroots.collect()} == {("en", n - 3), ("x", 3)}


def test_any_change_breaks_the_proof(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("T").alias("text"))
    claims = {"gone": merkle.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.lit(None)), "moved": merkle.leaf_hash(F.col("doc_id") + 1, *[F.col(c) for c in merkle.COLUMNS[1:]])}
    found = merkle.manifest(docs, carry=claims)
    proof = F.col("proof")
    assert found.leaves.filter((merkle.fold(F.col("gone"), proof) == found.root) | (merkle.fold(F.col("moved"), proof) == found.root)).count() == 0
    assert found.leaves.filter(merkle.fold(F.col("leaf"), proof) == found.root).count() == 50
