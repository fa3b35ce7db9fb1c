import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing


def test_water_fill():
    assert mixing.water_fill([10, 10], [3, 1], 20, 2.0) == [15.0, 5.0]
    assert mixing.water_fill([2, 10], [3, 1], 18, 2.0) == [4.0, 14.0]
    assert mixing.water_fill([], [], 0, 2.0) == []
    assert sum(mixing.water_fill([5, 1, 9, 3], [3, 1, 2, 3], 27, 2.0)) == pytest.approx(27)


def test_flow_is_optimal_for_overlapping_sources():
    """Against all integer flows of a small network."""
    capacity, quotas, costs = {("a",): 2, ("a", "b"): 3, ("b",): 1}, {"a": 4, "b": 4}, [1, 3]
    flow = mixing.min_cost_flow(capacity, quotas, costs)
    got = {s: sum(n for (_, _, x), n in flow.items() if x == s) for s in quotas}
    cost = sum(costs[t] * n for (_, t, _), n in flow.items())
    best = None
    for a, ab_a, ab_b, b in itertools.product(range(5), range(7), range(7), range(3)):
        if ab_a + ab_b <= 6 and a + ab_a == 4 and b + ab_b == 4:
            price = sum(min(n, c) * 1 + max(0, n - c) * 3 for n, c in ((a, 2), (ab_a + ab_b, 3), (b, 1)))
            best = price if best is None else min(best, price)
    assert got == quotas and cost == best
    for p, t in {(p, t) for p, t, _ in flow}:
        assert sum(n for (q, u, _), n in flow.items() if (q, u) == (p, t)) <= capacity[p]


def flow_by_single_paths(capacity, quotas, costs):
    """Least cost by Bellman-Ford paths, a token at a time."""
    edges = [["S", ("s", s), n, 0] for s, n in quotas.items()]
    for p, n in capacity.items():
        edges += [[("s", s), ("p", p), 10**9, 0] for s in p] + [[("p", p), "T", n, c] for c in costs]
    edges += [[b, a, 0, -c] for a, b, _, c in edges]
    half, total, moved = len(edges) // 2, 0, 0
    while True:
        best, via = {"S": 0}, {}
        for _ in range(len(capacity) + len(quotas) + 2):
            for i, (a, b, n, c) in enumerate(edges):
                if n > 0 and a in best and best[a] + c < best.get(b, 10**9):
                    best[b], via[b] = best[a] + c, i
        if "T" not in best:
            return moved, total
        node = "T"
        while node != "S":
            i = via[node]
            edges[i][2] -= 1
            edges[(i + half) % (2 * half)][2] += 1
            node = edges[i][0]
        total, moved = total + best["T"], moved + 1


@pytest.mark.parametrize("seed", range(12))
def test_flow_against_single_paths(seed):
    rnd = random.Random(seed)
    names = "abcd"
    capacity = {tuple(sorted(rnd.sample(names, rnd.randint(1, 3)))): rnd.randint(0, 6) for _ in range(6)}
    quotas, costs = {s: rnd.randint(0, 9) for s in names}, [1, 3]
    flow = mixing.min_cost_flow(capacity, quotas, costs)
    assert (sum(flow.values()), sum(costs[t] * n for (_, t, _), n in flow.items())) == flow_by_single_paths(capacity, quotas, costs)
    for s in names:
        assert sum(n for (_, _, x), n in flow.items() if x == s) <= quotas[s]
    for p in capacity:
        for t in range(2):
            assert sum(n for (q, u, _), n in flow.items() if (q, u) == (p, t)) <= capacity[p]


def test_flow_of_many_patterns():
    rnd = random.Random(5)
    names = [f"s{i}" for i in range(40)]
    capacity = {tuple(sorted(rnd.sample(names, rnd.randint(1, 5)))): rnd.randint(1, 1000) for _ in range(50_000)}
    quotas = {s: int(0.05 * sum(capacity.values()) * (0.2 if i % 4 else 1.4)) for i, s in enumerate(names)}
    start = time.time()
    flow = mixing.min_cost_flow(capacity, quotas, [1, 3])
    assert time.time() - start < 60
    assert all(sum(n for (_, _, x), n in flow.items() if x == s) <= quotas[s] for s in names) and sum(flow.values()) > 0


def water_level(sizes, weights, total, limit):
    """Targets by bisection on the level, beside the operator's rounds."""
    low, high = 0.0, 10.0**9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(limit * n, w * level) for n, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(limit * n, w * low) for n, w in zip(sizes, weights, strict=True)]


def test_query_against_brute_force(spark, data):
    """Sizes and targets worked out beside Spark; each source's words as near its target as whole documents allow."""
    docs = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s))
    sizes = [sum(n for _, n, x in docs if x == s) for s in names]
    targets = water_level(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2.0)
    rows = {r["doc_id"]: r for r in mixing.query(spark, data).collect()}
    assert len(rows) == len(docs)
    for s, total, target in zip(names, sizes, targets, strict=True):
        mine = [(i, n) for i, n, x in docs if x == s]
        assert all((rows[i]["size"], rows[i]["source_size"]) == (n, total) and rows[i]["target"] == pytest.approx(target, abs=1) for i, n in mine)
        assert all(rows[i]["taken"] in (0, n, 2 * n) for i, n in mine)
        assert abs(sum(rows[i]["taken"] for i, _ in mine) - target) <= max(n for _, n in mine) / 2 + 1


def test_sources_come_near_their_targets(spark, data):
    rows = mixing.query(spark, data).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all() and len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    by = rows.groupby("source").agg({"taken": "sum", "target": "first", "size": "sum", "source_size": "first"})
    assert (by["size"] == by["source_size"]).all()
    assert ((by["taken"] - by["target"]).abs() <= rows.groupby("source")["size"].max() / 2 + 1).all()
    again = mixing.query(spark, data).toPandas()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_sizes_nulls_and_empty(spark, make_docs):
    docs = make_docs(["a b", None, "", " \t\n", "one\x0btwo x"], sources=["s", None, "s", "t", "t"]).withColumn("memberships", F.array("source"))
    assert {r["doc_id"]: r["size"] for r in mixing.sized(docs).collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 2}
    got = mixing.mix(docs, mixing.cycle_targets).collect()
    assert len(got) == 5 and all(r["passes"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(make_docs([]).withColumn("memberships", F.array("source")), mixing.cycle_targets).collect() == []


def test_many_buckets(spark, make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    docs = make_docs(["w " * (1 + i % 7) for i in range(900)], sources=["hot" if i % 3 else f"s{i % 4}" for i in range(900)])
    rows = mixing.mix(docs.withColumn("memberships", F.array("source")), lambda t: {s: 0.6 * n for s, n in t.items()}).toPandas()
    taken = (rows["size"] * rows["passes"]).groupby(rows["memberships"].str[0]).sum()
    assert ((taken - 0.6 * rows.groupby(rows["memberships"].str[0])["size"].sum()).abs() <= 7).all()


def test_mixed_documents_repeat_rows(spark, make_docs):
    docs = make_docs(["a b c"] * 4 + ["x y"] * 8, sources=["p"] * 4 + ["q"] * 8)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and 12 <= out.count() <= 24


def test_repeated_rows_and_clashing_names(spark, make_docs):
    """Repeated rows are taken as often as they are in all, and columns with the operator's own names stay."""
    docs = make_docs(["a b c d"] * 40 + [f"word {i} x y" for i in range(40)], [1] * 40 + list(range(100, 140)), sources=["p"] * 40 + ["q"] * 40)
    for name in ("doc", "body", "pattern", "bucket", "memberships", "mix pass", "mix each", "mix row"):
        docs = docs.withColumn(name, F.lit(name))
    out = mixing.mixed_documents(docs)
    rows = out.collect()
    assert out.columns == docs.columns and {r["mix each"] for r in rows} == {"mix each"} and {r["memberships"] for r in rows} == {"memberships"}
    taken = mixing.mix(docs.withColumn("memberships", F.array("source")), mixing.cycle_targets).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == sum(r["passes"] for r in taken if r["doc_id"] == 1)


def random_docs(make_docs, overlapping, sources=23):
    import random

    rnd = random.Random(8)
    texts = [" ".join(["w"] * rnd.randint(0, 40)) for _ in range(900)]
    docs = make_docs(texts, sources=[None if i % 29 == 0 else f"s{rnd.randint(0, 9) * rnd.randint(0, sources) % sources:02d}" for i in range(900)])
    more = F.when((F.col("doc_id") % 3 == 0) & (F.col("source") < "s12"), F.array("source", F.concat(F.lit("x"), (F.col("doc_id") % 4).cast("string")))).otherwise(F.array("source"))
    return docs.withColumn("memberships", more if overlapping else F.array("source"))


def test_targets_as_a_table(spark, make_docs):
    for sizes in ([("=a", 10), ("=b", 0), ("=c", 500), ("~", 3)], [(f"={i:03d}", (i * i * 37) % 1009) for i in range(200)], [("=a", 0)], []):
        got = {r["source"]: r["target"] for r in mixing.cycle_target_table(spark.createDataFrame(sizes, "source string, size long")).collect()}
        assert got == pytest.approx(mixing.cycle_targets(dict(sizes)))


@pytest.mark.parametrize("overlapping", [False, True])
def test_bounds_of_the_driver_change_nothing(spark, make_docs, monkeypatch, overlapping):
    """With room for two sources on the driver, targets come from tables; patterns of sources that stand alone never need the network."""
    docs = random_docs(make_docs, overlapping)
    mixed = lambda: mixing.mix_with_sources(docs, mixing.cycle_targets, target_table=mixing.cycle_target_table)
    rows, sources = mixed()
    want = sorted((r["doc_id"], r["passes"]) for r in rows.collect())
    targets = {r["source"]: r["target"] for r in sources.collect()}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    if not overlapping:
        monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    rows, sources = mixed()
    assert {r["source"]: r["target"] for r in sources.collect()} == pytest.approx(targets)
    assert sorted((r["doc_id"], r["passes"]) for r in rows.collect()) == want
    if overlapping:
        monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
        with pytest.raises(ValueError):
            mixed()


def test_flows_of_lone_sources_are_those_of_the_network(spark, make_docs):
    """Every source's flows, settled alone or by the network, against one network over all patterns."""
    docs = random_docs(make_docs, True, sources=40)
    rows = mixing.sized(docs).withColumn("pattern", F.array_sort(F.array_distinct(F.transform("memberships", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~"))))))
    grouped = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sources = mixing._sources(grouped, mixing.cycle_targets, None)
    got = {(tuple(r["pattern"]), f["tier"], f["source"]): f["tokens"] for r in mixing._flows(grouped, sources, 2).collect() for f in r["flows"] if f["tokens"]}
    capacity = {tuple(r["pattern"]): r["size"] for r in grouped.collect()}
    quotas = {r["source"]: int(round(r["target"])) for r in sources.collect()}
    want = mixing.min_cost_flow(capacity, quotas, [1, 3])
    by = lambda flow, k: {x: sum(n for key, n in flow.items() if key[k] == x) for x in {key[k] for key in flow}}
    assert by(got, 2) == by(want, 2) and by(got, 1) == by(want, 1)  # as much for each source, at the same cost
    alone = {p for p in capacity if len(p) == 1 and not any(p[0] in q for q in capacity if len(q) > 1)}
    assert alone and {k: n for k, n in got.items() if k[0] in alone} == {k: n for k, n in want.items() if k[0] in alone and n}
