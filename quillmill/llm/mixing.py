"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the sorted set of a document's
sources); only these aggregates reach the driver. A flow network routes each pattern's tokens to its sources' quotas;
the first pass over a pattern costs little and each repetition more (convex), so that a document is repeated only where
a quota can't be met otherwise. The flows are then carried out on seeded documents: a hash puts each pattern's documents
into an order, and each flow takes a stretch of it. Stretches are found by running sums over hash buckets of about
`BUCKET` documents; only the few buckets that a stretch's end falls into are walked document by document.

Edge cases: a null source is a source of its own, last in order. Null or empty text has size 0 and is taken 0 words.
Repeated rows are rows of their own, and rows without any difference are interchangeable. An empty table gives an empty
result. Ties in the seeded order are broken by doc_id and the text's hash. Columns other than those named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.merkle import numbered
from quillmill.llm.storage import cut, free_name, keep, tidy
from quillmill.llm.words import Words, chunks_of

#: Documents a bucket, about.
BUCKET = 4096
#: The weights that sources take in turn, in code point order.
CYCLE = (3, 1, 2)
#: Sources and patterns that are worked out on the driver, and broadcast. Beyond that tables take their place; only patterns that share
#: sources with others need the flow network, and more of these are refused with an error.
MAX_SOURCES, MAX_PATTERNS = 10_000, 200_000


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Share `total` by weight; no share exceeds `limit` times its size, and the excess is shared again."""
    shares, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        unit = left / (sum(weights[i] for i in free) or 1)
        over = [i for i in free if weights[i] * unit > limit * sizes[i]]
        if not over:
            for i in free:
                shares[i] = weights[i] * unit
            break
        for i in over:
            shares[i] = float(limit * sizes[i])
            left -= shares[i]
            free.discard(i)
    return shares


class _Network:
    """Sources, patterns and what each pattern gives to its sources; `room` is what a pattern can still give."""

    def __init__(self, patterns: list[tuple], need: dict):
        self.sources = sorted(need, key=str)
        number = {s: i for i, s in enumerate(self.sources)}
        self.need = [need[s] for s in self.sources]
        self.members = [[number[s] for s in p] for p in patterns]
        self.given = [[0] * len(p) for p in patterns]
        self.room = [0] * len(patterns)
        self.of_source: list[list[tuple[int, int]]] = [[] for _ in self.sources]
        for p, members in enumerate(self.members):
            for j, s in enumerate(members):
                self.of_source[s].append((p, j))

    def _layers(self) -> tuple[list[int], list[int], bool]:
        """Distances from sources with unmet quota, over patterns, back over what these give to other sources."""
        source, pattern = [-1] * len(self.need), [-1] * len(self.room)
        front = [s for s, n in enumerate(self.need) if n > 0]
        for s in front:
            source[s] = 0
        depth, reached = 0, False
        while front and not reached:
            met = []
            for s in front:
                for p, _ in self.of_source[s]:
                    if pattern[p] < 0:
                        pattern[p] = depth
                        met.append(p)
                        reached = reached or self.room[p] > 0
            depth, front = depth + 1, []
            for p in met:
                for k, s in enumerate(self.members[p]):
                    if source[s] < 0 and self.given[p][k] > 0:
                        source[s] = depth
                        front.append(s)
        return source, pattern, reached

    def _push(self, first: int, source: list[int], pattern: list[int], at_source: list[int], at_pattern: list[int]) -> bool:
        """Route tokens along one path of rising layers from a source; False if there is none left."""
        path: list[tuple[int, int, int, int]] = []  # source, pattern, the source's place in it, the place that it takes from
        s = first
        while True:
            if at_source[s] == len(self.of_source[s]):
                if not path:
                    return False
                s, p, _, _ = path.pop()
                at_pattern[p] += 1
                continue
            p, j = self.of_source[s][at_source[s]]
            if pattern[p] != source[s]:
                at_source[s] += 1
                continue
            if self.room[p] > 0:
                amount = min([self.need[first], self.room[p], *(self.given[q][k] for _, q, _, k in path)])
                for _, q, i, k in path:
                    self.given[q][i] += amount
                    self.given[q][k] -= amount
                self.given[p][j] += amount
                self.room[p] -= amount
                self.need[first] -= amount
                return True
            members, given = self.members[p], self.given[p]
            k = at_pattern[p]
            while k < len(members) and not (given[k] > 0 and source[members[k]] == source[s] + 1):
                k += 1
            at_pattern[p] = k
            if k == len(members):
                at_source[s] += 1
            else:
                path.append((s, p, j, k))
                s = members[k]

    def saturate(self) -> None:
        """Meet as much of the quotas as the room allows: blocking flows over layers (Dinic)."""
        while True:
            source, pattern, reached = self._layers()
            if not reached:
                return
            at_source, at_pattern = [0] * len(self.need), [0] * len(self.room)
            for s, depth in enumerate(source):
                while depth == 0 and self.need[s] > 0 and self._push(s, source, pattern, at_source, at_pattern):
                    pass


def min_cost_flow(capacity: dict[tuple, int], quotas: dict, costs: Sequence[int]) -> dict[tuple, int]:
    """Route patterns' tokens to sources: {(pattern, tier, source): tokens}.

    capacity[pattern] tokens flow through each tier at costs[tier], which rise; a pattern is a tuple of sources. Costs sit on
    the tiers alone and are the same for all patterns, so the shortest augmenting paths are first those that end in the first
    tier, then those that end in the second, and so on: a largest flow with the first tier's room, raised to a largest flow
    with the next tier's room added, and so on, is a flow of least cost.
    """
    patterns = sorted(capacity, key=str)
    network = _Network(patterns, quotas)
    for _ in costs:
        for i, p in enumerate(patterns):
            network.room[i] += capacity[p]
        network.saturate()
    flow: dict[tuple, int] = {}
    for i, p in enumerate(patterns):  # a pattern's tiers fill in order; its sources share them in order
        tier, room = 0, capacity[p]
        for s, n in zip(p, network.given[i], strict=True):
            while n:
                if not room:
                    tier, room = tier + 1, capacity[p]
                part = min(n, room)
                flow[(p, tier, s)] = part
                n, room = n - part, room - part
    return flow


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of `docs` without its text, with `size`, its number of words, and `body`, its text's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, "text"):
            rest = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(rest | {"size": pa.array(Words(batch.column("text")).counts().astype(np.int64))})

    kept = docs.select(F.col(key).cast("long").alias("doc_id"), "memberships", F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    return kept.mapInArrow(tidy(count), "doc_id long, memberships array<string>, body long, size long")


def _walk(pdf: pd.DataFrame, repeats: int) -> pd.DataFrame:
    """Carry out the stretches that meet in one bucket, document by document: each takes what still fits into its quota."""
    pdf = pdf.sort_values(["place", "doc_id", "body"], kind="stable", na_position="last").reset_index(drop=True)
    size = pdf["size"].to_numpy()
    passes = np.zeros(len(pdf), np.int64)
    by_source: list[list[tuple]] = [[] for _ in range(len(pdf))]
    for tier in range(repeats):
        free = np.ones(len(pdf), bool)
        for source, quota in [(x["source"], x["quota"]) for x in pdf["stretches"].iloc[0] if x["tier"] == tier]:
            left, best = quota, None
            for i in np.flatnonzero(free & (size > 0)):
                if size[i] <= left:
                    left -= size[i]
                    free[i] = False
                    passes[i] += 1
                    by_source[i].append((source, tier))
                elif best is None or size[i] < size[best]:
                    best = i
            if best is not None and free[best] and size[best] - left < left:  # one more comes nearer than none
                free[best] = False
                passes[best] += 1
                by_source[best].append((source, tier))
    pdf["passes"] = passes
    return pdf[["doc_id", "memberships", "body", "size", "passes"]]


class Mixed(NamedTuple):
    """rows: doc_id, memberships, body, size, passes. sources: source (null as ~, others after =), size, target."""

    rows: DataFrame
    sources: DataFrame


def _sources(grouped: DataFrame, targets, target_table) -> DataFrame:
    """source, size and target of each source."""
    totals = grouped.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    listed = totals.limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES and target_table is not None:
        return keep(target_table(totals))
    if len(listed) > MAX_SOURCES:
        listed = totals.collect()  # for a function of one's own, which is given all totals
    wanted = targets({r["source"]: r["size"] for r in sorted(listed, key=lambda r: r["source"])})
    return grouped.sparkSession.createDataFrame([(r["source"], int(r["size"]), float(wanted[r["source"]])) for r in listed], "source string, size long, target double")


def _flows(grouped: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """pattern, rows and flows (tier, source, tokens) of each pattern.

    A source that is in no pattern with another one has a pattern to itself: its quota fills the tiers in turn, which needs
    no network. Patterns of the other sources make the network.
    """
    spark, struct = grouped.sparkSession, "array<struct<tier int, source string, tokens long>>"
    linked = grouped.filter(F.size("pattern") > 1).select(F.explode("pattern").alias("source")).distinct()
    shared = grouped.select("pattern", F.explode("pattern").alias("source")).join(linked, "source", "left_semi").select("pattern").distinct()
    tangled = keep(grouped.join(shared, "pattern", "left_semi"))
    found = tangled.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns that share sources")
    quota = F.bround(F.coalesce("target", F.lit(0.0)), 0).cast("long")
    own = [F.struct(F.lit(t).alias("tier"), F.get("pattern", F.lit(0)).alias("source"), F.least(F.greatest(quota - t * F.col("size"), F.lit(0)), F.col("size")).alias("tokens")) for t in range(repeats)]
    alone = grouped.join(shared, "pattern", "left_anti") if found else grouped
    alone = alone.join(sources.select("source", "target"), F.get("pattern", F.lit(0)) == F.col("source"), "left").select("pattern", "rows", F.array(*own).cast(struct).alias("flows"))
    if not found:
        return alone
    capacity = {tuple(r["pattern"]): int(r["size"]) for r in found}
    quotas = {r["source"]: int(round(r["target"])) for r in sources.join(F.broadcast(linked), "source", "left_semi").collect()}  # no more than their patterns
    flow = min_cost_flow(capacity, quotas, [1 + 2 * t for t in range(repeats)])
    plan = [([*r["pattern"]], r["rows"], [(t, s, flow.get((tuple(r["pattern"]), t, s), 0)) for t in range(repeats) for s in r["pattern"]]) for r in found]
    return alone.unionByName(spark.createDataFrame(plan, f"pattern array<string>, rows long, flows {struct}"))


def mix(docs: DataFrame, targets, repeats: int = 2, seed: int = 20240501, key: str = "doc_id", text: str = "text", target_table=None) -> DataFrame:
    """doc_id, memberships, body, size and `passes`, how many times the mix takes the document (0 to `repeats`).

    `docs` has a column `memberships`, an array of sources. `targets` maps sources' sizes to tokens wanted; `target_table` does
    so as a table (source, size to source, size, target), for more than `MAX_SOURCES` sources.
    """
    return mix_with_sources(docs, targets, repeats, seed, key, text, target_table).rows


def mix_with_sources(docs: DataFrame, targets, repeats: int = 2, seed: int = 20240501, key: str = "doc_id", text: str = "text", target_table=None) -> Mixed:
    """As `mix`, and the sources with their targets."""
    rows = cut(sized(docs, key, text))
    pattern = F.array_sort(F.array_distinct(F.transform("memberships", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~")))))
    rows = rows.withColumn("pattern", pattern)
    grouped = keep(rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    sources = _sources(grouped, targets, target_table)
    few = grouped.count() <= MAX_PATTERNS
    hint = F.broadcast if few else (lambda frame: frame)
    plan = keep(_flows(grouped, sources, repeats)).select("pattern", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") / BUCKET)).alias("buckets"), "flows")
    place: Column = F.xxhash64(F.lit(seed), "doc_id", "body")
    rows = rows.join(hint(plan.select("pattern", "buckets")), "pattern").withColumn("place", place)
    rows = rows.withColumn("bucket", F.pmod("place", "buckets"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("tokens")).withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    # Each flow takes a stretch of its tier's tokens; what of it lies in a bucket is the bucket's quota.
    flow_end = Window.partitionBy("pattern", "tier").orderBy("source")
    stretches = plan.select("pattern", F.inline("flows")).withColumn("to", F.sum("tokens").over(flow_end)).withColumn("from", F.col("to") - F.col("tokens"))
    stretches = stretches.filter("tokens > 0").groupBy("pattern").agg(F.collect_list(F.struct("tier", "source", "from", "to")).alias("all"))
    quota = lambda x: F.greatest(F.lit(0), F.least(x["to"], F.col("start") + F.col("tokens")) - F.greatest(x["from"], F.col("start")))
    parts = spans.join(hint(stretches), "pattern", "left").select(
        "pattern",
        "bucket",
        "tokens",
        F.array_sort(F.filter(F.transform("all", lambda x: F.struct(x["tier"].alias("tier"), x["source"].alias("source"), quota(x).alias("quota"))), lambda x: x["quota"] > 0)).alias("stretches"),
    )
    whole = F.coalesce(F.size(F.filter("stretches", lambda x: x["quota"] == F.col("tokens"))), F.lit(0))
    parts = parts.withColumn("whole", whole).withColumn("walk", F.coalesce(F.size("stretches") > whole, F.lit(False)))
    rows = rows.join(parts, ["pattern", "bucket"])
    easy = rows.filter("not walk").select("doc_id", "memberships", "body", "size", F.when(F.col("size") > 0, F.greatest("whole", F.lit(0))).otherwise(0).cast("long").alias("passes"))
    walked = rows.filter("walk").select("pattern", "bucket", "stretches", "place", "doc_id", "memberships", "body", "size")
    walked = walked.groupBy("pattern", "bucket").applyInPandas(lambda pdf: _walk(pdf, repeats), easy.schema)
    return Mixed(easy.unionByName(walked), sources)


def cycle_targets(totals: dict[str, int], share: float = 1.5, limit: float = 2.0) -> dict[str, float]:
    """Sources in order take the weights of CYCLE in turn and share `share` of all tokens, each at most `limit` times its own."""
    names = sorted(totals, key=lambda s: (s == "~", s))  # UTF-8 and code points order alike
    weights = [CYCLE[i % len(CYCLE)] for i in range(len(names))]
    return dict(zip(names, water_fill([totals[s] for s in names], weights, share * sum(totals.values()), limit), strict=True))


def cycle_target_table(totals: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """`cycle_targets` as a table, for any number of sources: source, size, target.

    What a source takes a unit of weight is the same for all that are not at their limit, and rises as more are; each round
    is one sum over the table, until no more sources reach their limit.
    """
    ordered = numbered(totals.select(F.lit("all").alias("whole"), (F.col("source") == "~").cast("int").alias("last"), "source", "size"), "whole", ["last", "source"])
    rows = keep(ordered.select("source", "size", F.get(F.array(*[F.lit(float(w)) for w in CYCLE]), (F.col("index") % len(CYCLE)).cast("int")).alias("weight")))
    whole = rows.agg(F.sum("size"), F.sum("weight")).first()
    unit, at_limit = share * (whole[0] or 0) / (whole[1] or 1), -1
    while True:
        over = F.col("weight") * unit > limit * F.col("size")
        n, taken, weight = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, limit * F.col("size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == at_limit:
            return rows.select("source", "size", F.when(over, limit * F.col("size")).otherwise(F.col("weight") * unit).alias("target"))
        at_limit, unit = n, (share * whole[0] - taken) / weight if weight else unit


def cell_targets(totals: dict[str, int]) -> dict[str, float]:
    """Targets of cells, parts of sources whose names are JSON objects with `source`: a source's target by `cycle_targets`, dealt over its cells by their sizes."""
    source_of = {cell: "~" if (s := json.loads(cell[1:]).get("source")) is None else f"={s}" for cell in totals}
    sizes = dict.fromkeys(source_of.values(), 0)
    for cell, size in totals.items():
        sizes[source_of[cell]] += size
    wanted = cycle_targets(sizes)
    return {cell: wanted[source_of[cell]] * size / max(1, sizes[source_of[cell]]) for cell, size in totals.items()}


def cell_target_table(totals: DataFrame) -> DataFrame:
    """`cell_targets` as a table, for any number of cells: source, size, target."""
    name = F.from_json(F.expr("substring(source, 2)"), "source string")["source"]
    cells = totals.withColumn("of", F.coalesce(F.concat(F.lit("="), name), F.lit("~")))
    sources = cycle_target_table(cells.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("size")))
    wanted = sources.select(F.col("source").alias("of"), F.col("size").alias("whole"), "target")
    return cells.join(wanted, "of").select("source", "size", (F.col("target") * F.col("size") / F.greatest(F.lit(1), "whole")).alias("target"))


def mixed_documents(docs: DataFrame, within: str | None = None) -> DataFrame:
    """The rows of `docs`, each as often as the mix of its sources takes it. Rows alike in all columns are taken as often as
    all of them together, as copies of one of them. With `within`, a column, its values keep their shares of each source."""
    row, body, passes, alike, each = (free_name(docs, f"mix {x}") for x in ("row", "body", "passes", "alike", "each"))
    keys = {row: F.xxhash64(*docs.columns), body: F.xxhash64("text")}
    cell = F.to_json(F.struct(F.col("source").cast("string").alias("source"), F.col(within).alias("within"))) if within else F.col("source")
    slim = docs.select(keys[row].alias("doc_id"), F.array(cell).alias("memberships"), "text")
    targets, target_table = (cell_targets, cell_target_table) if within else (cycle_targets, cycle_target_table)
    taken = mix(slim, targets, target_table=target_table).groupBy(F.col("doc_id").alias(row), F.col("body").alias(body))
    taken = taken.agg(F.sum("passes").alias(passes), F.count("*").alias(alike)).filter(F.col(passes) > 0)
    keyed = docs.select("*", *[v.alias(k) for k, v in keys.items()])

    def copies(rows: DataFrame) -> DataFrame:
        return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(passes))).alias(each)).drop(each)

    once = copies(keyed.join(taken.filter(F.col(alike) == 1), [*keys]))
    repeated = keep(taken.filter(F.col(alike) > 1))
    if repeated.isEmpty():
        return once
    return once.unionByName(copies(keyed.join(repeated, [*keys]).dropDuplicates([*keys])))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("memberships", F.array("source"))
    rows, sources = mix_with_sources(docs, cycle_targets, target_table=cycle_target_table)
    about = sources.select(F.col("source").alias("name"), F.col("size").alias("source_size"), "target")
    name = F.coalesce(F.concat(F.lit("="), F.col("memberships")[0]), F.lit("~"))
    return rows.join(about, name == F.col("name")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), F.col("memberships")[0].alias("source"))
