"""A Merkle manifest of a dataset, by superblock reduction.

A row's leaf is the SHA-256 of its columns. Leaves are numbered within their group (the language); `fanout` consecutive
nodes make their parent, until a group has one node, its subroot; subroots in the order of groups make the root in the same
way. A level is never shuffled by itself: a superblock is the `fanout ** levels` nodes whose indices have the same quotient,
and one task of applyInPandas folds all its levels; the roots of superblocks are the nodes of the next, much smaller table.
A proof is the part within the row's superblock (lower) followed by that of the superblock's root (upper), so proofs come
back in one pass down over the same superblocks.

Texts are hashed where they are read and never move. Numbering takes no window over a whole group: rows are range-partitioned
by group, order and a salt that tells copies apart, partitions are counted, and a row's index is the count of its group before its partition
plus its place there. A superblock has at most `fanout ** levels` rows, so a group of any size spreads over tasks.

Edge cases: nulls are hashed as nulls and order first; a null group is a group of its own, the first one. Repeated rows are
leaves each; rows that share the ordering key are ordered by leaf, so that the root doesn't depend on their order. A single
leaf is its group's subroot, a single subroot is the root, and their proofs have no steps. Without rows there is no root.
Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.storage import cut, keep

#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels that a task folds at once.
FANOUT, LEVELS = 8, 3

_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
_STEPS_DDL = "array<struct<place int, siblings array<string>>>"


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the values, each as its number of bytes, a colon and its text, or - for null."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(node: Column, at: Column) -> Column:
        left, right = F.slice(at["siblings"], F.lit(1), at["place"]), F.slice(at["siblings"], at["place"] + 1, F.size(at["siblings"]))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")).cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def siblings_hash(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf's level to the root's, each level from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "").cast("binary"), 256)


def depth(nodes: int, fanout: int) -> int:
    """Levels from so many nodes to one."""
    found = 0
    while nodes > 1:
        nodes, found = -(-nodes // fanout), found + 1
    return found


def folded(digests: Sequence[str], levels: int, fanout: int) -> list[list[str]]:
    """The digests of a superblock and of each of `levels` levels above them."""
    out = [list(digests)]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add `index`, gapless within the group from 0 in the order given, and `n`, the group's rows. The group is never null."""
    salted = keep(rows.withColumn("salt", F.monotonically_increasing_id()))
    dealt = cut(salted.repartitionByRange(group, *order, "salt").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    place = F.row_number().over(Window.partitionBy("part", group).orderBy(*[F.asc_nulls_first(c) for c in order], "salt")) - 1
    return dealt.withColumn("place", place).join(offsets, [group, "part"]).withColumn("index", F.col("offset") + F.col("place")).drop("salt", "part", "offset", "place")


@dataclass
class Tree:
    """The levels of superblocks, lowest first; the last has one node a family, the root of it. Columns: family, index, n, digest."""

    tables: list[DataFrame]
    fanout: int
    levels: int

    @property
    def size(self) -> int:
        return self.fanout**self.levels

    def roots(self) -> DataFrame:
        return self.tables[-1].select("family", F.col("digest").alias("root"))

    def proofs(self, above: DataFrame) -> DataFrame:
        """The lowest table with `proof`, whose upper end is the family's proof in `above` (family, index 0, proof, more)."""
        handed = above.columns
        for table in reversed(self.tables[:-1]):
            above = _proved(table, above.select(handed), self.fanout, self.levels)
        if len(self.tables) == 1:  # one node a family
            return self.tables[0].join(above.drop("index"), "family")
        return above


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Tree:
    """Fold superblock by superblock until each family has one node. `nodes`: family, index, n, digest, and more."""
    size = fanout**levels

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        n = int(pdf["n"].iloc[0])
        top = folded(pdf["digest"].tolist(), min(levels, depth(n, fanout)), fanout)[-1]
        return pd.DataFrame({"family": pdf["family"].iloc[:1], "index": pdf["index"].iloc[:1] // size, "n": [-(-n // size)], "digest": top})

    tables = [nodes]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        slim = tables[-1].select("family", "index", "n", "digest", F.floor(F.col("index") / size).alias("block"))
        tables.append(cut(slim.groupBy("family", "block").applyInPandas(collapse, "family string, index long, n long, digest string")))
    return Tree(tables, fanout, levels)


def _proved(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes with their whole proofs: lower part from their superblock, upper part and all other columns from `above`."""
    size = fanout**levels
    more = [c for c in above.columns if c not in ("family", "index", "proof")]
    shape = nodes.select(*nodes.columns, *[F.lit(None).cast(above.schema[c].dataType).alias(c) for c in more], F.lit(None).cast(_STEPS_DDL).alias("proof")).schema

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("index").drop_columns(["block"])
        places, n = left["index"].to_pylist(), left["n"][0].as_py()
        rows = folded(left["digest"].to_pylist(), min(levels, depth(n, fanout)), fanout)[:-1]
        upper, proofs = right["proof"][0].as_py(), []
        for at in (i % size for i in places):
            steps = []
            for row in rows:
                run = row[at // fanout * fanout : at // fanout * fanout + fanout]
                place = at % fanout
                steps.append({"place": place, "siblings": run[:place] + run[place + 1 :]})
                at //= fanout
            proofs.append(steps + upper)
        for name in more:
            left = left.append_column(name, pa.array([right[name][0].as_py()] * len(places), right.schema.field(name).type))
        return left.append_column("proof", pa.array(proofs, _STEPS))

    blocks = nodes.withColumn("block", F.floor(F.col("index") / size)).groupBy("family", "block")
    return blocks.cogroup(above.withColumnRenamed("index", "block").groupBy("family", "block")).applyInArrow(prove, shape)


@dataclass
class Manifest:
    """The root (null without rows), the subroots (group, rows, subroot), and each row's leaf, index and proof from there to the root."""

    root: str | None
    subroots: DataFrame
    leaves: DataFrame


def manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS
) -> Manifest:
    """The tree of `docs`. `leaves` has key (under its name), leaf, subroot, index, proof, and what `carry` computes from a row.

    Leaves ascend by `key` within a group, groups by name (UTF-8 bytes, null first).
    """
    names = {k: f"carried{i}" for i, k in enumerate(carry or {})}
    family = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null, in the order of groups
    rows = docs.select(family.alias("family"), F.col(key).alias("row"), leaf_hash(*[F.col(c) for c in columns]).alias("digest"), *[v.alias(names[k]) for k, v in (carry or {}).items()])
    lower = reduced(cut(numbered(rows, "family", ["row", "digest"])), fanout, levels)
    tops = lower.roots().withColumnsRenamed({"family": "name", "root": "digest"}).withColumn("family", F.lit("all"))
    upper = reduced(cut(numbered(tops, "family", ["name"])), fanout, levels)
    top = upper.roots().first()
    start = upper.tables[-1].select("family", "index", F.lit(None).cast(_STEPS_DDL).alias("proof")).withColumn("proof", F.coalesce("proof", F.array().cast(_STEPS_DDL)))
    above = upper.proofs(start).select(F.col("name").alias("family"), F.lit(0).cast("long").alias("index"), F.col("digest").alias("subroot"), "proof")
    above = cut(above)
    named = F.when(F.col("family") != "", F.substring("family", 2, 1 << 30))
    leaves = lower.proofs(above).select(
        F.col("row").alias(key), named.alias("in_group"), "index", F.col("digest").alias("leaf"), "subroot", "proof", *[F.col(v).alias(k) for k, v in names.items()]
    )
    subroots = above.join(lower.tables[0].groupBy("family").agg(F.count("*").alias("rows")), "family").select(named.alias(group), "rows", "subroot")
    return Manifest(top["root"] if top else None, subroots, leaves)


def query(spark, sf_dir: str) -> DataFrame:
    """Each row's proof; rows whose id has a CRC-32 that 3 divides are verified with their text's A-Z in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen, leaf_hash(*[F.col(c) for c in COLUMNS[:-1]], lower))
    found = manifest(docs, carry={"tampered": tampered})
    root = F.lit(found.root).cast("string")
    out = found.leaves.select("doc_id", "leaf", "subroot", root.alias("root"), siblings_hash(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
