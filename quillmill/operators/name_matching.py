"""Names found in mentions, and mentions in names, by automata over many patterns.

Patterns are dealt into parts by their number of letters, texts into slices. Each cell (part, slice) is one task: an automaton with failure links
over the part's patterns reads the slice's texts once, letter by letter, whatever the patterns have in common. Matches aren't
written down: of each text (or of each pattern) only the best one so far is kept, so a name that every mention
contains, or one letter long, costs no pairs.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the patterns of one automaton, and of the texts that one task reads, about.
PATTERN_LETTERS, TEXT_LETTERS = 4_000_000, 50_000_000
_BEST = pa.schema([("mention", pa.string()), ("name", pa.string())])


def better(name: str, than: str | None) -> bool:
    """The longer name is, and of equally long ones the first."""
    return than is None or (-len(name), name) < (-len(than), than)


def _matched(names_are_patterns: bool):
    def run(patterns: pa.Table, texts: pa.Table) -> pa.Table:
        if not patterns.num_rows or not texts.num_rows:
            return _BEST.empty_table()
        automaton = ahocorasick.Automaton()
        spelled: dict[str, str] = {}
        for name, folded in zip(patterns["text"].to_pylist(), patterns["folded"].to_pylist(), strict=True):
            if folded not in spelled or (names_are_patterns and better(name, spelled[folded])):
                spelled[folded] = name
        for folded in spelled:
            automaton.add_word(folded, folded)
        automaton.make_automaton()
        best: dict[str, str] = {}
        for text, folded in zip(texts["text"].to_pylist(), texts["folded"].to_pylist(), strict=True):
            if names_are_patterns:
                for found in {f for _, f in automaton.iter(folded)}:
                    if better(spelled[found], best.get(text)):
                        best[text] = spelled[found]
            else:
                for found in {f for _, f in automaton.iter(folded)}:
                    if better(text, best.get(found)):
                        best[found] = text
        return pa.table({"mention": pa.array([*best], pa.string()), "name": pa.array([*best.values()], pa.string())})

    return run


def _cells(patterns: DataFrame, texts: DataFrame, names_are_patterns: bool) -> DataFrame:
    size = lambda f: f.agg(F.sum(F.length("folded"))).first()[0] or 0
    parts, cores = max(1, -(-size(patterns) // PATTERN_LETTERS)), patterns.sparkSession.sparkContext.defaultParallelism
    slices = max(-(-size(texts) // TEXT_LETTERS), min(cores, -(-texts.count() // 1000)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    left = patterns.withColumn("part", dealt(parts)).withColumn("slice", every(slices))
    right = texts.withColumn("slice", dealt(slices)).withColumn("part", every(parts))
    return left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(_matched(names_are_patterns), "mention string, name string")


def resolve_names(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, name): of each mention the name that equals it, else the longest that contains it or that it contains, else null;
    of equally long ones the first. Letters' case and outer blanks don't count; empty names and mentions match nothing."""
    fold = lambda c: F.lower(F.trim(c))

    def listed(frame: DataFrame, column: str) -> DataFrame:
        return frame.select(F.col(column).alias("text"), fold(F.col(column)).alias("folded")).filter("folded <> ''").distinct()

    said, known = listed(mentions, "mention"), listed(names, "name")
    exact = said.join(known.select("folded", F.col("text").alias("name")), "folded").groupBy(F.col("text").alias("mention")).agg(F.min("name").alias("exact"))
    # Mentions that are spelled alike are one pattern; what it found goes to all of them.
    alike = said.groupBy("folded").agg(F.min("text").alias("text"))
    holding = _cells(alike.select("text", "folded"), known, False).withColumnRenamed("mention", "folded")
    holding = said.join(holding, "folded").select(F.col("text").alias("mention"), "name")
    held = _cells(known, said, True)
    order: Column = F.struct(-F.length("name"), "name")
    near = held.unionByName(holding).groupBy("mention").agg(F.min_by("name", order).alias("near"))
    return mentions.select("mention").distinct().join(exact, "mention", "left").join(near, "mention", "left").select("mention", F.coalesce("exact", "near").alias("name"))
