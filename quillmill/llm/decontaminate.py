"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item of n words every window of n words of a document is compared with it; a document of fewer words is
one window as a whole. A fingerprint is the SimHash of the window's weighted shingles (their counts are the weights), `BITS`
bits in blocks of 8. Of two fingerprints within `RADIUS` bits at most RADIUS // (NEAR + 1) blocks can differ by more than
`NEAR` bits, so at least `AGREE` blocks differ by `NEAR` bits or fewer. For each block a table from all 256 values to the
items within `NEAR` bits is looked up and the hits are counted: every item within the radius has `AGREE` hits, none is left
out, and about one other item in a hundred has. Candidates within the radius are verified by exact weighted-shingle
similarity: sum of smaller counts over sum of larger counts.

A window that shares no shingle with an item has similarity 0 to it. So an index from shingles to sizes of items says for
which sizes, and around which places, a document is cut into windows; this leaves out no match. Documents shorter than an
item are compared exactly with all items that share a shingle and whose size lets them reach the threshold, without
fingerprints. The documents are read once for each `PART_WORDS` words of items; what a task holds is one such part.

Edge cases: null or empty texts, of documents or items, match nothing. An item with fewer than 5 words is one shingle, its
whole sequence, and matches windows with exactly these words. Equal items match alike. Rows of documents are searched each
for itself, whatever their doc_id. Ties between windows go to the earliest. Empty tables give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.storage import small_batches, tidy
from quillmill.llm.words import U, Words, chunks_of, mix, shingle_hashes

#: Bits of a fingerprint, its blocks of 8, and the radius. Windows at similarity 0.8 have a cosine of at least 8/9 to the item,
#: so a bit differs with probability 0.152 at most; the radius allows for five standard deviations over the mean of 38.8.
BITS, BLOCKS, RADIUS = 256, 32, 67
#: Bits by which a block may differ to count, and how many blocks then count at least within the radius.
NEAR = 2
AGREE = BLOCKS - RADIUS // (NEAR + 1)
#: Words of items that are searched in one pass over the documents, and windows that are fingerprinted at a time.
PART_WORDS, WINDOWS = 250_000, 4096


def _bits(shingles: np.ndarray) -> np.ndarray:
    """BITS bits of hash of each shingle, as rows of 0 and 1."""
    words = [mix(shingles ^ U(0xA24BAED4963EE407 + k)) for k in range(BITS // 64)]
    return np.unpackbits(np.stack(words, axis=1).view(np.uint8), axis=1)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a multiset of shingle hashes, a byte for each block."""
    return np.packbits(2 * _bits(shingles).sum(0, dtype=np.int64) > len(shingles))


def window_simhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of all windows of n shingles, by differences of running sums for each bit."""
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(_bits(shingles), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[n:] - sums[:-n]) > n, axis=1)


_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass
class Items:
    """The items of one size, in words."""

    words: int
    ids: list[int]
    counts: list[Counter]
    prints: np.ndarray
    of: int = 5

    @property
    def shingles(self) -> int:
        return max(1, self.words - self.width + 1)

    @property
    def width(self) -> int:
        return min(self.words, self.of)

    @cached_property
    def tables(self) -> np.ndarray:
        """block, value -> for each item whether its block is within NEAR bits of the value."""
        return (_DISTANCE[self.prints.T] <= NEAR).transpose(0, 2, 1).astype(np.uint8)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items with AGREE hits: all that are within the radius, and few others."""
        hits = np.zeros((len(prints), len(self.ids)), np.uint8)
        for b in range(BLOCKS):
            hits += self.tables[b][prints[:, b]]
        return np.nonzero(hits >= AGREE)


def _items(rows: list[tuple[int, np.ndarray]], n: int) -> list[Items]:
    """Items by size, from (id, word hashes)."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, words in rows:
        if len(words):
            by_size.setdefault(len(words), []).append((i, shingle_hashes(words, min(n, len(words)))))
    return [Items(size, [i for i, _ in group], [Counter(s.tolist()) for _, s in group], np.array([simhash(s) for _, s in group]), n) for size, group in sorted(by_size.items())]


class Index:
    """The shingles of all items of one width, and for each the sizes (as places in `groups`) that have it."""

    def __init__(self, groups: list[Items], width: int):
        pairs = [(k, np.unique(np.concatenate([np.fromiter(c, U, len(c)) for c in g.counts]))) for k, g in enumerate(groups) if g.width == width]
        shingle, group = np.concatenate([s for _, s in pairs]), np.repeat([k for k, _ in pairs], [len(s) for _, s in pairs])
        order = np.argsort(shingle, kind="stable")
        self.group = group[order]
        self.known, self.at = np.unique(shingle[order], return_index=True)
        self.at = np.append(self.at, len(order))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> U(44)).astype(np.int64)] = True

    def hits(self, rolling: np.ndarray) -> np.ndarray:
        """Places of known shingles."""
        maybe = np.flatnonzero(self.filter[(rolling >> U(44)).astype(np.int64)])
        return maybe[np.isin(rolling[maybe], self.known)]

    def by_group(self, shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each size that has some of these known shingles, with the positions of those."""
        slot = np.searchsorted(self.known, shingles)
        size = self.at[slot + 1] - self.at[slot]
        which = np.repeat(np.arange(len(shingles)), size)
        group = self.group[np.arange(int(size.sum())) + np.repeat(self.at[slot] - (np.cumsum(size) - size), size)]
        order = np.argsort(group, kind="stable")
        found, first = np.unique(group[order], return_index=True)
        yield from zip(found.tolist(), np.split(which[order], first[1:]), strict=True)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of smaller counts over sum of larger counts."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _stretches(seeds: np.ndarray, reach: int, end: int) -> list[tuple[int, int]]:
    """Ranges of shingle positions within `reach` of a seed, merged, within 0:end."""
    if not len(seeds):
        return []
    cuts = np.flatnonzero(np.diff(seeds) > 2 * reach) + 1
    return [(max(0, int(g[0]) - reach), min(end, int(g[-1]) + reach + 1)) for g in np.split(seeds, cuts)]


class Whole:
    """Similarities of a whole document to the items of one size, from the items' shingles in order."""

    def __init__(self, g: Items):
        self.ids, self.total = g.ids, g.shingles
        shingles = np.concatenate([np.fromiter(c, U, len(c)) for c in g.counts])
        counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in g.counts])
        item = np.repeat(np.arange(len(g.ids)), [len(c) for c in g.counts])
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.counts, self.item = shingles[order], counts[order], item[order]

    def matches(self, body: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        mine, n = np.unique(body, return_counts=True)
        low, high = np.searchsorted(self.shingles, mine), np.searchsorted(self.shingles, mine, side="right")
        size = high - low
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        items, which = np.unique(self.item[at], return_inverse=True)
        both = np.bincount(which, np.minimum(self.counts[at], np.repeat(n, size)), len(items))
        similarity = both / (len(body) + self.total - both)
        for k in np.flatnonzero(similarity >= threshold):
            yield self.ids[items[k]], 0, float(similarity[k])


def _found(groups: list[Items], indexes: dict[int, Index], wholes: dict[int, Whole], texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, place, similarity) of each window at or over the threshold."""
    words = Words(texts)
    hashes = words.hashes()
    for w, index in indexes.items():
        rolling = shingle_hashes(hashes, w)
        hits = index.hits(rolling)
        doc = np.searchsorted(words.of_doc, hits, side="right") - 1
        inside = hits + w <= words.of_doc[doc + 1]
        hits, doc = hits[inside], doc[inside]
        if not len(hits):
            continue
        docs, first = np.unique(doc, return_index=True)
        for d, places in zip(docs.tolist(), np.split(hits, first[1:]), strict=True):
            a, b = int(words.of_doc[d]), int(words.of_doc[d + 1])
            body = rolling[a : b - w + 1]
            for k, mine in index.by_group(rolling[places]):
                g = groups[k]
                if g.words > b - a:
                    if len(body) / g.shingles >= threshold:
                        if k not in wholes:
                            wholes[k] = Whole(g)
                        yield from ((d, *x) for x in wholes[k].matches(body, threshold))
                    continue
                for low, high in _stretches(places[mine] - a, g.shingles - 1, len(body)):
                    for at in range(low, high - g.shingles + 1, WINDOWS):
                        yield from ((d, *x) for x in _windows(g, body[at : min(high, at + WINDOWS + g.shingles - 1)], at, threshold))


def _search(groups: list[Items], threshold: float, clean: bool = False):
    """For each document and item with a window at or over the threshold: the best window's place and similarity, and how
    many windows. Or, with `clean`, the rows without any."""
    indexes = {w: Index(groups, w) for w in sorted({g.width for g in groups})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wholes: dict[int, Whole] = {}
        for batch in chunks_of(batches):
            rows = _found(groups, indexes, wholes, batch.column("text"), threshold)
            if clean:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in rows]] = False
                yield batch.filter(pa.array(keep))
                continue
            best: dict[tuple[int, int], list] = {}
            for d, item, place, similarity in rows:
                x = best.setdefault((d, item), [similarity, place, 0])
                x[2] += 1
                if similarity > x[0] or (similarity == x[0] and place < x[1]):
                    x[:2] = similarity, place
            keys = list(best)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())),
                "item_id": pa.array([k[1] for k in keys], pa.int64()),
                "similarity": pa.array([best[k][0] for k in keys], pa.float64()),
                "first_word": pa.array([best[k][1] for k in keys], pa.int64()),
                "n_windows": pa.array([best[k][2] for k in keys], pa.int64()),
            })

    return run


def _windows(g: Items, body: np.ndarray, low: int, threshold: float) -> Iterator[tuple[int, int, float]]:
    prints = window_simhashes(body, g.shingles)
    at, which = g.candidates(prints)
    near = np.bitwise_count(prints[at] ^ g.prints[which]).sum(1) <= RADIUS
    window, last = None, -1
    for p, k in zip(at[near], which[near], strict=True):
        if p != last:
            window, last = Counter(body[p : p + g.shingles].tolist()), p
        similarity = weighted_similarity(window, g.counts[k])
        if similarity >= threshold:
            yield g.ids[k], low + int(p), similarity


def _parts(benchmark: DataFrame, n: int) -> Iterator[list[Items]]:
    """The benchmark's items by size, in parts of about PART_WORDS words."""
    small_batches(benchmark.sparkSession)
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    parts = max(1, -(-words // PART_WORDS))
    for k in range(parts):
        listed = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        found = Words(pa.array([r["text"] for r in listed], pa.string()))
        hashes = found.hashes()
        yield _items([(r["item_id"], hashes[a:b]) for r, a, b in zip(listed, found.of_doc[:-1], found.of_doc[1:], strict=True)], n)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), first_word (its place) and n_windows at or over the threshold."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [slim.mapInArrow(tidy(_search(groups, threshold)), "doc_id long, item_id long, similarity double, first_word long, n_windows long") for groups in _parts(benchmark, n)]
    return functools.reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The documents without a window that matches an item. Each row is judged by its own text, whatever its doc_id."""
    for groups in _parts(benchmark, n):
        if groups:
            docs = docs.mapInArrow(tidy(_search(groups, threshold, clean=True)), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
