"""Near-duplicate documents by MinHash with fast similarity sketching.

A document is its set of distinct n-word shingles. The sketch has K coordinates. In round i each shingle is thrown, by
hashes of its own for that round, into one coordinate with a value that begins with i; a coordinate keeps the smallest
value it gets. Rounds go on until every coordinate is filled, and after K rounds of random places round K + j is put into
coordinate j, so filling is guaranteed. Two documents agree in a coordinate with probability equal to their Jaccard
similarity, and the number of agreements is concentrated as for K independent throws.

Stages: (1) one pass over the texts makes set size, set digest and sketch; (2) documents with equal sets form a class, named
by a number of its own, with one document that stands for its set; (3) the sketches' bands put representatives into buckets, each bucket links its members to its
smallest one as candidates, and candidates are verified on full sets; (4) components of verified links; (5) in buckets
that still hold several components, sketches across components are compared in blocks, and the likely pairs are verified
there too, so that no link between components that share a bucket is lost; (6) components again.
With 24 bands of 5 coordinates a pair at similarity 0.85 shares no bucket with a probability below 1e-6 (at 0.8: 1e-4).

Nothing is emitted for all pairs of a group: stage 3 is linear in the buckets' sizes, stage 5 looks only at buckets that
are not one component, and copies of a set take no part at all.

Edge cases: a text without words, or a null text, has an empty set and is linked with nothing. A text with fewer than n
words is one shingle, its whole sequence. Rows with equal doc_id and different texts are linked by each of their texts,
and each row has the component of its own text. A row with a null doc_id is linked like any other and never names a component
that has another doc_id; where none has one, the component is null and all its rows are kept. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.llm.storage import cut, keep, tidy
from quillmill.llm.words import U, Words, chunks_of, document_shingles, mix, shingle_hashes

BANDS, ROWS = 24, 5
#: Coordinates of a sketch; the first BANDS * ROWS are banded, all are compared (a byte of each).
K = 480
#: Rows of a block of sketches that are compared with another block.
BLOCK = 1024
#: Hashed throws that are worked out at a time.
THROWS = 4096
#: Members of a hot candidate group that one task verifies.
GROUP = 2000


_SEEDS = np.arange(1, 2 * K + 1, dtype=U) * U(0x9E3779B97F4A7C15)


def fast_sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """K coordinates (uint64: round in the upper half, hash in the lower) of a non-empty set of 64-bit shingles.

    Several rounds of a small set are thrown at a time. Rounds thrown after all coordinates are filled change nothing.
    """
    out = np.full(k, np.iinfo(np.uint64).max, U)
    at, rounds = 0, 1
    while at < k and out.max() == np.iinfo(np.uint64).max:
        these = np.arange(at, min(k, at + rounds), dtype=U)
        h = mix(shingles[None, :] + _SEEDS[at : at + len(these), None])
        value = (h & U(0xFFFFFFFF)) | (these << U(32))[:, None]
        np.minimum.at(out, ((h >> U(32)) * U(k) >> U(32)).astype(np.int64).reshape(-1), value.reshape(-1))
        at += len(these)
        rounds = max(1, THROWS // len(shingles))
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):  # round k + j is put into coordinate j
        out[j] = (mix(shingles + _SEEDS[k + j]) & U(0xFFFFFFFF)).min() | U(int(k + j) << 32)
    return out


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of a sketch."""
    parts = sketch[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        out = mix(out ^ parts[:, r] * U(0xA0761D6478BD642F))
    return out


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The sorted set of shingles of each text."""
    words = Words(batch.column("text"))
    hashes = words.hashes()
    rolling = shingle_hashes(hashes, n)
    for a, b in zip(words.of_doc[:-1], words.of_doc[1:], strict=True):
        yield np.unique(document_shingles(hashes[a:b], rolling[a:b], n))


_ROW = ["doc", "none", "body"]
_ABOUT = "doc long, none boolean, body long, n_shingles long, digest binary, bands binary, sketch binary"


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches):
            sizes, rest = [], []
            for s in _sets(batch, n):
                sizes.append(len(s))
                if len(s):
                    sketch = fast_sketch(s)
                    # Equal sets have equal digests; distinct sets differ in 128 bits of sums of mixed shingles.
                    digest = np.array([mix(s).sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U).tobytes()
                    rest.append((digest, band_hashes(sketch).tobytes(), (mix(sketch) >> U(56)).astype(np.uint8).tobytes()))
                else:
                    rest.append((None, None, None))
            named = {c: pa.array([r[i] for r in rest], pa.binary()) for i, c in enumerate(("digest", "bands", "sketch"))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in _ROW} | {"n_shingles": pa.array(sizes, pa.int64())} | named)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(hashes), "id": pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))})


def _sets_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches):
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "shingles": pa.array([s.tobytes() for s in _sets(batch, n)], pa.binary())})

    return run


def _verify(percent: int):
    """Stream groups: the pivot's set first, then the members'; emit the members linked to their pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for batch in batches:
            a, b = [], []
            for p, part, i, raw in zip(*[batch.column(c) for c in ("pivot", "part", "id", "shingles")], strict=True):
                p, part, i = p.as_py(), part.as_py(), i.as_py()
                s = np.frombuffer(raw.as_buffer(), U)
                if (p, part) != group:
                    group, pivot = (p, part), None
                if i == p:
                    pivot = s
                    continue
                if pivot is None:
                    raise ValueError(f"the set of {p} is missing")
                if 100 * min(len(s), len(pivot)) >= percent * max(len(s), len(pivot)):
                    both = len(np.intersect1d(s, pivot, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(pivot) - both):
                        a.append(p)
                        b.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (pivot, id), those with 100 * intersection >= percent * union, as links (a, b).

    A pivot's members are dealt into parts of about GROUP, each with a copy of the pivot's set.
    """
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id")
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("id"))
    rows = dealt.unionByName(heads).join(sets, "id").select("pivot", "part", "id", "shingles")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", (F.col("id") != F.col("pivot")), "id")
    return rows.mapInArrow(tidy(_verify(percent)), "a long, b long")


def _likely(a: dict, b: dict, within: bool, bucket: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a, each with the rows of b (the later ones of a itself if `within`) that are in another component and may reach
    `percent`. `bucket` is the bucket that both blocks are of.

    The agreements of a pair at the threshold have a standard deviation of sqrt(K j (1 - j)); five of these are allowed
    for. A pair is met in the first band that its sketches share, and so once in all.
    """
    j = percent / 100 + (1 - percent / 100) / 256  # bytes of different coordinates agree once in 256
    least = K * j - 5 * (K * j * (1 - j)) ** 0.5
    for i in range(len(a["id"])):
        from_ = i + 1 if within else 0
        size, other = a["size"][i], b["size"][from_:]
        may = from_ + np.flatnonzero((b["component"][from_:] != a["component"][i]) & (100 * np.minimum(size, other) >= percent * np.maximum(size, other)))
        may = may[np.count_nonzero(b["sketch"][may] == a["sketch"][i], axis=1) >= least] if len(may) else may
        if len(may):
            shared = b["bands"][may] == a["bands"][i]
            may = may[a["bands"][i][shared.argmax(1)] == bucket]
        if len(may):
            yield i, may


def _candidates(a: dict, b: dict, within: bool, bucket: int, percent: int) -> dict[str, np.ndarray]:
    """The rows that have a likely partner: side and id."""
    hit_a, hit_b = np.zeros(len(a["id"]), bool), np.zeros(len(b["id"]), bool)
    for i, may in _likely(a, b, within, bucket, percent):
        hit_a[i] = True
        (hit_a if within else hit_b)[may] = True
    ids = [a["id"][hit_a], b["id"][hit_b]]
    return {"side": np.repeat(np.array([0, 1], np.int32), [len(x) for x in ids]), "id": np.concatenate(ids)}


def _links(a: dict, b: dict, within: bool, bucket: int, percent: int) -> dict[str, np.ndarray]:
    """The likely pairs that are links, by their full sets: a and b."""
    sides = [a] if within else [a, b]
    sets = [[np.frombuffer(x, U) for x in side["shingles"]] for side in sides]
    known = np.unique(np.concatenate([s for part in sets for s in part])) if any(len(part) for part in sets) else np.empty(0, U)
    coded = [[np.searchsorted(known, s) for s in part] for part in sets]
    here, there = coded[0], coded[-1]
    mark, left, right = np.zeros(len(known), bool), [], []
    for i, may in _likely(a, b, within, bucket, percent):
        mark[here[i]] = True
        for k in may:
            both = int(np.count_nonzero(mark[there[k]]))
            if 100 * both >= percent * (len(here[i]) + len(there[k]) - both):
                left.append(a["id"][i])
                right.append(b["id"][k])
        mark[here[i]] = False
    return {"a": np.array(left, np.int64), "b": np.array(right, np.int64)}


def _across(percent: int, work, carried: tuple[str, ...]):
    """Stream blocks sorted by (bucket, x, y, side) and put `work` to each pair of them. `carried`: binary columns."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        side = table.column("side").to_numpy()
        data = {c: table.column(c).to_numpy() for c in ("id", "component", "size")}
        data["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, K)
        data["bands"] = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
        data |= {c: np.array([*table.column(c).to_pylist(), None], object)[:-1] for c in carried}
        a, b = ({c: v[side == s] for c, v in data.items()} for s in (0, 1))
        bucket, x, y = (table.column(c)[0].as_py() for c in ("bucket", "x", "y"))
        found = work(a, a if x == y else b, x == y, bucket, percent)
        n = len(next(iter(found.values())))
        where = {c: np.full(n, v, t) for c, v, t in (("bucket", bucket, np.int64), ("x", x, np.int32), ("y", y, np.int32))} if "id" in found else {}
        return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in (where | found).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # one pair of blocks: 2 * BLOCK rows, or a few more
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "x", "y")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(start, end - start)
                if held and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in ("bucket", "x", "y")):
                    yield settle(held)
                    held = []
                held.append(part)
        if held:
            yield settle(held)

    return run


def _residual_links(buckets: DataFrame, found: DataFrame, about: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within buckets that hold several. `found`: (id, component); `about`: digest and id of
    classes with a set's size, bands and sketch.

    First only sketches are compared; then the rows that have a likely partner come again, with their full sets.
    """
    members = buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("bucket", "n")
    members = cut(members.join(mixed, "bucket").select("bucket", "id", "component", "n"))
    sketches = about(members.select("id").distinct())
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # Block x meets each block y >= x: a row goes to the left of (x, y) for y >= x and to the right of (y, x) for y < x.
    members = members.select("bucket", "id", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    where = ["bucket", "x", "y", "side", "id"]
    rows = members.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("other") < F.col("block")).cast("int").alias("side"), "id", "component").join(sketches, "id")
    dealt = lambda f, *more: f.repartition("bucket", "x", "y").sortWithinPartitions(*where).select(*where, "component", "size", "bands", "sketch", *more)
    likely = cut(dealt(rows).mapInArrow(tidy(_across(percent, _candidates, ())), "bucket long, x int, y int, side int, id long"))
    again = rows.join(likely, where, "left_semi").join(sets, "id")
    return dealt(again, "shingles").mapInArrow(tidy(_across(percent, _links, ("shingles",))), "a long, b long")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The documents by doc (0 for null), none (whether the id is null), body (the text's hash), and text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("doc"), F.col(key).isNull().alias("none"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))


def _components(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """doc, none, body, n_shingles and component (a class id; null: linked with nothing) of each document."""
    rows = _rows(docs, key, text)
    about = keep(rows.mapInArrow(tidy(_sketches(n)), _ABOUT))
    filled = about.filter("digest is not null")
    stands = filled.groupBy("digest").agg(F.min(F.struct("none", "doc", "body")).alias("row"), F.min("bands").alias("bands"))
    classes = keep(stands.select("digest", "row.*", "bands").withColumn("id", F.monotonically_increasing_id()))
    bands = keep(classes.select("id", "bands").mapInArrow(tidy(_bands), "bucket long, id long"))
    shared = bands.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("bucket", "pivot")
    inside = keep(bands.join(shared, "bucket").select("bucket", "pivot", "id"))
    pairs = inside.filter("pivot != id").select("pivot", "id").distinct()
    wanted = classes.join(inside.select("id").distinct(), "id").select(*_ROW, "id")
    sets = keep(rows.dropDuplicates(_ROW).join(wanted, _ROW).select("id", "text").mapInArrow(tidy(_sets_of(n)), "id long, shingles binary"))

    def sketches(ids: DataFrame) -> DataFrame:
        named = classes.select("digest", "id").join(ids, "id")
        return filled.select("digest", F.col("n_shingles").alias("size"), "bands", "sketch").join(named, "digest").drop("digest").dropDuplicates(["id"])

    links = cut(verified(pairs, sets, percent))
    found = connected_components(links)
    more = cut(_residual_links(inside.select("bucket", "id"), found, sketches, sets, percent))
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    heads = classes.select("id", "digest").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return about.select(*_ROW, "n_shingles", "digest").join(heads, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable through links) and kept, for each document."""
    rows = keep(_components(docs, n, percent, key, text))
    # Kept as a table, so that the join can be split where a component is very large.
    names = keep(rows.filter("component is not null").groupBy("component").agg(F.min(F.when(~F.col("none"), F.col("doc"))).alias("name")))
    doc_id = F.when(~F.col("none"), F.col("doc"))
    out = rows.join(names, "component", "left").select(doc_id.alias("doc_id"), "n_shingles", F.when(F.col("component").isNull(), doc_id).otherwise(F.col("name")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, a null one last, and of those the one with the smallest
    hash of its text. Of rows that repeat it one stays too. Rows without a word are all kept."""
    rows = keep(_components(docs, n, percent, "doc_id", "text"))
    linked = rows.filter("component is not null")
    counted = keep(linked.groupBy("component", *_ROW).agg(F.count("*").alias("n")))
    best = keep(counted.groupBy("component").agg(F.min(F.struct("none", "doc", "body")).alias("best")))  # so that the join can be split
    gone = counted.join(best, "component").select(*[F.col(c).alias(f"near {c}") for c in _ROW], (F.struct("none", "doc", "body") != F.col("best")).alias("near gone"), (F.col("n") > 1).alias("near many"))
    gone = gone.filter("`near gone` or `near many`")
    keys = {"doc": F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), "none": docs["doc_id"].isNull(), "body": F.xxhash64(docs["text"])}
    on = [keys[c] == gone[f"near {c}"] for c in _ROW]
    once = docs.join(gone, on, "left_anti")
    if gone.filter("`near many` and not `near gone`").isEmpty():
        return once
    again = docs.join(gone.filter("not `near gone`"), on, "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=85)
