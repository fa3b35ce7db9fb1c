"""Removal of long repeated byte strings by merging Burrows-Wheeler orders of shards.

Texts are parsed into phrases at anchors: the position of the least hash of a `gram` in each window of `window` positions.
Which positions are anchors depends on nearby bytes only, so equal strings have equal phrases inside. Each shard (some MB of
whole documents) sorts the suffixes of its phrase sequences once. The shards' orders are then merged by refining their
interleave: a block is a context (the first phrases of a suffix) with an interval of each shard's order; a round deepens all
contexts to the next byte depth, splits each shard's intervals within their order, and interleaves the parts by context.
Blocks with one suffix in all are dropped, so later rounds only touch what is repeated; suffixes are never sorted again.
The depth that a block has reached is the common prefix of its suffixes.

After the last round the blocks of two or more are the repeated intervals: any two equal strings of `length` bytes contain,
at the same offset, anchors of one block. Members are divided by the symbol before them, here the `window` - 1 bytes to the
left of the anchor, and by the rest of `length` bytes to the right. Members that share both with another are repeated
throughout. The others (the ends of repeats) are compared byte by byte with the distinct contexts of their block, in
pairs for small blocks and by hashes of every split for large ones; blocks of over `WIDE` contexts are hashed in Spark.

The longest strings moved are those contexts; texts stay in their shard's file.

Edge cases: a null or empty text has no bytes and the digest of the empty string. Texts shorter than `length` lose
nothing. Strings are judged on the input and may overlap themselves or each other. Repeated rows are documents of their own
and so remove each other. A null doc_id stays null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.storage import AtomicFile, cut, keep, new_folder, open_filesystem, tidy
from quillmill.llm.words import U, chunks_of, mix, span_hashes, stretch_hashes, text_bytes

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 3 << 20
#: Shards that a task works on, one after the other.
SHARDS_A_TASK = 4
#: Contexts of a block that are compared in pairs, and those that one task handles.
PAIRS, WIDE = 64, 50_000


@dataclass(frozen=True)
class Shape:
    """length: of the strings; window: positions of which one is an anchor; gram: bytes that an anchor's hash covers."""

    length: int = 400
    window: int = 64
    gram: int = 16

    @property
    def depth(self) -> int:
        """Bytes right of an anchor within which any repeated string still has an anchor that is decided inside it."""
        return self.length - 2 * self.window - self.gram + 2

    @property
    def left(self) -> int:
        return self.window - 1


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of the `size` bytes from each position on, for all positions that have them."""
    n = len(raw) - size + 1
    out = np.zeros(n, U)
    for at in range(0, size, 8):
        part = np.zeros(n, U)
        if size - at >= 8:
            part = np.ndarray((n,), "<u8", raw, offset=at, strides=(1,)).copy()
        else:
            for k in range(size - at):
                part |= raw[at + k : at + k + n].astype(U) << U(8 * k)
        out = mix((out ^ part) * U(0x9FB21C651E98DF25) + U(at + 1))
    return out >> U(32)


def find_anchors(raw: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """Positions of anchors in concatenated texts; no window or gram reaches over a text's end."""
    if len(raw) < shape.window + shape.gram - 1:
        return np.empty(0, np.int64)
    low = (gram_hashes(raw, shape.gram) << U(32)) | np.arange(len(raw) - shape.gram + 1, dtype=U)
    span = 1
    while span * 2 <= shape.window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < shape.window:
        low = np.minimum(low[: span - shape.window], low[shape.window - span :])
    last = at[1:] - (shape.window + shape.gram - 1)  # of each text: where its last window begins
    steps = np.zeros(len(low) + 1, np.int32)
    full = last >= at[:-1]
    np.add.at(steps, at[:-1][full], 1)
    np.add.at(steps, last[full] + 1, -1)
    least = (low[np.cumsum(steps[:-1]) > 0] & U(0xFFFFFFFF)).astype(np.int64)
    return least[np.r_[True, least[1:] != least[:-1]]] if len(least) else least


def sort_suffixes(phrases: np.ndarray, most: int) -> np.ndarray:
    """The order of the suffixes of a phrase sequence by their first `most` phrases, by doubling ranks."""
    n = len(phrases)
    rank = np.unique(phrases, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < most and n and rank.max() < n - 1:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


class Shard:
    """Texts, their anchors and the order of their suffixes."""

    def __init__(self, number: int, shape: Shape, raw: np.ndarray, at: np.ndarray, docs: np.ndarray, null: np.ndarray, anchors: np.ndarray, order: np.ndarray | None = None):
        self.number, self.shape, self.raw, self.at, self.docs, self.null, self.anchors = number, shape, raw, at, docs, null, anchors
        self._order = order

    @cached_property
    def doc(self) -> np.ndarray:
        """The text that each anchor is in."""
        return np.searchsorted(self.at, self.anchors, side="right") - 1

    @cached_property
    def phrases(self) -> np.ndarray:
        """A hash of each phrase, from its anchor to the next; the last of a text is like no other."""
        out = span_hashes(self.raw, self.anchors, np.append(self.anchors[1:], len(self.raw)))[0]
        last = np.flatnonzero(np.append(self.doc[1:] != self.doc[:-1], True)) if len(out) else np.empty(0, np.int64)
        out[last] = mix(last.astype(U) + U(self.number << 24) ^ U(0x2545F4914F6CDD1D))
        return out

    def ends(self, members: np.ndarray, depth: int) -> np.ndarray:
        """The first anchor at least `depth` bytes on; -1 if the text has none."""
        to = np.searchsorted(self.anchors, self.anchors[members] + depth)
        inside = to < len(self.anchors)
        inside[inside] = self.doc[to[inside]] == self.doc[members[inside]]
        return np.where(inside, to, -1)

    def contexts(self, members: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a suffix has `depth` bytes of phrases, and 128 bits of hash of these."""
        to = self.ends(members, depth)
        alive = to >= 0
        count = np.where(alive, to - members, 0)
        keys = (stretch_hashes(self.phrases, members, count, seed).view(np.int64) for seed in (0, 1))
        return alive, *keys

    @cached_property
    def order(self) -> np.ndarray:
        if self._order is None:
            everyone = np.arange(len(self.anchors))
            to = self.ends(everyone, self.shape.depth)
            self._order = sort_suffixes(self.phrases, int((to - everyone).max(initial=1)))
        return self._order

    def save(self, file: AtomicFile) -> str:
        out = io.BytesIO()
        packed = zstandard.ZstdCompressor(3).compress(self.raw.tobytes())
        gaps = np.diff(self.anchors, prepend=0).astype(np.int32)
        narrow = np.frombuffer(zstandard.ZstdCompressor(3).compress(gaps.tobytes()), np.uint8)
        np.savez(out, raw=np.frombuffer(packed, np.uint8), at=self.at, docs=self.docs, null=self.null, gaps=narrow, order=self.order)
        file.write(out.getvalue())
        return file.close()

    @classmethod
    def load(cls, folder: str, name: str, number: int, shape: Shape) -> Shard:
        system, base = open_filesystem(folder)
        with system.open_input_file(f"{base}/{name}") as handle, np.load(handle) as z:
            unpack = zstandard.ZstdDecompressor()
            raw = np.frombuffer(unpack.decompress(z["raw"].tobytes()), np.uint8)
            anchors = np.cumsum(np.frombuffer(unpack.decompress(z["gaps"].tobytes()), np.int32).astype(np.int64))
            return cls(number, shape, raw, z["at"], z["docs"], z["null"], anchors, z["order"])

    # What the rounds ask of a shard.

    def refine(self, low: np.ndarray, count: np.ndarray, depth: int) -> pa.Table:
        """Split intervals of the order by contexts of `depth` bytes: b1, b2, shard, low, n of each part."""
        spot = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        interval = np.repeat(np.arange(len(low)), count)
        alive, k1, k2 = self.contexts(self.order[spot].astype(np.int64), depth)
        new = np.ones(len(spot), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (interval[1:] != interval[:-1]) | (alive[1:] != alive[:-1])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(spot)))
        starts, size = starts[alive[starts]], size[alive[starts]]
        return pa.table({"b1": k1[starts], "b2": k2[starts], "shard": np.full(len(starts), self.number), "low": spot[starts].astype(np.int64), "n": size.astype(np.int64)})

    def reach(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes left and right of each anchor that a string around it may cover."""
        at, doc = self.anchors[members], self.doc[members]
        return np.minimum(self.shape.left, at - self.at[doc]), np.minimum(self.shape.length, self.at[doc + 1] - at)

    def classes(self, b1: np.ndarray, b2: np.ndarray, low: np.ndarray, count: np.ndarray) -> pa.Table:
        """Members of blocks by the bytes around them: b1, b2, f1, f2, shard, members."""
        spot = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        block = np.repeat(np.arange(len(low)), count)
        members = self.order[spot].astype(np.int64)
        left, right = self.reach(members)
        long = left + right >= self.shape.length
        members, block, left, right = members[long], block[long], left[long], right[long]
        at = self.anchors[members]
        body = self.raw.tobytes()
        around = b"".join(xxhash.xxh3_128_digest(body[a - l : a + r], l) for a, l, r in zip(at.tolist(), left.tolist(), right.tolist(), strict=True))
        f1, f2 = np.frombuffer(around, np.int64).reshape(-1, 2).T
        by = np.lexsort((members, f2, f1, block))
        members, block, f1, f2 = members[by], block[by], f1[by], f2[by]
        new = np.ones(len(by), bool)
        new[1:] = (block[1:] != block[:-1]) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
        starts = np.flatnonzero(new)
        offsets = np.append(starts, len(by)).astype(np.int32) * 4
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(members.astype("<i4"))])
        at = block[starts]
        return pa.table({"b1": b1[at], "b2": b2[at], "f1": f1[starts], "f2": f2[starts], "shard": np.full(len(starts), self.number), "members": packed, "n": np.diff(np.append(starts, len(by))).astype(np.int64), "member": members[starts]})

    def around(self, members: np.ndarray) -> dict[str, pa.Array]:
        """core (the context's bytes), and the bytes left of the anchor and right of the core."""
        left, right = self.reach(members)
        at = self.anchors[members]
        core = self.anchors[self.ends(members, self.shape.depth)] - at
        body = self.raw.tobytes()
        return {
            "core": pa.array(core),
            "before": pa.array([body[a - n : a] for a, n in zip(at, left, strict=True)], pa.binary()),
            "after": pa.array([body[a + c : a + n] for a, c, n in zip(at, core, right, strict=True)], pa.binary()),
        }

    def result(self, members: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> pa.Table:
        """What is left of each text when the bytes from `back` before to `ahead` after the members' anchors go."""
        steps = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(steps, self.anchors[members] - back, 1)
        np.add.at(steps, self.anchors[members] + ahead, -1)
        gone = np.cumsum(steps[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[self.at[:-1][self.at[:-1] < len(gone)]] |= gone[self.at[:-1][self.at[:-1] < len(gone)]]
        sums = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(first))
        removed, spans = (s[self.at[1:]] - s[self.at[:-1]] for s in sums)
        kept = [self.raw[a:b][~gone[a:b]].tobytes() if n else self.raw[a:b].tobytes() for a, b, n in zip(self.at[:-1], self.at[1:], removed, strict=True)]
        return pa.table({
            "doc_id": pa.array(self.docs, pa.int64(), mask=self.null.astype(bool)),
            "n_bytes": np.diff(self.at),
            "n_removed": removed.astype(np.int64),
            "n_spans": spans.astype(np.int64),
            "kept": pa.array(kept, pa.binary()),
        })


_INTERVALS = "b1 long, b2 long, shard long, low long, n long"
_CLASSES = "b1 long, b2 long, f1 long, f2 long, shard long, members binary, n long, member long"
_CONTEXTS = "b1 long, b2 long, m long, total long, shard long, member long, core long, before binary, after binary"
_COVERS = "shard long, members binary, back long, ahead long"


def _write(folder: str, shape: Shape, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held, size, listed = [], 0, []

        def flush() -> None:
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            raw, at = text_bytes(table.column("text").combine_chunks())
            ids = table.column("doc_id").combine_chunks()
            shard = Shard(number, shape, raw, at.copy(), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()).astype(np.uint8), find_anchors(raw, at, shape))
            listed.append((number, shard.save(AtomicFile(folder, f"shard-{number:010d}", "npz"))))
            number, held, size = number + 1, [], 0

        for batch in chunks_of(batches, size=shard_bytes):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= shard_bytes:
                flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([n for n, _ in listed], pa.int64()), "file": pa.array([f for _, f in listed], pa.string())})

    return run


def _first_round(folder: str, shape: Shape, depth: int):
    """All suffixes split by their first contexts. This is the one round that moves a row for nearly every suffix, so only
    half of a context's hash goes along: contexts that share it stay together until the next round divides them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), strict=True):
                shard = Shard.load(folder, name, number, shape)
                if len(shard.anchors):
                    parts = shard.refine(np.zeros(1, np.int64), np.array([len(shard.anchors)]), depth)
                    yield from parts.set_column(1, "b2", pa.array(np.zeros(parts.num_rows, np.int64))).to_batches()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts interleaved by context, those of contexts with two suffixes or more. A context at a batch's edge stays for
    the next round to decide."""
    for batch in batches:
        if not batch.num_rows:
            continue
        b1, b2, n = (batch.column(c).to_numpy() for c in ("b1", "b2", "n"))
        new = np.r_[True, (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])]
        starts = np.flatnonzero(new)
        many = np.add.reduceat(n, starts) > 1
        many[[0, -1]] = True
        yield batch.filter(pa.array(many[np.cumsum(new) - 1]))


def interleave(parts: DataFrame) -> DataFrame:
    """Merge the shards' parts in the order of contexts, and drop contexts that occur once. A context has one part of each
    shard at most, so no run is longer than the number of shards."""
    return parts.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "shard", "low").mapInArrow(tidy(_repeated), _INTERVALS)


def _per_shard(listing: DataFrame, rows: DataFrame, tasks: int, folder: str, shape: Shape, work, schema: str) -> DataFrame:
    """`work(shard, rows)` for each shard with its rows, in so many tasks: rows are few bytes, but each shard is much work."""

    def run(shard_row: pa.Table, mine: pa.Table) -> pa.Table:
        if not shard_row.num_rows:
            raise ValueError("rows of an unknown shard")
        return work(Shard.load(folder, shard_row.column("file")[0].as_py(), shard_row.column("shard")[0].as_py(), shape), mine)

    return listing.repartition(tasks, "shard").groupBy("shard").cogroup(rows.repartition(tasks, "shard").groupBy("shard")).applyInArrow(run, schema)


def _numpy(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _contexts(shard: Shard, rows: pa.Table) -> pa.Table:
    (members,) = _numpy(rows, "member")
    return pa.table({c: rows.column(c) for c in ("b1", "b2", "m", "total", "shard", "member")} | shard.around(members.astype(np.int64)))


def _matrix(values: list[bytes], width: int, at_end: bool) -> np.ndarray:
    out = np.zeros((len(values), width), np.uint8)
    for row, v in zip(out, values, strict=True):
        if v:
            row[width - len(v) if at_end else 0 : width if at_end else len(v)] = np.frombuffer(v, np.uint8)
    return out


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns from the first on in which rows agree."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _splits(before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray, core: int, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of bytes left of the anchor: it, which rows have such a string, and the strings' hashes."""
    rest = shape.length - core
    left = np.zeros(len(before), U)  # of the bytes nearest to the anchor
    right = np.zeros((rest + 1, len(after)), U)
    for k in range(min(rest, after.shape[1])):
        right[k + 1] = mix(right[k] + after[:, k].astype(U) + U(1))
    for d in range(shape.left + 1):
        if d:
            left = mix(left + before[:, -d].astype(U) + U(257))
        if rest - d >= 0:
            has = (n_before >= d) & (n_after >= rest - d)
            yield d, has, mix(left ^ U(0x9E3779B97F4A7C15)) + right[rest - d]
        else:
            yield d, n_before >= d, left


def _arrays(table: pa.Table, shape: Shape):
    before, after = table.column("before").to_pylist(), table.column("after").to_pylist()
    return (
        _matrix(before, shape.left, True), _matrix(after, max(1, shape.length - shape.depth), False),
        np.array([len(x) for x in before], np.int64), np.array([len(x) for x in after], np.int64), *_numpy(table, "core", "total"),
    )


def _covers(table: pa.Table, found: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> pa.RecordBatch:
    keep = np.flatnonzero(found & (table.column("total").to_numpy() == 1))
    members = table.column("member").to_numpy()[keep].astype("<i4")
    return pa.RecordBatch.from_pydict({"shard": table.column("shard").combine_chunks().take(pa.array(keep)), "members": pa.array([m.tobytes() for m in members], pa.binary()), "back": pa.array(back[keep]), "ahead": pa.array(ahead[keep])})


def _small_blocks(table: pa.Table, shape: Shape) -> pa.RecordBatch:
    """Compare the contexts of each block in pairs, many blocks at a time."""
    before, after, n_before, n_after, core, _ = _arrays(table, shape)
    b1, b2 = _numpy(table, "b1", "b2")
    flipped = before[:, ::-1]
    n = len(b1)
    back, right, found = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for d in range(1, n):
        x = np.flatnonzero((b1[:-d] == b1[d:]) & (b2[:-d] == b2[d:]))
        if not len(x):
            break
        for i in range(0, len(x), 20_000):
            a, b = x[i : i + 20_000], x[i : i + 20_000] + d
            l = np.minimum(_same(flipped[a], flipped[b]), np.minimum(n_before[a], n_before[b]))  # noqa: E741
            r = np.minimum(_same(after[a], after[b]), np.minimum(n_after[a], n_after[b]))
            ok = l + core[a] + r >= shape.length
            for side in (a[ok], b[ok]):
                np.maximum.at(back, side, l[ok])
                np.maximum.at(right, side, r[ok])
                found[side] = True
    return _covers(table, found, back, core + right)


def _large_block(table: pa.Table, shape: Shape) -> pa.RecordBatch:
    """One block: which strings around the core occur in several contexts, for every split into left and right."""
    before, after, n_before, n_after, core, _ = _arrays(table, shape)
    n = len(core)
    back, ahead, found = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for d, has, keys in _splits(before, after, n_before, n_after, int(core[0]), shape):
        which = np.flatnonzero(has)
        _, inverse, counts = np.unique(keys[which], return_inverse=True, return_counts=True)
        twice = which[counts[inverse] > 1]
        back[twice] = np.maximum(back[twice], d)
        ahead[twice] = np.maximum(ahead[twice], shape.length - d)
        found[twice] = True
    return _covers(table, found, back, ahead)


def _ends_of_repeats(shape: Shape, pairs: int):
    """Stream contexts sorted by block; whole blocks are handled together."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        (m,) = _numpy(table, "m")
        if (m <= pairs).any():
            yield _small_blocks(table.filter(pa.array(m <= pairs)), shape)
        large = table.filter(pa.array(m > pairs))
        if large.num_rows:
            b1, b2 = _numpy(large, "b1", "b2")
            starts = np.flatnonzero(np.r_[True, (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])])
            for a, b in zip(starts, np.append(starts[1:], large.num_rows), strict=True):
                yield _large_block(large.slice(a, b - a), shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            b1, b2 = batch.column("b1").to_numpy(), batch.column("b2").to_numpy()
            edge = np.flatnonzero((b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))
            same = bool(held) and held[-1].column("b1")[-1].as_py() == b1[0] and held[-1].column("b2")[-1].as_py() == b2[0]
            if held and not same:
                yield from settle(pa.Table.from_batches(held))
                held = []
            if len(edge):
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, edge[-1] + 1)]))
                held = [batch.slice(edge[-1] + 1)]
            else:
                held.append(batch)
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def _all_splits(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            before, after, n_before, n_after, core, total = _arrays(table, shape) if batch.num_rows else [np.zeros(0, np.int64)] * 6
            for c in np.unique(core):
                rows = np.flatnonzero(core == c)
                for d, has, keys in _splits(before[rows], after[rows], n_before[rows], n_after[rows], int(c), shape):
                    at = pa.array(rows[has])
                    yield pa.RecordBatch.from_pydict({x: batch.column(x).take(at) for x in ("b1", "b2", "total", "shard", "member")} | {"d": pa.array(np.full(int(has.sum()), d, np.int64)), "key": pa.array(keys[has].view(np.int64))})

    return run


def _wide_blocks(contexts: DataFrame, shape: Shape) -> DataFrame:
    rows = contexts.mapInArrow(tidy(_all_splits(shape)), "b1 long, b2 long, total long, shard long, member long, d long, key long")
    by = ["b1", "b2", "d", "key"]
    twice = rows.groupBy(by).agg(F.count("*").alias("n")).filter("n > 1").select(by)
    found = rows.filter("total = 1").join(twice, by).groupBy("shard", "member").agg(F.max("d").alias("back"), (shape.length - F.min("d")).alias("ahead"))
    packed = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("member", 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]))
    return found.select("shard", packed.alias("members"), "back", "ahead")


def remove_repeats(docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, pairs: int = PAIRS, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each document."""
    if shape.depth < 1:
        raise ValueError("window and gram are too long for this length")
    folder = new_folder(docs.sparkSession, "shards")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    listing = cut(slim.mapInArrow(tidy(_write(folder, shape, shard_bytes)), "shard long, file string"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-listing.count() // SHARDS_A_TASK))
    per_shard = lambda rows, work, schema: _per_shard(listing, rows, tasks, folder, shape, work, schema)
    first = max(1, shape.depth // 2)
    blocks = keep(interleave(listing.repartition(tasks, "shard").mapInArrow(tidy(_first_round(folder, shape, first)), _INTERVALS)))
    blocks = keep(interleave(per_shard(blocks, lambda s, t: s.refine(*_numpy(t, "low", "n"), shape.depth), _INTERVALS)))
    classes = keep(per_shard(blocks, lambda s, t: s.classes(*_numpy(t, "b1", "b2", "low", "n")), _CLASSES))
    kinds = ["b1", "b2", "f1", "f2"]
    totals = keep(classes.groupBy(kinds).agg(F.sum("n").alias("total"), F.min(F.struct("shard", "member")).alias("one")))
    whole = classes.join(totals.filter("total > 1").select(kinds), kinds).select("shard", "members", F.lit(-1).cast("long").alias("back"), F.lit(-1).cast("long").alias("ahead"))
    mixed = totals.groupBy("b1", "b2").agg(F.count("*").alias("m"), F.min("total").alias("least")).filter("m > 1 and least = 1").select("b1", "b2", "m")
    ends = totals.join(mixed, ["b1", "b2"]).select("b1", "b2", "m", "total", "one.shard", "one.member")
    contexts = keep(per_shard(ends, _contexts, _CONTEXTS))
    narrow = contexts.filter(F.col("m") <= wide).repartition("b1", "b2").sortWithinPartitions("b1", "b2").mapInArrow(tidy(_ends_of_repeats(shape, pairs)), _COVERS)
    covers = whole.unionByName(narrow).unionByName(_wide_blocks(contexts.filter(F.col("m") > wide), shape))

    def finish(shard: Shard, rows: pa.Table) -> pa.Table:
        lists = rows.column("members").to_pylist()
        back, ahead = _numpy(rows, "back", "ahead")
        each = [np.frombuffer(x, "<i4") for x in lists]
        members = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
        size = np.array([len(x) for x in each], np.int64)
        back, ahead = np.repeat(back, size), np.repeat(ahead, size)
        left, right = shard.reach(members)
        return shard.result(members, np.where(back < 0, left, back), np.where(ahead < 0, right, ahead))

    return per_shard(covers, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
