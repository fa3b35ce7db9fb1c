"""Vectorised words and shingles over Arrow batches of texts.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased. Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: The first k bytes of eight, and the longest range that is hashed eight bytes at a time.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (one more at the end). Null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks_of(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `size` bytes of text, at least one row each, to bound a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(lengths) // size
        edges = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


class Words:
    """Words of a batch of texts. starts, ends: byte ranges; of_doc[i]:of_doc[i+1] are the words of text i."""

    def __init__(self, texts: pa.Array):
        self.raw, self.at = text_bytes(texts)
        solid = ~SPACE[self.raw]
        n = len(solid)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        first, last = self.at[:-1], self.at[1:] - 1
        full = self.at[1:] > self.at[:-1]
        before[first[full]] = False
        after[last[full]] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.of_doc = np.searchsorted(self.starts, self.at)

    def counts(self) -> np.ndarray:
        return np.diff(self.of_doc)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in lower case."""
        return span_hashes(LOWER[self.raw], self.starts, self.ends)[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """64-bit hashes of byte ranges, for each seed: eight bytes at a time are put in and scrambled, so ranges of one length up
    to eight bytes never collide, and no pattern of bytes cancels out. Ranges of over `LONG` bytes are hashed one by one."""
    size = ends - starts
    out = [mix(size.astype(U) + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)) for seed in seeds]
    if not len(size):
        return out
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    block = eight[starts]
    block &= _FIRST[np.minimum(size, 8)]
    out = [mix(x ^ block) for x in out]
    long = np.flatnonzero(size > LONG)
    alive = np.flatnonzero(size > 8) if not len(long) else np.flatnonzero((size > 8) & (size <= LONG))
    at, left = starts[alive] + 8, size[alive] - 8
    while len(alive):
        block = eight[at]
        block &= _FIRST[np.minimum(left, 8)]
        for x in out:
            x[alive] = mix(x[alive] ^ block)
        more = np.flatnonzero(left > 8)
        alive, at, left = alive[more], at[more] + 8, left[more] - 8
    for i in long:
        for x, seed in zip(out, seeds, strict=True):
            x[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return out


def stretch_hashes(symbols: np.ndarray, low: np.ndarray, count: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the `count` symbols from each of `low` on, put together from those of stretches of 1, 2, 4, ... symbols."""
    out = mix(count.astype(U) + U((0xC2B2AE3D27D4EB4F * (2 * seed + 1)) % 2**64))
    level, at, size, most = mix(symbols + U(2 * seed + 1)), low.copy(), 1, int(count.max(initial=0))
    while size <= most:
        here = np.flatnonzero(count & size)
        out[here] = mix(out[here] * U(0x9FB21C651E98DF25) + level[at[here]])
        at[here] += size
        if 2 * size <= most:
            level = mix(level[:-size] * U(0xD6E8FEB86659FD93) + level[size:])
        size *= 2
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words; shorter than `words` by n - 1."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, U)
    for i in range(n):
        out += words[i : i + size]
        out = mix(out + U(0x632BE59BD9B4E019 + 2 * i))
    return out


def document_shingles(words: np.ndarray, rolling: np.ndarray, n: int) -> np.ndarray:
    """Shingles of one text, in order; with fewer than n words the whole sequence is one; without words, none."""
    if len(words) >= n:
        return rolling[: len(words) - n + 1]
    return shingle_hashes(words, len(words)) ^ U(len(words)) if len(words) else np.empty(0, U)
