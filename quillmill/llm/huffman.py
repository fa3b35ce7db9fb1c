"""Canonical, length-limited Huffman coding of token ids, in numpy.

Ids are coded in blocks of `BLOCK` ids. A block can be decoded on its own from its bit offset (the checkpoint), so all
blocks of a file are decoded side by side, one table look-up for each step.
"""

from __future__ import annotations

import numpy as np

#: Ids a block.
BLOCK = 256
#: The longest code, in bits: the width of the decoding table.
MAX_BITS = 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    levels: list[np.ndarray] = []  # of each level: which items, in order of weight, are single ids
    items = weights
    for _ in range(limit - 1):
        levels.append(items)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        items = np.sort(np.concatenate([weights, pairs]), kind="stable")
    # From the top: of the first n items of a level, the single ids are the lightest ones, the others are pairs of the level below.
    take = 2 * len(weights) - 2
    depth = np.zeros(len(weights), np.int64)
    for level in range(limit - 1, -1, -1):
        if level == 0:
            depth[:take] += 1
            break
        below = levels[level - 1]
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.argsort(np.concatenate([weights, pairs]), kind="stable")[:take]
        singles = int((merged < len(weights)).sum())
        depth[:singles] += 1
        take = 2 * (take - singles)
        if not take:
            break
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for length in np.unique(lengths[order]):
        ids = order[lengths[order] == length]
        code <<= int(length) - last
        codes[ids] = code + np.arange(len(ids))
        code, last = code + len(ids), int(length)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next MAX_BITS bits: the id and its code's length."""
    ids, bits = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = (1 << (MAX_BITS - lengths[order].astype(np.int64))).astype(np.int64)
    total = int(spans.sum())
    ids[:total], bits[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed bits and the bit offset of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    checkpoints = starts[::BLOCK].copy()
    out = np.zeros((int(ends[-1]) + 7) // 8 + 4, np.float64)
    # A code and the 7 bits before it at most fill 4 bytes; bits don't overlap, so sums are unions.
    window = codes[ids].astype(np.uint64) << (32 - (starts & 7) - size).astype(np.uint64)
    at = starts >> 3
    for k in range(4):
        part = ((window >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out += np.bincount(at + k, weights=part, minlength=len(out))[: len(out)]
    return out[: (int(ends[-1]) + 7) // 8].astype(np.uint8).tobytes(), checkpoints


def decode(packed: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids; the blocks step along together."""
    ids, bits = table
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(packed + b"\0" * 8, np.uint8)
    word = np.zeros(len(raw) - 3, np.uint32)  # the 4 bytes from each byte on
    for k in range(4):
        word |= raw[k : len(word) + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    blocks = len(checkpoints)
    out = np.zeros((BLOCK, blocks), np.uint32)
    at = checkpoints.astype(np.int64).copy()
    last = n - (blocks - 1) * BLOCK
    for step in range(BLOCK):
        live = blocks if step < last else blocks - 1
        if not live:
            break
        here = at[:live]
        key = (word[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[step, :live] = ids[key]
        here += bits[key]
    return out.T.reshape(-1)[:n]
