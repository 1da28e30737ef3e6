"""Canonical, length-limited Huffman codes over whole numbers, coded and decoded as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Longest code in bits, unless more than 2 ** LIMIT different ids need more.
LIMIT = 16
#: Ids in a block; each block's first bit is kept, so blocks decode independently.
BLOCK = 256


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Code length of each id (0 where its count is 0) by package-merge, which is optimal under the limit.

    The limit is LIMIT, or the least that has a code for each id.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    limit = max(LIMIT, (n - 1).bit_length())
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_levels, level = [], weights
    leaf = np.ones(n, bool)
    for _ in range(limit):
        leaf_levels.append(leaf)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        by = np.argsort(both, kind="stable")
        level, leaf = both[by], by < n
    need, depth = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(leaf_levels):
        leaves = int(leaf[:need].sum())
        depth[:leaves] += 1
        need = 2 * (need - leaves)
    lengths[order] = depth
    return lengths


def _longest(lengths: np.ndarray) -> int:
    return max(LIMIT, int(lengths.max(initial=0)))


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    longest = _longest(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.uint64(1) << (longest - lengths[order]).astype(np.uint64)
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = first >> (longest - lengths[order]).astype(np.uint64)
    return codes


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, filled up to whole bytes, and the first bit of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    code, length = codes[ids], lengths[ids].astype(np.int64)
    ends = np.cumsum(length)
    at = ends - length
    word, shift = at >> 6, 64 - (at & 63) - length
    over = shift < 0
    main = np.where(over, code >> np.where(over, -shift, 0).astype(np.uint64), code << np.where(over, 0, shift).astype(np.uint64))
    heads = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[heads]] = np.bitwise_or.reduceat(main, heads)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::BLOCK]


class Decoder:
    """Decodes by a table from the next bits, as many as the longest code has, to an id and its length; all blocks move side by side."""

    def __init__(self, lengths: np.ndarray):
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.longest = _longest(lengths)
        span = 1 << (self.longest - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.longest, np.uint32)
        self.lengths = np.ones(1 << self.longest, np.int64)
        filled = int(span.sum())
        self.ids[:filled] = np.repeat(order, span)
        self.lengths[:filled] = np.repeat(lengths[order], span)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The first n ids of whole blocks that begin at ``checkpoints``."""
        out = np.empty((BLOCK, len(checkpoints)), np.uint32)
        data = np.frombuffer(bits + bytes(8), np.uint8)
        words = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,))
        pos, last = checkpoints.astype(np.int64), len(words) - 1
        for k in range(BLOCK):
            value = words[np.minimum(pos >> 3, last)].astype(np.uint32) >> (32 - self.longest - (pos & 7)).astype(np.uint32) & np.uint32((1 << self.longest) - 1)
            out[k] = self.ids[value]
            pos += self.lengths[value]
        return out.T.reshape(-1)[:n]
