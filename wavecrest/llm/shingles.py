"""Sets of word shingles as hashes, their wide SimHash fingerprints, and links between similar sets."""

from __future__ import annotations

import numpy as np

from wavecrest.llm.common import Text, mix, ragged, range_hashes, words

#: Bytes of words: all but ASCII white space.
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(text: Text, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of all texts as sorted hashes, and where each text's begin; a text of fewer words has one.

    A text without words has the shingle 0, so all such texts are alike.
    """
    found = words(text, _SOLID)
    h = range_hashes(text.data, found.starts, found.ends)
    n = np.diff(found.first)
    after = np.repeat(found.first[1:], n) - np.arange(len(h))  # words of the text from here on
    out = h.copy()
    for k in range(1, width):
        on = np.flatnonzero(after > k)
        out[on] = mix(mix(out[on]) + h[on + k])
    whole = np.repeat(n, n) <= width
    first = np.zeros(len(h), bool)
    first[found.first[:-1][n > 0]] = True
    keep = np.where(whole, first, after >= width)
    doc = np.concatenate((np.repeat(np.arange(len(n)), n)[keep], np.flatnonzero(n == 0)))
    out = np.concatenate((out[keep], np.zeros(int((n == 0).sum()), np.uint64)))
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (out[1:] != out[:-1]))) if len(doc) else np.zeros(0, bool)
    doc, out = doc[new], out[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return mix(np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at[:-1]) + np.diff(at).astype(np.uint64))


def wide_fingerprints(values: np.ndarray, at: np.ndarray, lanes: int, seed: int = 42) -> np.ndarray:
    """(sets, lanes): SimHash words of each set; a bit is 1 if more than half of the set's hashes for that lane have it.

    Eight hashes are added up at a time, bit by bit side by side: each adder takes bits of one weight and
    gives their sum's bits of that weight and of the next.
    """

    def add(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return (a ^ b, a & b) if c is None else (a ^ b ^ c, (a & b) | (c & (a ^ b)))

    n = np.diff(at)
    eights = -(-n // 8)
    first = np.cumsum(eights) - eights
    slot = ragged(first * 8, n)
    out = np.empty((len(n), lanes), np.uint64)
    for lane, odd in enumerate(np.random.default_rng(seed).integers(0, 1 << 63, lanes, dtype=np.uint64).tolist()):
        rows = np.zeros(int(eights.sum()) * 8, np.uint64)
        rows[slot] = mix(values ^ np.uint64(odd))
        x = [np.ascontiguousarray(col) for col in rows.reshape(-1, 8).T]
        s1, c1 = add(x[0], x[1], x[2])
        s2, c2 = add(x[3], x[4], x[5])
        s3, c3 = add(x[6], x[7], s1)
        ones, c4 = add(s2, s3)
        t1, d1 = add(c1, c2, c3)
        twos, d2 = add(t1, c4)
        fours, top = add(d1, d2)
        total = np.zeros((len(ones), 64), np.uint8)
        for k, plane in enumerate((ones, twos, fours, top)):
            total += np.unpackbits(plane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") << np.uint8(k)
        per_set = np.add.reduceat(total, first, axis=0, dtype=np.int32)
        out[:, lane] = np.packbits(per_set * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs that link all sets joined by similarities of ``least``, directly or not; a set is compared only with those not yet reached."""
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    out, reached = [], []
    while len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
        i = reached.pop()
        close = np.flatnonzero((np.minimum(sizes[left], sizes[i]) >= least * np.maximum(sizes[left], sizes[i])))
        if not len(close):
            continue
        chosen = left[close]
        values = np.concatenate([sets[j] for j in chosen])
        place = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
        both = np.add.reduceat((sets[i][place] == values).astype(np.int64), np.cumsum(sizes[chosen]) - sizes[chosen])
        near = both >= least * (sizes[chosen] + sizes[i] - both)
        out += [(i, int(j)) for j in chosen[near]]
        reached += chosen[near].tolist()
        left = np.delete(left, close[near])
    return out
