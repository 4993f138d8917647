"""Vectorised hashes of words and of runs of words, over the UTF-8 bytes of an Arrow column.

A word is hashed eight bytes at a time, a run of words by joining the hashes of its halves; each step mixes
products, sums and shifts, so that no algebra of the texts (as in polynomial hashes) makes two of them fall
together. Whole texts are told apart by 128 bits of BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the two independent hashes.
MULTIPLIERS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Words of more bytes than this are hashed one by one.
LONG = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    """Hash of two hashes in order."""
    m, n = MULTIPLIERS[which]
    x = a * np.uint64(m) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(n)
    x ^= x >> np.uint64(32)
    return x


def _word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int) -> list[np.ndarray]:
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = [mixed(size.astype(np.uint64) * np.uint64(m)) for m, _ in MULTIPLIERS[:hashes]]
    todo, at, left = np.flatnonzero(size <= LONG), starts, size
    if len(todo) < len(size):
        for i in np.flatnonzero(size > LONG).tolist():
            digest = hashlib.blake2b(text[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
            for k in range(hashes):
                out[k][i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
        at, left = at[todo], left[todo]
    whole = len(todo) == len(size)
    while len(todo):
        block = eights[at] & _MASKS[np.minimum(left, 8)]
        for k in range(hashes):
            if whole:
                out[k] = joined(out[k], block, k)
            else:
                out[k][todo] = joined(out[k][todo], block, k)
        more = left > 8
        todo, at, left, whole = todo[more], at[more] + 8, left[more] - 8, False
    return out


class Words:
    """The words of a column of texts: byte bounds, hashes (one or two), and the bounds of each text."""

    def __init__(self, column: pa.Array, hashes: int = 1, fold: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
        data = column.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        if fold:
            self.bytes = _LOWER[self.bytes]
        edges = offsets - offsets[0]
        space = _SPACE[self.bytes]
        # a word starts after white space or at a text's edge, and ends likewise
        inner = edges[1:-1][edges[1:-1] < len(self.bytes)]
        before = np.ones(len(self.bytes), dtype=bool)
        before[1:] = space[:-1]
        before[inner] = True
        after = np.ones(len(self.bytes), dtype=bool)
        after[:-1] = before[1:] | space[1:]
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.bounds = np.searchsorted(self.starts, edges)
        self.hashes = _word_hashes(self.bytes, self.starts, self.ends, hashes)

    def runs(self, n: int, which: int = 0) -> np.ndarray:
        """Hash of the n words from each word on (meaningless where a text ends before)."""
        count = max(0, len(self.starts) - n + 1)
        out, done, power, width = None, 0, self.hashes[which], 1
        while True:
            if n & width:
                part = power[done : done + count]
                out = part if out is None else joined(out, part, which)
                done += width
            if done == n:
                return mixed(out)
            power = joined(power[:-width], power[width:], which) if len(power) > width else power[:0]
            width *= 2

    def valid(self, n: int) -> np.ndarray:
        """Which words have n words of their own text from them on."""
        ok = np.ones(max(0, len(self.starts) - n + 1), dtype=bool)
        for k in range(1, n):
            b = self.bounds[1:-1] - k
            ok[b[(b >= 0) & (b < len(ok))]] = False
        return ok


def digests(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, 128 bits in two halves) of each text, from its words alone; with ``fold`` A-Z count as a-z."""
    counts, found = [], []
    for text in column.cast(pa.large_binary()).fill_null(b""):
        words = text.as_py()
        words = (words.lower() if fold else words).split()
        counts.append(len(words))
        found.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
    halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
    return np.array(counts, dtype=np.int64), halves[:, 0], halves[:, 1]


def portions(batch: pa.RecordBatch, text: str, most: int = 400_000) -> list[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text; a longer text stands alone."""
    sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]
