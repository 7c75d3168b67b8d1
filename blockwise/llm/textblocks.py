"""Vectorised word and shingle kernels over Arrow string batches.

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; these
are single bytes in UTF-8, so words can be cut without decoding. All kernels
work on a :class:`Block`: one byte buffer with the documents laid end to end.
Blocks are cut by bytes (never inside a document), so memory stays bounded by
``block_bytes`` or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one numpy pass.
BLOCK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Documents ``first .. first + len(offsets) - 2`` of a batch, as one padded buffer."""

    buf: np.ndarray  # uint8, with 8 bytes of padding at the end
    offsets: np.ndarray  # int64, one more than documents
    first: int

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_bytes(self) -> int:
        return int(self.offsets[-1])


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts an Arrow string array into blocks; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(off, off[at] + block_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        lo, hi = int(off[at]), int(off[to])
        buf = np.zeros(hi - lo + 8, dtype=np.uint8)
        buf[: hi - lo] = data[lo:hi]
        yield Block(buf, off[at : to + 1] - lo, at)
        at = to


@dataclass
class Words:
    """Word boundaries in a block; words of document ``d`` are ``first[d]:first[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(block: Block) -> Words:
    n = block.n_bytes
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(_SPACE[block.buf[:n]], out=inside[1 : n + 1])
    edge = inside[1:] != inside[:-1]  # edge[i]: a run begins or ends before byte i
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts + 1] & ~edge[cuts]]  # words that touch across two documents
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    if len(cuts):
        cuts = np.unique(cuts)
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return Words(start, end, np.searchsorted(start, block.offsets))


def word_hashes(block: Block, w: Words, lower: bool = True, latin: bool = False) -> np.ndarray:
    """64-bit hashes of the words' bytes, 8 bytes at a time; ``lower`` folds A-Z, ``latin`` also the accented capitals of Latin-1."""
    buf = _LOWER[block.buf] if lower else block.buf
    if latin:
        at = np.flatnonzero(buf[:-1] == 0xC3) + 1
        at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
        buf[at] += 0x20
    at8 = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    size = w.end - w.start
    h = mix64(size.astype(np.uint64) * _GOLD)
    todo, pos, left = None, w.start, size
    while True:
        x = at8[pos] & _MASK[np.minimum(left, 8)]
        if todo is None:
            h = mix64(h ^ x)
        else:
            h[todo] = mix64((h[todo] + _GOLD) ^ x)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        todo, pos, left = (more if todo is None else todo[more]), pos[more] + 8, left[more] - 8


def combine(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """Order-sensitive hash of equally long columns of hashes."""
    h = mix64(parts[0] + np.uint64(seed))
    for x in parts[1:]:
        h = mix64(h * _GOLD + x)
    return h


def shingle_sets(block: Block, k: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles.

    A document with fewer than k words has its whole word sequence as its one
    shingle; one without words has the empty set.
    """
    w = words(block)
    h = word_hashes(block, w)
    n = np.diff(w.first)
    full = combine([h[i : len(h) - k + 1 + i] for i in range(k)], k) if len(h) >= k else np.zeros(0, np.uint64)
    out = []
    for d in range(block.n_docs):
        a, m = w.first[d], n[d]
        if m >= k:
            s = full[a : a + m - k + 1].copy()
            s.sort()
            if m > k and (same := s[1:] == s[:-1]).any():
                s = s[np.concatenate([[True], ~same])]
        elif m:
            s = combine([h[a + i : a + i + 1] for i in range(m)], int(m))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out
