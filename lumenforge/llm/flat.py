"""Flat numpy views of Arrow text columns: words, word hashes and batch iteration.

Every text operator of this package walks Arrow record batches inside Spark tasks. The texts of a batch lie in one byte
buffer, so words are found and hashed for many documents at once, and no Python object is made per word.

A word's hash mixes its bytes eight at a time through a bijective finaliser (two words of one length up to eight bytes never
share a hash; longer ones share one by chance only, once in 2^64 pairs; words beyond `LONG_WORD` bytes are hashed by BLAKE2).
Where an equal hash decides something, `Words.exact_ids` compares the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
#: Bytes beyond which a word is hashed on its own.
LONG_WORD = 256
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

#: The ASCII white space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pairs of two arrays."""
    return mix(a * MIX_A + mix(b ^ MIX_B))


def chained(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hash of every run of `width` consecutive values (len(h) - width + 1 of them), by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    span, out = 1, h
    while 2 * span <= width:
        out = joined(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = joined(out[:n], out[width - span : width - span + n])
    return mix(out[:n] ^ np.uint64(salt))


def text_parts(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about chunk_bytes of UTF-8; nulls become empty texts."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of some documents: byte starts and ends, 64-bit hashes, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, fold: bool = False, hashed: bool = True):
        gap = separator[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~gap
        before = edge[:-1].copy()
        before[1:] |= gap[:-1]
        after = edge[1:].copy()
        after[:-1] |= gap[1:]
        if len(data):
            before[0] = after[-1] = True
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self.data = FOLD[data] if fold else data
        if hashed:
            self._eights = np.ndarray((len(data) + 1,), "<u8", np.append(self.data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
            self.hashes = self._hashed()

    def _eight(self, who: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of some words, zeros beyond their ends."""
        left = self.ends[who] - self.starts[who] - 8 * k
        return self._eights[self.starts[who] + 8 * k] & MASKS[np.minimum(left, 8)]

    def _hashed(self) -> np.ndarray:
        length = self.ends - self.starts
        who = np.arange(len(length))
        out = mix(length.astype(np.uint64) * MIX_B)
        for k in range(LONG_WORD // 8):
            if not len(who):
                return out
            out[who] = mix((out[who] * MIX_A) ^ self._eight(who, k))
            who = who[length[who] > 8 * (k + 1)]
        for w in who.tolist():
            out[w] = int.from_bytes(hashlib.blake2b(self.data[self.starts[w] : self.ends[w]], digest_size=8).digest(), "little")
        return out

    def stems(self, size: int) -> np.ndarray:
        """Hash of the first `size` bytes (up to eight) of each longer word; 0 for the others."""
        h = mix((self._eight(np.arange(len(self.starts)), 0) & MASKS[size]) * MIX_B ^ mix(np.full(1, size, np.uint64)))
        return np.where(self.ends - self.starts > size, h, np.uint64(0))

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words a[i] and b[i] have the same bytes."""
        return self.equal_to(a, self, b)

    def equal_to(self, a: np.ndarray, other: Words, b: np.ndarray) -> np.ndarray:
        """Whether the words a[i] and the words b[i] of other have the same bytes."""
        length = self.ends[a] - self.starts[a]
        same = length == other.ends[b] - other.starts[b]
        who, k = np.flatnonzero(same), 0
        while len(who) and k < LONG_WORD // 8:
            good = self._eight(a[who], k) == other._eight(b[who], k)
            same[who[~good]] = False
            k += 1
            who = who[good & (length[who] > 8 * k)]
        for w in who.tolist():
            same[w] = np.array_equal(self.data[self.starts[a[w]] : self.ends[a[w]]], other.data[other.starts[b[w]] : other.ends[b[w]]])
        return same

    def exact_ids(self) -> np.ndarray:
        """A number for each word: equal numbers if and only if the bytes are equal."""
        order = np.argsort(self.hashes, kind="stable")
        equal = self.hashes[order[1:]] == self.hashes[order[:-1]]
        out = np.zeros(len(order), np.int64)
        if self._equal(order[:-1][equal], order[1:][equal]).all():
            out[order[1:]] = np.cumsum(~equal)
            return out
        known: dict[bytes, int] = {}
        raw = self.data.tobytes()
        return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], np.int64)


def numbered_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[i], b[i]): equal numbers if and only if the pairs are equal."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def exact_grams(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for every run of `width` consecutive ids: equal numbers if and only if the runs are equal."""
    out = ids
    for span in range(1, width):
        out = numbered_pairs(out[: len(ids) - span], ids[span:])
    return out


def joined_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> list[bytes]:
    """The words of each document joined by one space."""
    raw = (FOLD[data] if fold else data).tobytes()
    at = offsets.tolist()
    return [b" ".join(raw[a:b].split()) for a, b in zip(at[:-1], at[1:], strict=True)]
