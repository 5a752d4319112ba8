"""Vectorised text primitives over Arrow string arrays.

Texts are handled as one flat UTF-8 byte array plus offsets, in blocks of bounded size, so a batch
with very long documents does not multiply into many gigabytes of temporaries.  A single document is
never split: the block that holds it is as large as the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one block gathers before it is handed on.
BLOCK_BYTES = 1 << 20
#: Longer spans are hashed one by one instead of eight bytes of all spans at a time.
LONG_SPAN = 512
#: For n = 0 to 8, the bytes of a little-endian word that are its first n.
FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def byte_class(spec) -> np.ndarray:
    """Boolean table over byte values, from the values that are in the class."""
    table = np.zeros(256, np.bool_)
    table[list(spec)] = True
    return table


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased already.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words [^\x20\x09-\x0D]+.
NONSPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: The first byte of each code point.
LEAD = ~byte_class(range(0x80, 0xC0))

def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, element by element."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_view(raw: np.ndarray) -> np.ndarray:
    """A copy of bytes, seen as the little-endian eight-byte number at each place."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:-8] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


class Block:
    """Some consecutive texts of a batch: bytes `raw`, text i at raw[at[i]:at[i + 1]]."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, first: int):
        self.raw, self.at, self.first, self.n = raw, at, first, len(at) - 1

    def text(self, i: int) -> bytes:
        return self.raw[self.at[i] : self.at[i + 1]].tobytes()

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of the true bytes within each text: starts, ends, and run offsets per text."""
        n = len(inside)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        before = np.empty(n, np.bool_)
        before[0] = False
        before[1:] = inside[:-1]
        edge = self.at[:-1][self.at[:-1] < n]
        before[edge] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, np.bool_)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines split at newline, one at least per text: starts, ends, and line offsets per text."""
        breaks = np.flatnonzero(self.raw == 10)
        upto = np.searchsorted(breaks, self.at)
        counts = np.diff(upto) + 1
        offsets = np.concatenate(([0], np.cumsum(counts)))
        starts = np.empty(offsets[-1], np.int64)
        ends = np.empty(offsets[-1], np.int64)
        first = np.zeros(offsets[-1], np.bool_)
        first[offsets[:-1]] = True
        last = np.zeros(offsets[-1], np.bool_)
        last[offsets[1:] - 1] = True
        starts[first] = self.at[:-1]
        starts[~first] = breaks + 1
        ends[last] = self.at[1:]
        ends[~last] = breaks
        return starts, ends, offsets

    def words(self, fold: np.ndarray = SAME) -> np.ndarray:
        """At each byte place (and the end) the eight bytes from there, folded, as one number; 0 beyond the block."""
        return word_view(self.raw if fold is SAME else fold[self.raw])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each span's folded bytes; equal spans have equal hashes anywhere.

        Eight bytes at a time go through a finaliser that mixes all bits, starting from the length and the
        seed, so no family of strings is known to collide; spans of up to eight bytes and one length never do.
        Hashes of two seeds are independent: together they have 128 bits."""
        words = self.words(fold)
        length = ends - starts
        h = mix(length.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
        live, at, left = np.flatnonzero(length <= LONG_SPAN) if len(length) and length.max() > LONG_SPAN else np.arange(len(length)), starts, length
        at, left = starts[live], length[live]
        while len(live):
            h[live] = mix(h[live] ^ (words[at] & FIRST_BYTES[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        long = np.flatnonzero(length > LONG_SPAN)
        if len(long):
            flat = memoryview(words.base)
            key = seed.to_bytes(8, "little", signed=True)
            for i, s, e in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
                h[i] = int.from_bytes(hashlib.blake2b(flat[s:e], digest_size=8, key=key).digest(), "little")
        return h

    def distinct(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans by their bytes: an order in which equal ones are side by side, the number of each one's kind in
        that order, and one span of each kind.  Hashes sort them, bytes decide."""
        h = self.hashes(starts, ends)
        order = np.argsort(h)
        new = np.ones(len(h), np.bool_)
        new[1:] = h[order][1:] != h[order][:-1]
        rank, one = np.cumsum(new) - 1, order[new]
        words, length, other = self.words(), ends - starts, one[rank]
        if (length[order] != length[other]).any() or not equal_spans(words, starts[order], words, starts[other], length[order]).all():
            flat, kinds = self.raw.tobytes(), {}
            which = np.array([kinds.setdefault(flat[s:e], len(kinds)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            order = np.argsort(which, kind="stable")
            rank = which[order]
            one = order[np.concatenate(([True], rank[1:] != rank[:-1]))]
        return order, rank, one


def equal_spans(words: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from each place a of `words` and b of `others` on are equal for so many bytes."""
    out = np.ones(len(a), np.bool_)
    live = np.flatnonzero(((a != b) | (words is not others)) & (length > 0))
    step = 0
    while len(live):
        part = FIRST_BYTES[np.minimum(length[live] - step, 8)]
        same = ((words[a[live] + step] ^ others[b[live] + step]) & part) == 0
        out[live[~same]] = False
        step += 8
        live = live[same & (length[live] > step)]
    return out


def per_row(offsets: np.ndarray) -> np.ndarray:
    """For CSR offsets, the row number of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, empty ones included."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of up to `limit` bytes (a longer text alone) over a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Block(flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo)
        lo = hi


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
