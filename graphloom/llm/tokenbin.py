"""Token ids in a binary format, compressed by a grammar per shard block (Re-Pair).

Rows are range-partitioned by doc_id; each partition is a shard, cut into blocks of about `BLOCK_IDS`
ids.  In a block the most frequent pairs of adjacent ids are replaced by nonterminals, round by round;
the rules and each nonterminal's expansion length are stored with the block, so that ids of one
document are decoded without expanding the others.  Rounds go on until one would shorten the block by less than
`LEAST_GAIN`.  Symbols have 16 bits where the vocabulary leaves room for rules, else 32: ids of the
vocabulary, then the rules.

Blocks are written by Spark as rows of a Parquet table (shard, block, counts, payload) in the shared
folder, so a task that is run again leaves no second copy, and are read back from there.

Tokenising: a text is cut before each blank or newline that follows another character, between a Latin
letter and the ASCII punctuation behind it, and between a single newline and the Latin letter behind it,
where the pre-tokenizer cuts as well; each distinct piece is encoded once per process and kept.

Block format, little endian: magic `GLRP`, then unsigned 32-bit counts of documents, rules and symbols
and the vocabulary size; per document doc_id (signed 64), a null flag (8), ids (unsigned 32) and its
first symbol (unsigned 32); per rule left and right symbol (unsigned 16 or 32); per rule its expansion length
(unsigned 32); then the symbols (unsigned 16 or 32).  No nonterminal spans two documents.

Defined results: a null or empty text has the end id alone; rows with a null doc_id come first;
repeated rows are written each, ties in doc_id in the order of their texts; an empty table gives an
empty result; other columns are never looked at.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.scratch import Scratch

END_ID = 0
MAGIC = b"GLRP"
BLOCK_IDS = 1 << 20
#: A pair is frequent from this many places on: a rule takes the room of four symbols, and rules are few.
LEAST_USES = 8
#: A round that would save less than this part of the symbols is not done.
LEAST_GAIN = 0.004
#: Rules that 16-bit symbols must have room for; else they have 32 bits.
LEAST_ROOM = 4096
#: Distinct pieces that a process keeps: about 50 bytes each.
MAX_KEPT = 2_000_000
BLANK = tk.byte_class([0x20, 0x0A])
#: Last and last but one byte of characters that count as white space beyond ASCII; and ASCII white space.
_WIDE_LAST = tk.byte_class([0x85, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F, 0xA0])
_WIDE_BEFORE = tk.byte_class([0xC2, 0x80, 0x81, 0x9A])
_ASCII_SPACE = tk.byte_class([*range(0x09, 0x0E), *range(0x1C, 0x21)])
ASCII_LETTER = tk.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
#: U+00C0 to U+017F begin with 0xC3 to 0xC5 and are letters but for two signs, C3 97 and C3 B7: their second bytes.
_SIGN_SECOND = tk.byte_class([0x97, 0xB7])
#: Printable ASCII that is no letter, digit or blank.
PUNCTUATION = tk.byte_class([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])


class Spans:
    """Spans of values, added one batch after another: span i is flat[at[i] : at[i] + size[i]]."""

    def __init__(self, kind):
        self._room = np.zeros(1 << 12, kind)
        self.at, self.size, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    @property
    def flat(self) -> np.ndarray:
        return self._room[: self.n]

    def words(self) -> np.ndarray:
        """Of bytes, the eight from each place on as one number."""
        return np.ndarray((self.n + 1,), "<u8", self._room, strides=(1,))

    def add(self, values: np.ndarray, sizes: list[int] | np.ndarray) -> None:
        size = np.array(sizes, np.int64)
        if self.n + len(values) + 8 > len(self._room):
            self._room = np.concatenate((self.flat, np.zeros(self.n + len(values) + (1 << 12), self._room.dtype)))
        self._room[self.n : self.n + len(values)] = values
        self.at = np.concatenate((self.at, self.n + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.n += len(values)


def latin_letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are the first, and which the last, of an ASCII letter or a letter from U+00C0 to U+017F."""
    first = ASCII_LETTER[raw]
    last = first.copy()
    wide = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5))
    wide = wide[(raw[wide] != 0xC3) | ~_SIGN_SECOND[raw[wide + 1]]]
    first[wide] = True
    last[wide + 1] = True
    return first, last


def one_word(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pieces are such letters only, behind one blank at most: each is one pre-token, which the model encodes
    at once."""
    first, last = latin_letters(raw)
    other = np.concatenate(([0], np.cumsum(~(first | last))))
    blank = raw[starts] == 0x20
    return (other[ends] - other[starts] == blank) & (ends - starts > blank)


class Encoder:
    """Encodes texts with a `tokenizers` file, distinct pieces once per process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.byte_char = dict(enumerate(_byte_chars()))
        self.code_unit = np.array([ord(c) for c in _byte_chars()], "<u2")
        self._forget()

    def _forget(self) -> None:
        """An empty store: hashes in order and which piece each is of, and per piece its ids and bytes."""
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.raw = Spans(self.kind), Spans(np.uint8)

    def pieces(self, b: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of a block's pieces, and their offsets per text."""
        raw = b.raw
        blank = np.flatnonzero(BLANK[raw])
        blank = blank[blank > 0]
        last = raw[blank - 1]
        blank = blank[~(_ASCII_SPACE[last] | (_WIDE_LAST[last] & _WIDE_BEFORE[raw[blank - 2]] & (blank > 1)))]
        cut = np.zeros(len(raw), np.bool_)
        cut[blank] = True
        cut[b.at[:-1][np.diff(b.at) > 0]] = True
        if len(raw) > 1:
            first, last = latin_letters(raw)
            # A newline that begins a piece has no white space before it; if a letter follows, it stands alone.
            newline = np.flatnonzero((raw[:-1] == 0x0A) & cut[:-1])
            cut[newline[first[newline + 1]] + 1] = True
            cut[np.flatnonzero(last[:-1] & PUNCTUATION[raw[1:]]) + 1] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        return starts, ends, np.searchsorted(starts, b.at)

    def encode(self, b: tk.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and offsets per text."""
        starts, ends, per_text = self.pieces(b)
        order, rank, one = b.distinct(starts, ends)
        starts, ends = starts[one], ends[one]
        h = b.hashes(starts, ends)
        slot = self._known(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.hashes) + len(new) > MAX_KEPT:  # a full store is begun anew
                self._forget()
                new = np.arange(len(h))
            new = new[np.unique(h[new], return_index=True)[1]]
            self._learn(h[new], b.raw, starts[new], ends[new])
            slot = self._known(h)
        n, at, store = self.ids.size[slot], self.ids.at[slot], self.ids.flat
        # A piece whose hash another piece has in the store is encoded by itself.
        own = self.raw.size[slot] == ends - starts
        own[own] = tk.equal_spans(b.words(), starts[own], self.raw.words(), self.raw.at[slot[own]], (ends - starts)[own])
        for i in np.flatnonzero(~own).tolist():
            ids = self._ids(b.raw[starts[i] : ends[i]].tobytes())
            n[i], at[i] = len(ids), len(store)
            store = np.append(store, np.array(ids, self.kind))
        which = np.empty(len(order), np.int64)
        which[order] = rank
        n, at = n[which], at[which]
        to = np.concatenate(([0], np.cumsum(n)))
        ids = store[np.repeat(at - to[:-1], n) + np.arange(to[-1])]
        return ids, to[per_text]

    def _known(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, -1 if there is none."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.slots[at], -1)

    def _learn(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add pieces that are not in the store yet; their hashes are in order."""
        at = np.searchsorted(self.hashes, h)
        self.slots = np.insert(self.slots, at, len(self.hashes) + np.arange(len(h)))
        self.hashes = np.insert(self.hashes, at, h)
        flat, chars = raw.tobytes(), self.code_unit[raw].tobytes().decode("utf-16-le")
        tokenize, spans = self.tokenizer.model.tokenize, zip(starts.tolist(), ends.tolist(), one_word(raw, starts, ends).tolist(), strict=True)
        got = [[t.id for t in tokenize(chars[s:e])] if word else self._ids(flat[s:e]) for s, e, word in spans]
        self.ids.add(np.fromiter(itertools.chain.from_iterable(got), self.kind), [len(x) for x in got])
        n = ends - starts
        self.raw.add(raw[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())], n)

    def _ids(self, piece: bytes) -> list[int]:
        """A piece of one blank at most and letters only is one pre-token: the model encodes it at once."""
        word = piece[1:] if piece[:1] == b" " else piece
        if word.isalpha():  # ASCII letters
            return [t.id for t in self.tokenizer.model.tokenize(("Ġ" if len(word) < len(piece) else "") + word.decode())]
        text = word.decode()
        if text.isalpha() and max(text) < "\u0300":  # Latin letters
            return [t.id for t in self.tokenizer.model.tokenize(("Ġ" if len(word) < len(piece) else "") + word.decode("latin-1").translate(self.byte_char))]
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def symbol_bits(vocabulary: int) -> int:
    return 16 if vocabulary + LEAST_ROOM <= 1 << 16 else 32


def repair(ids: np.ndarray, at: np.ndarray, vocabulary: int, least_gain: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs by nonterminals: rules (left, right), expansion lengths, symbols, and
    each document's first symbol."""
    least_gain = LEAST_GAIN if least_gain is None else least_gain
    bits = symbol_bits(vocabulary)
    room = (1 << bits) - vocabulary
    kind = np.uint32 if bits == 16 else np.uint64  # of pairs
    seq = ids.astype(kind)
    head = np.zeros(len(seq), np.bool_)  # documents start here; no pair spans two
    head[at[:-1][at[:-1] < len(seq)]] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(seq) > 1 and n_rules < room:
        pair = (seq[:-1] << kind(bits)) | seq[1:]
        inner = ~head[1:]
        kinds, count = _counts(pair[inner])
        good = np.flatnonzero(count >= LEAST_USES)
        if not len(good):
            break
        good = good[np.argsort(-count[good], kind="stable")][: room - n_rules]
        rank = _lookup(pair, kinds[good], inner)  # 0: none; else larger is more frequent
        # A place is replaced if its pair beats both neighbours'; in a run of one pair, every other place is.
        take = rank > 0
        again = np.flatnonzero(take[1:] & (rank[1:] == rank[:-1])) + 1  # places of a run but its first
        here = np.arange(len(again))
        new = np.ones(len(again), np.bool_)
        new[1:] = again[1:] != again[:-1] + 1
        take[again[(here - np.maximum.accumulate(np.where(new, here, 0))) & 1 == 0]] = False
        take[1:] &= rank[1:] >= rank[:-1]
        take[:-1] &= rank[:-1] >= rank[1:]
        place = np.flatnonzero(take)
        used = np.bincount(rank[place], minlength=len(good) + 1)
        worth = used >= LEAST_USES
        worth[0] = False
        place = place[worth[rank[place]]]
        if not len(place) or len(place) < least_gain * len(seq):
            break
        number = np.cumsum(worth) - 1
        rules.append(kinds[good][::-1][np.flatnonzero(worth) - 1])
        seq[place] = (vocabulary + n_rules + number[rank[place]]).astype(kind)
        n_rules += int(worth.sum())
        keep = np.ones(len(seq), np.bool_)
        keep[place + 1] = False
        seq, head = seq[keep], head[keep]
    flat = np.concatenate(rules) if rules else np.zeros(0, kind)
    symbol = np.uint16 if bits == 16 else np.uint32
    sides = np.stack([flat >> kind(bits), flat & kind((1 << bits) - 1)], 1).astype(symbol)
    return sides, expansion_lengths(sides, vocabulary), seq.astype(symbol), np.flatnonzero(head)


def _counts(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(pair)
    if not len(s):
        return s, np.zeros(0, np.int64)
    cut = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
    return s[cut], np.diff(np.append(cut, len(s)))


def _lookup(pair: np.ndarray, best_first: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """For each place the rank of its pair: the number of chosen pairs for the best, 1 for the last, 0 for none.

    Ranks are kept in a table by a hash of the pair; of pairs in one cell the best stays, the others wait for a later
    round."""
    bits = 18
    kind, whole = pair.dtype.type, 8 * pair.dtype.itemsize
    hashed = lambda x: (x * kind(0x9E3779B97F4A7C15 >> (64 - whole) | 1)) >> kind(whole - bits)
    worst_first = best_first[::-1]
    table = np.zeros(1 << bits, np.int32)
    table[hashed(worst_first)] = np.arange(1, len(worst_first) + 1, dtype=np.int32)
    rank = table[hashed(pair)]
    rank[~inner | (np.concatenate((worst_first[:1], worst_first))[rank] != pair)] = 0
    return rank


def expansion_lengths(sides: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids to which each rule expands; a rule's sides are ids or earlier rules."""
    out = np.ones(vocabulary + len(sides), np.int64)
    left, right = sides[:, 0].astype(np.int64), sides[:, 1].astype(np.int64)
    done = 0
    while done < len(sides):  # as far as sides are known, a whole round at a time
        ready = np.maximum(left[done:], right[done:]) < vocabulary + done
        stop = len(sides) if ready.all() else done + int(np.argmin(ready))
        out[vocabulary + done : vocabulary + stop] = out[left[done:stop]] + out[right[done:stop]]
        done = stop
    return out[vocabulary:].astype(np.uint32)


def pack_block(doc_ids: list[int | None], counts: np.ndarray, sides: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, first: np.ndarray, vocabulary: int) -> bytes:
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<4I", len(docs), len(sides), len(symbols), vocabulary)
    symbol = f"<u{symbol_bits(vocabulary) // 8}"
    return b"".join([head, docs.tobytes(), nulls.tobytes(), counts.astype("<u4").tobytes(), first.astype("<u4").tobytes(), sides.astype(symbol).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(symbol).tobytes()])


class TokenBlock:
    """A block read back: `ids(i)` expands one document only."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        self.n, rules, symbols, self.vocabulary = struct.unpack_from("<4I", payload, 4)
        at = 20

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        symbol = f"<u{symbol_bits(self.vocabulary) // 8}"
        docs, nulls = read("<i8", self.n), read("<u1", self.n)
        self.doc_ids = [None if z else int(d) for d, z in zip(docs, nulls, strict=True)]
        self.counts, self.first = read("<u4", self.n), read("<u4", self.n)
        self.sides, self.lengths, self.symbols = read(symbol, 2 * rules).reshape(-1, 2), read("<u4", rules), read(symbol, symbols)
        self._lengths = np.concatenate((np.ones(self.vocabulary, np.int64), self.lengths))
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def ids(self, i: int) -> np.ndarray:
        """The ids of one document."""
        stop = self.first[i + 1] if i + 1 < self.n else len(self.symbols)
        return self._expand(self.symbols[self.first[i] : stop])

    def all_ids(self) -> np.ndarray:
        """The ids of all documents, one after another."""
        return self._expand(self.symbols)

    def span(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of one document: expansion lengths tell which symbols hold them."""
        stop = self.first[i + 1] if i + 1 < self.n else len(self.symbols)
        symbols = self.symbols[self.first[i] : stop]
        to = np.concatenate(([0], np.cumsum(self._lengths[symbols])))
        a, b = np.searchsorted(to, lo, "right") - 1, np.searchsorted(to, hi, "left")
        return self._expand(symbols[a:b])[lo - to[a] : hi - to[a]]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = self._expansions()
        ids, at = self._table
        n = self._lengths[symbols]
        to = np.concatenate(([0], np.cumsum(n)))
        out = np.repeat(symbols.astype(np.uint32), n)
        deep = np.flatnonzero(symbols >= self.vocabulary)
        if len(deep):
            m = n[deep]
            own = np.cumsum(m) - m
            inner = np.arange(int(m.sum()))
            out[np.repeat(to[deep] - own, m) + inner] = ids[np.repeat(at[symbols[deep] - self.vocabulary] - own, m) + inner]
        return out

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every rule, one after another, and where each begins."""
        n = self.lengths.astype(np.int64)
        at = np.cumsum(n) - n
        ids = np.zeros(int(n.sum()), np.uint32)
        left, right = self.sides[:, 0].astype(np.int64), self.sides[:, 1].astype(np.int64)
        done = 0
        while done < len(n):
            ready = np.maximum(left[done:], right[done:]) < self.vocabulary + done
            stop = len(n) if ready.all() else done + int(np.argmin(ready))
            for side, begin in ((left, at[done:stop]), (right, at[done:stop] + self._lengths[left[done:stop]])):
                s = side[done:stop]
                plain = s < self.vocabulary
                ids[begin[plain]] = s[plain]
                rule = s[~plain] - self.vocabulary
                m = n[rule]
                own = np.cumsum(m) - m
                inner = np.arange(int(m.sum()))
                ids[np.repeat(begin[~plain] - own, m) + inner] = ids[np.repeat(at[rule] - own, m) + inner]
            done = stop
        return ids, at


def _writer(path: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        shard, number = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            counts = np.concatenate(sizes)
            ids = np.concatenate(parts)
            at = np.concatenate(([0], np.cumsum(counts)))
            sides, lengths, symbols, first = repair(ids, at, enc.vocabulary)
            payload = pack_block(docs, counts, sides, lengths, symbols, first, enc.vocabulary)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "n_docs": [len(docs)], "n_tokens": [int(counts.sum())], "payload": [payload]})

        held = 0
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for b in tk.blocks(tk.string_column(batch, "text")):
                ids, at = enc.encode(b)
                # The end id after each document.
                out = np.full(len(ids) + b.n, END_ID, enc.kind)
                body = np.ones(len(out), np.bool_)
                body[at[1:] + np.arange(b.n)] = False
                out[body] = ids
                docs += ids_of[b.first : b.first + b.n]
                parts.append(out)
                sizes.append(np.diff(at) + 1)
                held += len(out)
                if held >= block_ids:
                    yield flush()
                    docs, parts, sizes, held, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return run


BLOCK_SCHEMA = "shard int, block int, n_docs long, n_tokens long, payload binary"


def write(documents: DataFrame, tokenizer_path: str, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write them as token blocks, in ascending doc_id order, to `path`."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(tokenizer_path, block_ids), BLOCK_SCHEMA).write.mode("overwrite").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            t = TokenBlock(payload.as_py())
            ids = t.all_ids().astype("<u4")
            at = np.concatenate(([0], np.cumsum(t.counts.astype(np.int64))))
            crc = [zlib.crc32(ids[at[i] : at[i + 1]]) for i in range(t.n)]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(t.n, shard, np.int32)), "block": pa.array(np.full(t.n, block, np.int32)), "doc_id": pa.array(t.doc_ids, pa.int64()),
                "inner": pa.array(at[:-1]), "n_tokens": pa.array(t.counts.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()),
            })


def read_report(spark, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens and ids_crc32 of each document."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", "n_tokens").withColumn("block_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    starts = starts.join(shards, F.col("shard") == F.col("s")).select(F.col("shard").alias("s"), F.col("block").alias("b"), (F.col("shard_start") + F.col("block_start")).alias("from"))
    rows = blocks.select("shard", "block", "payload").mapInArrow(_reader, "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    joined = rows.join(starts, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    return joined.select("doc_id", (F.col("from") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def report(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files to the shared folder and report each document from them."""
    spark = documents.sparkSession
    path = Scratch(spark, "tokens").path("blocks")
    write(documents, tokenizer_path, path)
    return read_report(spark, path)
