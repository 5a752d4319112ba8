"""SentencePiece segmentation by forward filtering and backward sampling over the piece lattice.

A segmentation's weight is the product of exp(temperature x score) over its pieces.  Forward filtering
sums the weights of all ways to each place of the lattice; backward sampling then draws the last
piece, the one before it and so on with their exact probabilities.  No piece holds a blank after
another character, so the lattice falls apart before each run of blanks: forward sums are computed
once per distinct unit of a block, and all occurrences are sampled together.

Random numbers are a hash of the row's key, the unit's number in the text and the draw: a row gets
the same pieces wherever and with whatever other rows it is processed.

Decoding is lossless: characters without a piece (a literal U+2581 among them) become byte pieces.

Defined results: a null or empty text has no pieces; a null key counts as key 0 of another seed;
repeated rows get equal pieces; an empty table gives an empty result; other columns are never looked
at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk

TEMPERATURE = 0.001
BLOCK_BYTES = 1 << 19
U64 = np.uint64
#: Chances are compared as whole numbers out of this many.
DRAWS = 1 << 31


class Pieces:
    """The pieces of a model, as bytes with the blank mark replaced by a blank."""

    def __init__(self, model_path: str, temperature: float):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.bytes: list[bytes] = []
        scores, normal = [], []
        self.byte_id = np.full(256, -1, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif p.type == kinds.NORMAL:
                self.bytes.append(p.piece.replace("▁", " ").encode())
                normal.append(i)
                scores.append(p.score)
            else:
                self.bytes.append(b"")
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        if any(b" " in self.bytes[i].lstrip(b" ") for i in normal):
            raise ValueError("a piece holds a blank after another character")
        self.ids = np.array(normal, np.int64)
        self.weight = np.array(scores) * temperature
        #: As the library does it, a character without a piece costs more than any piece.
        self.fallback = (min(x for x in scores if x > -1e8) - 10) * temperature
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        texts = [self.bytes[i] for i in normal]
        block = tk.Block(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64), 0)
        self.tables = {}
        length = np.diff(block.at)
        self.words, self.at = block.words(), block.at
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            h = np.zeros(len(texts), U64)
            for k in range(0, n, 8):
                h[at] = stir(h[at] ^ (self.words[block.at[at] + k] & tk.FIRST_BYTES[min(8, n - k)]))
            order = at[np.argsort(h[at])]
            bits = max(8, int(len(at)).bit_length() + 4)
            seen = np.zeros(1 << bits, np.bool_)
            seen[(h[at] >> U64(64 - bits)).astype(np.int64)] = True
            self.tables[n] = (h[order], order, seen, bits)

    def find(self, h: np.ndarray, n: int, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans of n bytes with these hashes are pieces, and which pieces (numbers into ids).

        Of spans up to eight bytes long the hash tells the bytes; those of longer ones are compared."""
        keys, order, seen, bits = self.tables[n]
        maybe = np.flatnonzero(seen[(h >> U64(64 - bits)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        ok = keys[slot] == h[maybe]
        maybe, piece = maybe[ok], order[slot[ok]]
        if n > 8:
            ok = tk.equal_spans(words, starts[maybe], self.words, self.at[piece], np.full(len(maybe), n))
            maybe, piece = maybe[ok], piece[ok]
        return maybe, piece


_pieces: dict[tuple[str, float], Pieces] = {}


def pieces(model_path: str, temperature: float = TEMPERATURE) -> Pieces:
    """The pieces of a model file, read once per process."""
    key = (model_path, temperature)
    if key not in _pieces:
        _pieces[key] = Pieces(model_path, temperature)
    return _pieces[key]


def stir(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers whose top bits depend on all bits."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    return x


class Lattice:
    """The lattices of some units: edges by the node at which they end, with cumulative chances."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, p: Pieces):
        block = tk.Block(raw, at, 0)
        size = np.diff(at)
        unit = np.repeat(np.arange(len(size)), size)
        left = at[1:][unit] - np.arange(len(raw))  # bytes from here to the unit's end
        lead = tk.LEAD[raw]
        words = block.words()
        begin = np.flatnonzero(lead)
        starts, lengths, which = [], [], []
        s, state, whole_words = begin, np.zeros(len(begin), U64), 0
        for n in sorted(p.tables):
            room = left[s] >= n
            s, state = s[room], state[room]
            if not len(s):
                break
            while 8 * whole_words + 8 < n:
                state = stir(state ^ words[s + 8 * whole_words])
                whole_words += 1
            h = stir(state ^ (words[s + 8 * whole_words] & tk.FIRST_BYTES[n - 8 * whole_words]))
            found, piece = p.find(h, n, words, s)
            starts.append(s[found])
            lengths.append(n)
            which.append(piece)
        whole = np.zeros(len(raw), np.bool_)  # characters that are a piece
        width = np.zeros(len(raw), np.int32)
        width[begin] = np.diff(np.concatenate((begin, [len(raw)])))
        for s, n in zip(starts, lengths, strict=True):
            whole[s[width[s] == n]] = True
        lone = begin[~whole[begin]]
        start = np.concatenate([*starts, lone]).astype(np.int32)
        piece = np.concatenate([*which, np.full(len(lone), len(p.ids))]).astype(np.int32)  # the last number: byte pieces
        length = np.concatenate([*(np.full(len(s), n, np.uint8) for s, n in zip(starts, lengths, strict=True)), width[lone].astype(np.uint8)])
        del starts, which, words, state, left
        # Edges by the node at which they end; a node is a byte place, and a unit's end is where the next starts.
        # Within a node by length, so that a draw never depends on what else is in the block.
        order = np.argsort((start + length).astype(np.int64) << 8 | length).astype(np.int32)
        self.start, self.length, piece = start[order], length[order], piece[order]
        del start, length, order
        self.ids = np.append(p.ids, -1).astype(np.int32)[piece]
        weight = np.append(p.weight, p.fallback)[piece]
        del piece
        end = self.start + self.length
        if not len(end):
            self.node, self.scale = np.zeros(len(raw) + 1, np.int64), np.zeros(0, np.int64)
            return
        first = np.concatenate(([0], np.flatnonzero(np.diff(end)) + 1))
        count = np.diff(np.append(first, len(end)))
        nodes = end[first]
        floor = at[:-1][unit[nodes - 1]]
        from_floor = self.start == np.repeat(floor, count)
        depth = np.minimum(nodes - floor, 65535).astype(np.uint16)
        by_depth = np.argsort(depth, kind="stable")
        if (nodes - floor).max() > 65535:
            by_depth = np.argsort(nodes - floor, kind="stable")
        level = (nodes - floor)[by_depth]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(level)]))
        alpha = np.zeros(len(raw) + 1)  # at each place but unit starts, where it is 0
        chance = np.empty(len(end))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = by_depth[lo:hi]
            n = count[own]
            begin_at = np.cumsum(n) - n
            edge = np.repeat(first[own] - begin_at, n) + np.arange(n.sum())
            v = weight[edge] + np.where(from_floor[edge], 0.0, alpha[self.start[edge]])
            top = np.maximum.reduceat(v, begin_at)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n)), begin_at))
            alpha[nodes[own]] = total
            chance[edge] = np.exp(v - np.repeat(total, n))
        self.node = np.zeros(len(raw) + 1, np.int64)
        self.node[nodes] = np.arange(len(nodes))
        del weight, end, from_floor, alpha
        # Chances are summed within each node alone, in edge order: the same sums wherever the unit stands.
        for k in range(1, int(count.max())):
            more = first[count > k] + k
            chance[more] += chance[more - 1]
        chance[np.append(first[1:], len(chance)) - 1] = 1.0
        np.minimum(chance, 1.0, out=chance)
        chance *= DRAWS
        self.scale = (np.repeat(np.arange(len(nodes)), count) << 32) + chance.astype(np.int64)

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge that ends at each place, for numbers u from 0 below DRAWS."""
        return np.searchsorted(self.scale, (self.node[place] << 32) + u, "right")


def units(b: tk.Block) -> tuple[tk.Block, np.ndarray, np.ndarray]:
    """The block with a blank before each text that is not empty, unit starts, and unit offsets per text."""
    size = np.diff(b.at)
    grow = (size > 0).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size + grow)))
    raw = np.full(at[-1], 32, np.uint8)
    put = np.ones(at[-1], np.bool_)
    put[at[:-1][size > 0]] = False
    raw[put] = b.raw
    blank = raw == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[at[:-1][size > 0]] = True
    starts = np.flatnonzero(begin)
    return tk.Block(raw, at, b.first), starts, np.searchsorted(starts, at)


def sample_block(b: tk.Block, keys: np.ndarray, p: Pieces, seed: int = 0) -> tuple[np.ndarray, np.ndarray, tk.Block]:
    """Piece ids of all texts, offsets per text, and the block with its leading blanks."""
    block, starts, per_text = units(b)
    ends = np.concatenate((starts[1:], [len(block.raw)])) if len(starts) else starts
    order, rank, one = block.distinct(starts, ends)
    size = ends[one] - starts[one]
    at = np.concatenate(([0], np.cumsum(size)))
    own = block.raw[np.repeat(starts[one] - at[:-1], size) + np.arange(at[-1])]
    del ends
    lattice = Lattice(own, at, p)
    text = tk.per_row(per_text)[order]
    number = order - per_text[:-1][text]
    row_seed = tk.mix(keys[text] + U64(seed & 0xFFFFFFFFFFFFFFFF)) ^ tk.mix(number.astype(U64) + U64(0x51ED270B))
    floor, place = at[:-1][rank], at[1:][rank]
    live = np.arange(len(order))
    drawn_by, drawn = [], []
    step = 0
    while len(live):
        r = tk.mix(row_seed[live] + U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        edge = lattice.draw(place[live], (r >> U64(33)).astype(np.int64))
        drawn_by.append(live.astype(np.int32))
        drawn.append(edge.astype(np.int32))
        place[live] = lattice.start[edge]
        live = live[place[live] > floor[live]]
        step += 1
    count = np.zeros(len(order), np.int64)
    for x in drawn_by:
        count[x] += 1
    by_unit = np.empty(len(order), np.int64)
    by_unit[order] = count
    offset = np.concatenate(([0], np.cumsum(by_unit)))[:-1][order] + count - 1
    edges = np.empty(int(count.sum()), np.int32)
    for k, (x, e) in enumerate(zip(drawn_by, drawn, strict=True)):
        edges[offset[x] - k] = e
    ids = lattice.ids[edges] if len(edges) else edges
    bounds = np.concatenate(([0], np.cumsum(by_unit)))[per_text]
    if (ids < 0).any():
        wide = np.where(ids < 0, lattice.length[edges], 1).astype(np.int64)
        to = np.concatenate(([0], np.cumsum(wide)))
        out = np.repeat(ids, wide)
        inside = np.arange(len(out)) - np.repeat(to[:-1], wide)
        lone = np.flatnonzero(out < 0)
        source = np.repeat(lattice.start[edges], wide)[lone] + inside[lone]
        out[lone] = p.byte_id[own[source]]
        ids, bounds = out, to[bounds]
    return ids.astype(np.int32), bounds, block


def decode(ids: np.ndarray, bounds: np.ndarray, p: Pieces) -> tk.Block:
    """The bytes of each text's pieces, its leading blank included."""
    n = p.lengths[ids]
    to = np.concatenate(([0], np.cumsum(n)))
    raw = p.flat[np.repeat(p.offsets[ids] - to[:-1], n) + np.arange(to[-1])]
    return tk.Block(raw, to[bounds], 0)


def decode_text(ids, p: Pieces) -> str:
    """The text of one row's pieces."""
    return b"".join(p.bytes[i] for i in ids).decode()[1:]


def _lossless(ids: np.ndarray, bounds: np.ndarray, block: tk.Block, p: Pieces) -> np.ndarray:
    back = decode(ids, bounds, p)
    if len(back.raw) == len(block.raw) and np.array_equal(back.at, block.at):
        return tk.sums(back.raw != block.raw, block.at) == 0
    return np.array([back.text(i) == block.text(i) for i in range(block.n)], np.bool_)


def _keys(column: pa.Array) -> np.ndarray:
    key = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return np.where(missing, U64(0xDEADBEEFCAFEF00D), key)


def _sampler(model_path: str, temperature: float, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path, temperature)
        for batch in batches:
            keys = _keys(batch.column(0))
            for b in tk.blocks(tk.string_column(batch, "text"), BLOCK_BYTES):
                ids, bounds, block = sample_block(b, keys[b.first : b.first + b.n], p, seed)
                columns = [batch.column(0).slice(b.first, b.n), pa.array(np.diff(bounds)), pa.array(_lossless(ids, bounds, block, p))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
                else:
                    raw = ids.astype("<u4")
                    columns.append(pa.array([zlib.crc32(raw[bounds[i] : bounds[i + 1]].tobytes()) for i in range(b.n)], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "lossless", "ids" if with_ids else "ids_crc32"])

    return run


def sample(documents: DataFrame, model_path: str, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, lossless (the pieces decode to the text) and ids of each row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sampler(model_path, temperature, seed, True), "doc_id long, n_pieces long, lossless boolean, ids array<int>")


def report(documents: DataFrame, model_path: str, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """As `sample`, with the crc32 of the ids as little-endian unsigned 32-bit integers in their place."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sampler(model_path, temperature, seed, False), "doc_id long, n_pieces long, lossless boolean, ids_crc32 long")
