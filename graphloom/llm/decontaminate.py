"""Benchmark decontamination with training suffix arrays.

Documents are cut into shards (blocks of whole texts); each shard gets a suffix array over its words.
Every suffix of every benchmark item is binary-searched in every shard, which yields its longest
verbatim match and the places that share a whole window of words.  The array holds the suffixes that
share their first two words with some test suffix (or the one word of a one-word item): no other can
hold a window or a match of two words.  Sorting stops at `DEPTH` words, deeper than any window, so all
windows are found exactly; longer matches are measured by walking on from the places found.  Each text's
longest match is returned with its place in the text and in an item, and so are the runs of words that lie in
windows.

The benchmark is handed out in blocks of at most `BLOCK_WORDS` words, one pass over the documents per
block, so what is broadcast has a fixed bound whatever the benchmark's size; a bitmap of the words hit
so far goes from pass to pass.

Defined results: null and empty texts have no words, are never hit and hit nothing; items without
words or with a null id give no window; equal items count each; repeated document rows are judged
each; an empty benchmark leaves all documents clean; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.scratch import Scratch

WINDOW = 10
#: Words by which suffixes are put in order, at least WINDOW.
DEPTH = 12
#: Words of benchmark items in one broadcast block: some 40 bytes each in a task.
BLOCK_WORDS = 2_000_000
_MATCH = ["longest", "match_word", "match_item", "match_item_word"]
#: Bytes of text in one shard.
SHARD_BYTES = 4 << 20
_BEST = "longest long, match_word long, match_item string, match_item_word long"
CARRY_SCHEMA = f"doc_id long, text string, hits binary, items array<string>, {_BEST}"
HIT_SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, {_BEST}, hit_spans array<struct<start:int,end:int>>"
#: A text's longest match: words, first word in the text, item, first word in the item.
Match = tuple[int, int | None, str | None, int | None]
NO_MATCH: Match = (0, None, None, None)


def item_words(texts: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text."""
    out: list[np.ndarray] = []
    for b in tk.blocks(texts):
        starts, ends, words = b.spans(tk.ALNUM[tk.LOWER[b.raw]])
        h = b.hashes(starts, ends, tk.LOWER)
        out += [h[words[i] : words[i + 1]] for i in range(b.n)]
    return out


class Benchmark:
    """The suffixes of some items: their word codes, and which windows start at them."""

    def __init__(self, ids: list[str], words: list[np.ndarray]):
        self.ids = ids
        flat = np.concatenate([w for w in words if len(w)] or [np.zeros(0, np.uint64)])
        self.vocabulary, codes = np.unique(flat, return_inverse=True)
        # Codes start at 1; 0 stands for any word no item has, and for the end of a text.
        codes = codes.reshape(-1).astype(np.int64) + 1
        self.n = len(codes)
        self.codes = np.concatenate((codes, np.zeros(DEPTH, np.int64)))
        lengths = np.array([len(w) for w in words], np.int64)
        self.item = np.repeat(np.arange(len(words)), lengths)
        begin = self.begin = np.cumsum(lengths) - lengths
        at = np.arange(self.n)
        self.left = begin[self.item] + lengths[self.item] - at  # words from here to the item's end
        width = np.minimum(lengths[self.item], WINDOW)
        self.width = np.where(self.left >= width, width, 0)  # 0: no window starts here
        self.size = len(self.vocabulary) + 1
        two = self.left > 1
        self.pairs = np.unique(codes[two] * self.size + self.codes[1 : self.n + 1][two])
        self.single = np.zeros(self.size, np.bool_)
        self.single[codes[(lengths[self.item] == 1)]] = True
        self.suffix = np.zeros((DEPTH, self.n), np.int64)
        for k in range(DEPTH):
            inside = self.left > k
            self.suffix[k, inside] = self.codes[:-DEPTH][at[inside] + k]


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), np.bool_)
    slot = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[slot] == x


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each want within its own [lo, hi) of a column that is sorted there."""
    lo, hi = lo.copy(), hi.copy()
    last = len(column) - 1
    while True:
        busy = np.flatnonzero(lo < hi)
        if not len(busy):
            return lo
        mid = (lo[busy] + hi[busy]) >> 1
        value = column[np.minimum(mid, last)]
        less = (value <= want[busy]) if right else (value < want[busy])
        lo[busy[less]] = mid[less] + 1
        hi[busy[~less]] = mid[~less]


class Shard:
    """The suffix array of a block of texts against one block of the benchmark."""

    def __init__(self, b: tk.Block, bench: Benchmark):
        self.bench = bench
        starts, ends, self.words = b.spans(tk.ALNUM[tk.LOWER[b.raw]])
        self.n, self.n_texts = len(starts), b.n
        h = b.hashes(starts, ends, tk.LOWER)
        slot = np.minimum(np.searchsorted(bench.vocabulary, h), max(len(bench.vocabulary) - 1, 0))
        codes = np.where(bench.vocabulary[slot] == h, slot + 1, 0) if len(bench.vocabulary) else np.zeros(self.n, np.int64)
        self.doc = tk.per_row(self.words)
        # A 0 at each text's end would shift positions; the text numbers are compared instead.
        self.codes = codes
        follow = np.zeros(self.n, np.int64)
        if self.n > 1:
            follow[:-1] = np.where(self.doc[1:] == self.doc[:-1], codes[1:], 0)
        at = np.flatnonzero((codes > 0) & (bench.single[codes] | (follow > 0)))
        key = codes[at] * bench.size + follow[at]
        at = at[_member(bench.pairs, key) | bench.single[codes[at]]]
        self.columns = self._columns(at)
        bits = max(1, int(bench.size).bit_length())
        per = 63 // bits
        keys = []
        for k in range(0, DEPTH, per):
            packed = np.zeros(len(at), np.int64)
            for column in self.columns[k : k + per]:
                packed = (packed << bits) | column
            keys.append(packed)
        order = np.lexsort(keys[::-1]) if len(at) else np.zeros(0, np.int64)
        self.array = at[order]
        self.columns = [c[order] for c in self.columns]

    def word(self, at: np.ndarray, k: int) -> np.ndarray:
        """The code k words after each position, 0 beyond its text."""
        to = at + k
        ok = to < self.n
        to = np.where(ok, to, 0)
        return np.where(ok & (self.doc[to] == self.doc[at]), self.codes[to], 0)

    def _columns(self, at: np.ndarray) -> list[np.ndarray]:
        """The first DEPTH codes of the suffixes; all 0 from the first word that no item has."""
        out, alive = [], np.ones(len(at), np.bool_)
        for k in range(DEPTH):
            c = np.where(alive, self.word(at, k), 0) if len(at) else np.zeros(0, np.int64)
            alive = c > 0
            out.append(c)
        return out

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix: words matched (up to DEPTH), its interval there, its window's interval."""
        bench, n = self.bench, self.bench.n
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.array), np.int64)
        matched = np.zeros(n, np.int64)
        window = np.zeros((2, n), np.int64)
        self.reach = np.zeros(len(self.array), np.int64)  # words that each suffix shares with any test suffix
        self.owner = np.zeros(len(self.array), np.int64)  # and one such test suffix
        live = np.arange(n) if len(self.array) else np.zeros(0, np.int64)
        for k in range(DEPTH):
            live = live[bench.suffix[k, live] > 0]
            if not len(live):
                break
            want, column = bench.suffix[k, live], self.columns[k]
            low = _bound(column, lo[live], hi[live], want, False)
            high = _bound(column, low, hi[live], want, True)
            ok = high > low
            live, low, high = live[ok], low[ok], high[ok]
            lo[live], hi[live], matched[live] = low, high, k + 1
            edges = np.bincount(low, minlength=len(self.array) + 1) - np.bincount(high, minlength=len(self.array) + 1)
            inside = np.cumsum(edges)[:-1] > 0
            self.reach[inside] = k + 1
            # Intervals of one depth are equal or apart: each place belongs to the last interval that begins before it.
            first = np.full(len(self.array), -1)
            first[low[::-1]] = live[::-1]
            at = np.maximum.accumulate(np.where(first >= 0, np.arange(len(first)), 0))
            self.owner[inside] = first[at[inside]]
            full = bench.width[live] == k + 1
            window[0, live[full]], window[1, live[full]] = low[full], high[full]
        return matched, lo, hi, window

    def longest(self, matched: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[Match]:
        """Per text, the longest verbatim match with any item (the first in the text of equal ones; none if under
        two words)."""
        out = np.zeros(self.n_texts, np.int64)
        place, who = np.zeros(self.n_texts, np.int64), np.zeros(self.n_texts, np.int64)

        def take(at: np.ndarray, test: np.ndarray, words: np.ndarray) -> None:
            order = np.lexsort((-test, -at, words))
            at, test, words = at[order], test[order], words[order]
            doc = self.doc[at]
            better = (words > out[doc]) | ((words == out[doc]) & (words > 0) & (at < place[doc]))
            at, test, words, doc = at[better], test[better], words[better], doc[better]
            out[doc], place[doc], who[doc] = words, at, test  # of several, the last: the longest, then the first in the text, then in the items

        take(self.array, self.owner, self.reach)
        deep = np.flatnonzero((matched == DEPTH) & (self.bench.left > DEPTH))
        upto = np.cumsum(hi[deep] - lo[deep])
        while len(deep):  # some millions of (suffix, place) pairs at a time, at least one suffix
            n = max(1, int(np.searchsorted(upto, 2_000_000)))
            t, many = deep[:n], (hi - lo)[deep[:n]]
            test = np.repeat(t, many)
            at = self.array[np.arange(len(test)) - np.repeat(np.cumsum(many) - many, many) + lo[test]]
            for k in range(DEPTH, int(self.bench.left[t].max())):
                more = (self.bench.left[test] > k) & (self.word(at, k) == self.bench.codes[np.minimum(test + k, self.bench.n)])
                test, at = test[more], at[more]
                if not len(at):
                    break
                take(at, test, np.full(len(at), k + 1))
            deep, upto = deep[n:], upto[n:] - upto[n - 1]
        item = self.bench.item[who] if self.bench.n else who
        word = place - self.words[:-1]
        return [(n, w, self.bench.ids[i], int(t - self.bench.begin[i])) if n else NO_MATCH for n, w, i, t in zip(out.tolist(), word.tolist(), item.tolist(), who.tolist(), strict=True)]

    def windows(self, window: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
        """Which words are hit, and per text the ids of the items with an occurring window."""
        mark = np.zeros(self.n + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        full = np.flatnonzero(window[1] > window[0])
        n_items = len(self.bench.ids)
        if len(full):
            key = np.stack([window[0, full], window[1, full], self.bench.width[full]], 1)
            distinct, which = np.unique(key, axis=0, return_inverse=True)
            which = which.reshape(-1)
            order = np.argsort(which, kind="stable")
            cut = np.searchsorted(which[order], np.arange(len(distinct) + 1))
            for k, (low, high, width) in enumerate(distinct):
                at = self.array[low:high]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + width, -1)
                docs = np.unique(self.doc[at])
                having = np.unique(self.bench.item[full[order[cut[k] : cut[k + 1]]]])
                pairs.append(np.add.outer(docs * n_items, having).reshape(-1))
        items: list[list[str]] = [[] for _ in range(self.n_texts)]
        for x in np.unique(np.concatenate(pairs)).tolist():
            items[x // n_items].append(self.bench.ids[x % n_items])
        return np.cumsum(mark)[:-1] > 0, items


def search_texts(texts: pa.Array, bench: Benchmark, before: list | None = None, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[np.ndarray, list[list[str]], Match]]:
    """Per text: which of its words are hit, ids of items with an occurring window, the longest match."""
    for b in tk.blocks(texts, shard_bytes):
        shard = Shard(b, bench)
        matched, lo, hi, window = shard.search()
        hit, items = shard.windows(window)
        longest = shard.longest(matched, lo, hi)
        for i in range(b.n):
            own = hit[shard.words[i] : shard.words[i + 1]]
            if before is not None and before[b.first + i] is not None:
                own = own | np.unpackbits(np.frombuffer(before[b.first + i], np.uint8), count=len(own)).astype(np.bool_)
            yield own, items[i], longest[i]


def runs(hit: np.ndarray) -> list[dict]:
    """The runs of true words, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]


def _pass(bench_cast, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = tk.string_column(batch, "text")
            before = None if first else tk.string_column(batch, "hits").to_pylist()
            found = list(search_texts(text, bench_cast.value, before))
            items = [x[1] for x in found]
            best = [x[2] for x in found]
            if not first:
                items = [a + b for a, b in zip(tk.string_column(batch, "items").to_pylist(), items, strict=True)]
                earlier = zip(*(tk.string_column(batch, c).to_pylist() for c in _MATCH), strict=True)
                best = [old if old[0] >= new[0] else new for old, new in zip(earlier, best, strict=True)]
            columns = zip(*best, strict=True) if best else [()] * 4
            tail = [pa.array(items, pa.list_(pa.string())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))]
            if last:
                counts = [pa.array([len(x[0]) for x in found], pa.int64()), pa.array([int(x[0].sum()) for x in found], pa.int64())]
                spans = pa.array([runs(x[0]) for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *tail, spans], ["doc_id", "n_words", "n_hit", "items", *_MATCH, "hit_spans"])
            else:
                hits = pa.array([np.packbits(x[0]).tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), text, hits, *tail], ["doc_id", "text", "hits", "items", *_MATCH])

    return run


def bench_blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Benchmark]:
    """The items in blocks of about `limit` words; the driver holds one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids: list[str] = []
    words: list[np.ndarray] = []
    n = 0
    for row in rows.toLocalIterator():
        w = item_words(pa.array([row["text"]], pa.string()))[0]
        if len(w) and row["item_id"] is not None:
            ids.append(row["item_id"])
            words.append(w)
            n += len(w)
        if n >= limit:
            yield Benchmark(ids, words)
            ids, words, n = [], [], 0
    yield Benchmark(ids, words)


def matches(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, the longest match and its places, and the runs of words hit, of each document
    row, over the whole benchmark."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = bench_blocks(benchmark, block_words)
    bench, first, scratch = next(parts), True, None
    while True:
        following = next(parts, None)
        cast = spark.sparkContext.broadcast(bench)
        rows = rows.mapInArrow(_pass(cast, first, following is None), HIT_SCHEMA if following is None else CARRY_SCHEMA)
        if following is None:
            return rows
        scratch = scratch or Scratch(spark, "decontaminate")
        rows, bench, first = scratch.put(rows, "hits"), following, False
        cast.destroy()


def items_digest(items) -> object:
    """sha256 of the sorted, comma-joined item ids."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(items)), ","), 256)


def report(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, items_sha256, contaminated, the longest match (words, first
    word in the text, item, first word in the item), and the runs of hit words as start:end, comma-joined."""
    found = matches(documents, benchmark, block_words)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(F.array_distinct("items")).cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.col("longest").alias("longest_match"), "match_word", "match_item", "match_item_word",
        F.array_join(F.transform("hit_spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("hit_spans"),
    )


def filter_documents(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that no window hits, with all their columns; nothing is shuffled.  Between two blocks of the benchmark
    the rows are written, so one block's words are held at a time."""
    spark, schema, scratch, cast = documents.sparkSession, documents.schema, None, None
    for bench in bench_blocks(benchmark, block_words):
        if cast is not None:
            scratch = scratch or Scratch(spark, "decontaminate")
            documents = scratch.put(documents, "clean")
            cast.destroy()
        cast = spark.sparkContext.broadcast(bench)

        def keep(batches: Iterator[pa.RecordBatch], cast=cast) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not x[0].any() for x in search_texts(tk.string_column(batch, "text"), cast.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(keep, schema)
    return documents
