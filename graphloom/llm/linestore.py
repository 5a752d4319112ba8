"""Line deduplication over levelled sorted runs of line hashes.

Each batch of documents (batches go from large ids to small) is reduced to one sorted run of line
keys with the number of documents that hold them.  A new batch is merge-anti-joined with the runs:
keys that no run has are fresh, and their largest document of this batch becomes the keeper, as no
later batch has a larger id.  The batch's own run is then added at level 0; `FANOUT` runs of one level
are compacted into one run of the next.  Merging all runs gives each key's documents and keeper.

Defined results: a null or empty text is one empty line; keys are counted once per doc_id, so
repeated rows count once and lose the same lines; rows with a null doc_id keep all lines and are not
counted; equal ids share one keeper; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.scratch import Scratch

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2


def line_keys(b: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a block: starts, ends, offsets per text, code points of the key, and two hashes of it."""
    starts, ends, lines = b.lines()
    solid = np.flatnonzero(tk.NONSPACE[b.raw])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = hi > lo
    first, last = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    first[some], last[some] = solid[lo[some]], solid[hi[some] - 1] + 1
    lead = np.concatenate(([0], np.cumsum(tk.LEAD[b.raw])))
    chars = lead[last] - lead[first]
    h1 = b.hashes(first, last, tk.LOWER)
    h2 = b.hashes(first, last, tk.LOWER, 1)
    return starts, ends, lines, chars, h1, h2


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in tk.blocks(tk.string_column(batch, "text")):
                _, _, lines, chars, h1, h2 = line_keys(b)
                long = np.flatnonzero(chars >= min_chars)
                row = tk.per_row(lines)[long]
                key = np.unique(np.stack([row.astype(np.int64), h1[long].view(np.int64), h2[long].view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[b.first + key[:, 0]].astype(np.int64)), pa.array(key[:, 1].copy()), pa.array(key[:, 2].copy())], ["doc_id", "h1", "h2"])

    return run


class LineStore:
    """Runs of line keys by level: h1, h2, n_docs, keeper (null where an older run has the keeper)."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []
        self.compactions = 0

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Take a batch of (doc_id, h1, h2): anti-join it with the runs and add it as a run."""
        own = lines.groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("largest"))
        known = None
        for r in self.runs():
            r = r.select("h1", "h2")
            known = r if known is None else known.unionByName(r)
        if known is None:
            run = own.withColumn("keeper", F.col("largest"))
        else:
            own = self.scratch.put(own, "batch")
            fresh = own.join(known, ["h1", "h2"], "left_anti").withColumn("keeper", F.col("largest"))
            run = fresh.unionByName(own.join(known, ["h1", "h2"], "left_semi").withColumn("keeper", F.lit(None).cast("long")))
        self._place(run.select("h1", "h2", "n_docs", "keeper"), 0)
        if known is not None:
            self.scratch.drop(own)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.scratch.put(run.sortWithinPartitions("h1", "h2"), f"level{level}"))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.compactions += 1
            self._place(merged(old), level + 1)
            self.scratch.drop(*old)

    def stats(self) -> DataFrame:
        """h1, h2, n_docs, keeper of every key seen."""
        return merged(self.runs())


def merged(runs: list[DataFrame]) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def dropped_lines(documents: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id and the list of keys (h1, h2) whose lines it loses; only documents that lose any."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    lines = rows.mapInArrow(_keys(min_chars), "doc_id long, h1 long, h2 long")
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("doc_id") > c).cast("int")
    lines = scratch.put(lines.distinct().withColumn("batch", batch), "lines", "batch")
    store = LineStore(scratch)
    for k in range(batches - 1, -1, -1):
        store.add(lines.filter(F.col("batch") == k).select("doc_id", "h1", "h2"))
    hot = store.stats().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    lost = lines.select("doc_id", "h1", "h2").join(hot, ["h1", "h2"]).filter(F.col("doc_id") != F.col("keeper"))
    out = scratch.put(lost.groupBy("doc_id").agg(F.collect_list("h1").alias("d1"), F.collect_list("h2").alias("d2")), "lost")
    scratch.drop(lines, *store.runs())
    return out


def drop_from(b: tk.Block, lost: dict[int, set[tuple[int, int]]]) -> Iterator[tuple[int, int, bytes]]:
    """Per text: lines before dropping, lines dropped, the text that stays."""
    if not lost:
        counts = tk.sums(b.raw == 10, b.at) + 1
        for i in range(b.n):
            yield int(counts[i]), 0, b.text(i)
        return
    starts, ends, lines, _, h1, h2 = line_keys(b)
    h1, h2 = h1.view(np.int64), h2.view(np.int64)
    for i in range(b.n):
        lo, hi = lines[i], lines[i + 1]
        gone = lost.get(i)
        if not gone:
            yield int(hi - lo), 0, b.text(i)
            continue
        keep = [k for k in range(lo, hi) if (int(h1[k]), int(h2[k])) not in gone]
        yield int(hi - lo), int(hi - lo) - len(keep), b"\n".join(b.raw[starts[k] : ends[k]].tobytes() for k in keep)


def _apply(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    d1, d2 = tk.string_column(batch, "__d1"), tk.string_column(batch, "__d2")
    for b in tk.blocks(tk.string_column(batch, "text")):
        lost = {}
        for i in range(b.n):
            if d1[b.first + i].is_valid:
                lost[i] = set(zip(d1[b.first + i].as_py(), d2[b.first + i].as_py(), strict=True))
        yield from drop_from(b, lost)


def _with_lost(documents: DataFrame, lost: DataFrame) -> DataFrame:
    lost = lost.select(F.col("doc_id").alias("__lost_id"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2"))
    # The list grows with the corpus: it is merged, never broadcast.
    return documents.join(lost.hint("merge"), F.col("doc_id").cast("long") == F.col("__lost_id"), "left").drop("__lost_id")


def report(documents: DataFrame, **rule) -> DataFrame:
    """One row per document row: n_lines before, n_dropped, kept_sha256 of the text that stays."""
    scratch = Scratch(documents.sparkSession, "linestore")
    lost = dropped_lines(documents, scratch, **rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, gone, hashlib.sha256(text).hexdigest()) for n, gone, text in _apply(batch)]
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_lost(rows, lost).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def filter_lines(documents: DataFrame, **rule) -> DataFrame:
    """Documents with their repeated lines gone and n_chars (if any) counted anew; no row goes."""
    scratch = Scratch(documents.sparkSession, "linestore")
    lost = dropped_lines(documents, scratch, **rule)
    schema = documents.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_apply(batch))
            valid = tk.string_column(batch, "text").is_valid().to_pylist()
            texts = [t.decode() if ok else None for (_, _, t), ok in zip(rows, valid, strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                old = columns[at].to_pylist()
                columns[at] = pa.array([len(t) if gone else o for (_, gone, _), t, o in zip(rows, texts, old, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_lost(documents, lost).mapInArrow(run, schema)
