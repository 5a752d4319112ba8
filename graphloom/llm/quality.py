"""Quality rules with host verdicts.

Rules are measured per document in one vectorised pass.  Rule failures are summed by host (the
`source` column), each host's failure rate is shrunk towards the corpus with a beta prior whose two
parameters are fitted to the hosts by moments, and documents of hosts whose shrunk rate is above
`max_host_rate` go, besides those that fail on their own.

Defined results: a null or empty text has no words and fails; a row with a null host is judged by its
own rules only; repeated rows are counted and judged each; an empty table gives an empty result;
other columns of the input are never looked at (the filter passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.scratch import Scratch

SYMBOLS = tk.byte_class(b"#*$%&|<>")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUP_LINES_PERCENT = 30
#: Fewer repeated lines than this are no fault, however short the text.
LEAST_DUP_LINES = 3
MAX_HOST_RATE = 0.75

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure_block(b: tk.Block) -> np.ndarray:
    """One row per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    inside = tk.NONSPACE[b.raw]
    starts, ends, words = b.spans(inside)
    n_words = np.diff(words)
    word_chars = tk.sums(inside & tk.LEAD[b.raw], b.at)
    n_symbols = tk.sums(SYMBOLS[b.raw], b.at)

    line_start, line_end, lines = b.lines()
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    row = tk.per_row(lines)[has_word]
    h = b.hashes(line_start[has_word], line_end[has_word])
    n_lines = np.bincount(row, minlength=b.n)
    key = tk.mix(h ^ row.astype(tk.U64) * tk.U64(0xA0761D6478BD642F))
    _, first = np.unique(key, return_index=True)
    n_dup_lines = n_lines - np.bincount(row[first], minlength=b.n)

    n_repeat = np.zeros(b.n, np.int64)
    if len(starts) > 3:
        w = b.hashes(starts, ends)
        doc = tk.per_row(words)
        at = np.flatnonzero(doc[:-2] == doc[2:])
        if len(at):
            window = tk.mix(w[at] + tk.U64(3) * tk.mix(w[at + 1]) + tk.U64(7) * tk.mix(w[at + 2] + tk.U64(5)))
            window ^= doc[at].astype(tk.U64) * tk.U64(0xA0761D6478BD642F)
            order = np.argsort(window)
            s = window[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), np.bool_)
            twice[1:] |= same
            twice[:-1] |= same
            hit = at[order[twice]]
            covered = np.zeros(len(starts), np.bool_)
            for k in range(3):
                covered[hit + k] = True
            n_repeat = tk.sums(covered, words)
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines], 1).astype(np.int64)


def measure_batch(texts: pa.Array) -> np.ndarray:
    parts = [measure_block(b) for b in tk.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(_NAMES)), np.int64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = measure_batch(tk.string_column(batch, "text"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(m[:, i]) for i in range(len(_NAMES)))], ["doc_id", "host", *_NAMES])


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, host and the measures of each row's whole text."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), F.col("text").cast("string"))
    return rows.mapInArrow(_measured, f"doc_id long, host string, {MEASURES}")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def own_failed():
    """Any rule of a document's own: the base rules, symbols per word, repeated lines."""
    return base_failed() | (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * F.col("n_words")) | ((F.col("n_dup_lines") >= LEAST_DUP_LINES) & (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines")))


def own_failed_rows(m: np.ndarray) -> np.ndarray:
    """The same rules over an array of measures."""
    n_words, _, n_symbols, n_dup, n_repeat, n_lines = m.T
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words) | (100 * n_symbols > MAX_SYMBOLS_PER_100_WORDS * n_words) | ((n_dup >= LEAST_DUP_LINES) & (100 * n_dup > MAX_DUP_LINES_PERCENT * n_lines))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Moment estimates of the beta prior over host failure rates; the driver gets six sums."""
    t = hosts.agg(
        F.sum("n").cast("double").alias("n"), F.sum("failed").cast("double").alias("f"), F.count("*").cast("double").alias("h"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("ff"),
    ).first()
    if not t["n"]:
        return 1.0, 1.0
    return moments(t["n"], t["f"], t["h"], t["nn"], t["ff"])


def moments(n: float, f: float, h: float, nn: float, ff: float) -> tuple[float, float]:
    """Beta parameters from sums over hosts: n, failures f, hosts h, n squared nn, f squared by n ff."""
    m = min(max(f / n, 1e-6), 1 - 1e-6)
    spread = ff - f * f / n - (h - 1) * m * (1 - m)
    room = n - nn / n
    between = spread / room if room > 0 else 0.0
    weight = m * (1 - m) / between - 1 if between > 0 else 1e6
    weight = min(max(weight, 1.0), 1e6)
    return m * weight, (1 - m) * weight


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed and the shrunk failure rate; one row per host that is not null."""
    hosts = measured.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(own_failed().cast("long")).alias("failed"))
    a, b = beta_prior(hosts)
    return hosts.withColumn("host_rate", (F.lit(a) + F.col("failed")) / (F.lit(a + b) + F.col("n")))


def verdicts(documents: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per input row: the measures, base_failed, host_rate (null without a host) and kept."""
    scratch = Scratch(documents.sparkSession, "quality")
    measured = scratch.put(measure(documents), "measured")
    # Written first, so its size is known when the join is planned: it is broadcast only if that is small.
    hosts = scratch.put(host_rates(measured).select("host", "host_rate"), "hosts")
    joined = measured.join(hosts, "host", "left")
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("kept", ~own_failed() & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "n_lines")
    )


def filter_documents(documents: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The kept rows with all their columns.  Texts are not shuffled: rules are measured once for the
    host verdicts, and again in the pass that filters."""
    scratch = Scratch(documents.sparkSession, "quality")
    measured = scratch.put(measure(documents), "measured")
    bad = scratch.put(host_rates(measured).filter(F.col("host_rate") > max_host_rate).select(F.col("host").alias("__bad_host")), "bad")
    scratch.drop(measured)
    schema = documents.schema
    if not bad.isEmpty():
        documents = documents.join(bad, F.col("source").cast("string") == F.col("__bad_host"), "left_anti")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = own_failed_rows(measure_batch(tk.string_column(batch, "text")))
            yield batch.filter(pa.array(~failed))

    return documents.mapInArrow(keep, schema)
