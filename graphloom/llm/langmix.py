"""Language identification by mixture inference over byte n-grams.

Training sums the trigram counts of labelled texts per language over all of them.  A document is taken
for a mixture: expectation-maximisation estimates each language's share from the likelihoods of its
distinct n-grams.  Its language set is chosen by penalised likelihood: all single languages and the
full mixture are compared first, and where the mixture gains more than its penalty, the language with
the smallest share leaves for as long as the penalised likelihood does not fall.

Defined results: a null text, or one without a letter, is `und` with score 0, as is any text if nothing
could be learned; rows with a null doc_id or lang teach nothing; ties go to the language that sorts
first; repeated rows count each; an empty table gives an empty result; other columns are never
looked at, and lang only in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk

#: N-gram buckets of each language, 2 to this power, of 4 bytes: some hundreds of languages make some tens of megabytes.
BITS = 16
SMOOTHING = 0.5
ROUNDS = 8
#: Natural-log likelihood that one more language has to gain, times half the log of the n-grams: they overlap and depend.
PENALTY = 6.0

# Letters of ASCII lower-cased, bytes beyond it as they are, all else one blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(b: tk.Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram within a text that is not all blank, and its text."""
    f = FOLD[b.raw].astype(np.uint32)
    n = max(0, len(f) - 2)
    key = (f[:n] << np.uint32(16)) | (f[1 : n + 1] << np.uint32(8)) | f[2 : n + 2]
    # Only starts whose three bytes lie in one text.
    within = np.ones(n, np.bool_)
    for cut in (b.at[1:-1] - 1, b.at[1:-1] - 2):
        within[cut[(cut >= 0) & (cut < n)]] = False
    within &= (key != 0x202020) & ((key & 0xFFFF00) != 0x202000)
    at = np.flatnonzero(within)
    bucket = ((key[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
    return bucket, np.searchsorted(b.at, at, "right") - 1


def _count(languages: list[str], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = {x: i for i, x in enumerate(languages)}
        total = np.zeros(len(languages) << bits, np.int64)
        for batch in batches:
            lang = np.array([slot.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for b in tk.blocks(tk.string_column(batch, "text")):
                bucket, row = grams(b, bits)
                of = lang[b.first + row]
                total += np.bincount((of[of >= 0] << bits) + bucket[of >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


class Model:
    def __init__(self, languages: list[str], bits: int, counts: np.ndarray):
        self.languages, self.bits = languages, bits
        table = counts.reshape(len(languages), 1 << bits).T + SMOOTHING
        self.p = np.ascontiguousarray(table / table.sum(0, keepdims=True), dtype=np.float64).astype(np.float32)


def train(labelled: DataFrame) -> Model:
    """From columns lang and text: counts of all rows, summed per task before they are shuffled."""
    labelled = labelled.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().toLocalIterator())
    bits = BITS
    if not languages:
        return Model([], bits, np.zeros((0, 1 << bits)))
    cells = labelled.mapInArrow(_count(languages, bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) << bits)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return Model(languages, bits, counts)


def _mixture(p: np.ndarray, n: np.ndarray, at: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM shares of the allowed languages of each document, and its log-likelihood.

    p: likelihoods of the distinct n-grams, n: their counts, at: document offsets into both."""
    doc = tk.per_row(at)
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.maximum(np.add.reduceat(n, at[:-1]), 1e-30)[:, None]
    for _ in range(rounds):
        r = p * share[doc]
        r *= (n / r.sum(1))[:, None]
        share = np.add.reduceat(r, at[:-1], axis=0) / total
    like = np.add.reduceat(n * np.log((p * share[doc]).sum(1)), at[:-1])
    return share, like


def infer(p: np.ndarray, n: np.ndarray, at: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the chosen languages of each document (rows sum to 1), and the posterior of the best single one."""
    p = p.astype(np.float64)
    single = np.add.reduceat(n[:, None] * np.log(p), at[:-1], axis=0)
    best = single.argmax(1)
    docs = len(at) - 1
    chosen = np.zeros((docs, p.shape[1]))
    chosen[np.arange(docs), best] = 1
    posterior = 1 / np.exp(np.minimum(single - single.max(1, keepdims=True), 0)).sum(1)
    if p.shape[1] > 1:
        unit = penalty * 0.5 * np.log(np.maximum(np.add.reduceat(n, at[:-1]), 2))
        allowed = np.ones((docs, p.shape[1]))
        share, like = _mixture(p, n, at, allowed)
        value = like - unit * (allowed.sum(1) - 1)
        # The gain of a mixture can't exceed that of all languages: others stay with a single one.
        open_ = np.flatnonzero(like - single.max(1) > unit)
        while len(open_):
            pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in open_])
            own = np.concatenate(([0], np.cumsum(at[open_ + 1] - at[open_])))
            fewer = allowed[open_].copy()
            low = np.where(fewer > 0, share[open_], np.inf).argmin(1)
            fewer[np.arange(len(open_)), low] = 0
            s, like = _mixture(p[pick], n[pick], own, fewer)
            v = like - unit[open_] * (fewer.sum(1) - 1)
            better = v >= value[open_]
            stay = open_[~better]
            chosen[stay] = share[stay]
            moved = open_[better]
            allowed[moved], share[moved], value[moved] = fewer[better], s[better], v[better]
            done = moved[allowed[moved].sum(1) == 1]
            chosen[done] = share[done]
            open_ = moved[allowed[moved].sum(1) > 1]
    return chosen, posterior


def has_letter(b: tk.Block) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letters = tk.sums((FOLD[b.raw] != 32) & (b.raw < 128), b.at) > 0
    for i in np.flatnonzero(~ascii_letters & (tk.sums(b.raw >= 128, b.at) > 0)):
        ascii_letters[i] = any(c.isalpha() for c in b.text(i).decode("utf-8", "replace"))
    return ascii_letters


def predict_block(b: tk.Block, model: Model) -> tuple[list[str], list[float], list[str]]:
    """Language, score and the chosen set (lang:share) of each text."""
    lang, score, mixture = ["und"] * b.n, [0.0] * b.n, [""] * b.n
    letters = has_letter(b)
    bucket, row = grams(b, model.bits)
    some = np.bincount(row, minlength=b.n) > 0
    if not model.languages:
        return lang, score, mixture
    prior = np.full(len(model.languages), 1 / len(model.languages))
    for i in np.flatnonzero(letters & ~some):  # one or two bytes
        lang[i], score[i] = model.languages[0], float(prior[0])
    if len(bucket):
        key, n = np.unique((row.astype(np.int64) << model.bits) | bucket, return_counts=True)
        doc = key >> model.bits
        present = np.flatnonzero(some)
        at = np.concatenate((np.searchsorted(doc, present), [len(doc)]))
        shares, posterior = infer(model.p[key & ((1 << model.bits) - 1)], n.astype(np.float64), at)
        for i, share, sure in zip(present.tolist(), shares, posterior.tolist(), strict=True):
            if letters[i]:
                k = int(share.argmax())
                lang[i], score[i] = model.languages[k], round(float(share[k]) * sure if (share > 0).sum() == 1 else float(share[k]), 6)
                mixture[i] = ",".join(f"{model.languages[j]}:{share[j]:.3f}" for j in np.flatnonzero(share > 0))
    return lang, score, mixture


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and mixture of each row's whole text."""
    cast = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [predict_block(b, cast.value) for b in tk.blocks(tk.string_column(batch, "text"))]
            lang, score, mixture = ([x for p in parts for x in p[k]] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())], ["doc_id", "lang_pred", "score", "mixture"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def held_out() -> object:
    """The fold that is never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2, F.lit(False))


def report(documents: DataFrame) -> DataFrame:
    """One row per document row: held_out, lang_pred, score, mixture."""
    learned = documents.filter(F.col("doc_id").isNotNull() & ~held_out())
    return predict(documents, train(learned)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "mixture")
