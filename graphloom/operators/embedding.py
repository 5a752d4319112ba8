"""Embedding texts over a given callable, the cache of embeddings, texts prepared for it, and related symbols.

No model comes with the library: a provider is a function from a list of texts to a list of vectors, called on the
executors once per batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.upsert import upsert
from graphloom.operators.vectors import content_id, query_vector, scored
from graphloom.plans.model import Graph, twin
from graphloom.staging import shared_path

Provider = Callable[[list[str]], list[list[float]]]
CACHE = ["cache_id", "model", "embedding", "used", "bytes"]


def prepare_text(language: Column, file: Column, kind: Column, name: Column, docstring: Column, code: Column) -> Column:
    """A chunk of code with its context in comment lines above it; lines of what is null are left out."""
    line = lambda *parts: F.concat(F.lit("// "), *parts)
    return F.concat_ws("\n", line(F.lit("Language: "), language), line(F.lit("File: "), file), F.when(name.isNotNull(), line(kind, F.lit(": "), name)), F.when(docstring.isNotNull(), line(docstring)), F.lit(""), code)


def embed(texts: DataFrame, provider: Provider, batch: int = 100) -> DataFrame:
    """texts (id, text) with the provider's vectors; null and empty texts have none.

    The provider gets at most `batch` texts at a time, and is sent to the executors with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(rows), batch):
                part = rows[lo : lo + batch]
                some = [i for i, t in enumerate(part) if t]
                vectors: list = [None] * len(part)
                for i, v in zip(some, provider([part[i] for i in some]) if some else [], strict=True):
                    vectors[i] = list(map(float, v))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), pa.array(vectors, pa.list_(pa.float32()))], ["id", "embedding"])

    return texts.select(F.col("id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "id string, embedding array<float>")


def embed_cached(texts: DataFrame, cache: DataFrame, provider: Provider, model: str, now: int) -> tuple[DataFrame, DataFrame]:
    """(id, embedding) of texts, and the cache with what it lacked; each distinct text is embedded once."""
    keyed = texts.select("id", "text", content_id(model, F.col("text")).alias("cache_id"))
    missing = keyed.groupBy(F.col("cache_id").alias("id")).agg(F.min("text").alias("text")).join(cache.select(F.col("cache_id").alias("id")), "id", "left_anti")
    made = embed(missing, provider).filter("embedding is not null").select(F.col("id").alias("cache_id"), F.lit(model).alias("model"), "embedding", F.lit(now).cast("long").alias("used"), (F.size("embedding") * 4).cast("long").alias("bytes"))
    whole = cache_set(cache, made)
    return keyed.join(whole.select("cache_id", "embedding"), "cache_id").select("id", "embedding"), whole


def cache_set(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace those of their id."""
    return upsert(cache.select(*CACHE), entries.select(*CACHE), ["cache_id"])


def cache_export(cache: DataFrame, path: str) -> None:
    """The cache as JSON lines."""
    cache.write.mode("overwrite").json(path)


def cache_import(cache: DataFrame, path: str) -> DataFrame:
    """Entries of a file that the cache has not; those that it has stay."""
    read = cache.sparkSession.read.schema(cache.select(*CACHE).schema).json(path)
    return cache.select(*CACHE).unionByName(read.join(cache.select("cache_id"), "cache_id", "left_anti").select(*CACHE))


def cache_evict(cache: DataFrame, target: int) -> DataFrame:
    """What stays: the entries used last, as long as they fit into `target` bytes together."""
    from graphloom.operators.windows import lru_evict

    entries = cache.select(F.col("cache_id").alias("id"), F.col("used").alias("accessed"), F.floor(F.col("used") / 3600).alias("hour"), "bytes")
    return cache.join(lru_evict(entries, target).withColumnRenamed("id", "cache_id"), "cache_id", "left_anti").select(*CACHE)


def migrate(vectors: DataFrame, texts: DataFrame, provider: Provider, dimension: int) -> DataFrame:
    """Vectors of another dimension than the model's made anew from their texts (id, text); others stay."""
    old = vectors.filter(F.size("embedding") == dimension).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    stale = vectors.filter(F.size("embedding") != dimension).select("id")
    return old.unionByName(embed(texts.join(stale, "id", "left_semi"), provider))


def related_symbols(summaries: DataFrame, query: list[float], current: str, limit: int = 5) -> DataFrame:
    """Symbols whose summaries are nearest to a summary, without the current symbol: one more than `limit` are fetched,
    those whose id holds the current symbol's name go, then the limit.  summaries: id, file, embedding."""
    hits = scored(summaries, query).orderBy(F.desc("score"), "id").limit(limit + 1).filter(~F.col("id").contains(current))
    return hits.orderBy(F.desc("score"), "id").limit(limit).select(F.element_at(F.split("id", ":"), -1).alias("name"), "file", "score")


def demo_provider(texts: list[str]) -> list[list[float]]:
    """Four numbers from the first bytes of a text's SHA-256: for tests and the registered queries."""
    return [[b / 256 for b in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]


def _prepared(g: Graph) -> DataFrame:
    s = g.symbols.join(g.files.select(F.col("path").alias("file"), "language"), "file")
    doc = F.when(F.col("complexity") % 2 == 0, F.col("docstring"))
    return s.select(F.col("qualified_name").alias("id"), prepare_text(F.col("language"), F.col("file"), F.col("kind"), F.col("name"), doc, F.col("signature")).alias("text"))


def _empty_cache(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([], "cache_id string, model string, embedding array<float>, used long, bytes long")


def _cache(g: Graph) -> DataFrame:
    """A cache with the document texts of two thirds of the documents, used in the order of their ids."""
    rows = g.documents.filter("doc_id % 3 != 0").groupBy(content_id("m", F.col("text")).alias("cache_id")).agg(F.max("doc_id").alias("doc_id"))
    return rows.select("cache_id", F.lit("m").alias("model"), F.array(F.lit(0.5)).cast("array<float>").alias("embedding"), (F.col("doc_id") * 100).alias("used"), (F.col("doc_id") % 9 + 4).cast("long").alias("bytes"))


def _embedded(g: Graph) -> DataFrame:
    out = embed(g.documents.select(F.col("path").alias("id"), "text"), demo_provider)
    return out.select("id", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[3].cast("double"), 6).alias("last"))


def _cached(g: Graph) -> DataFrame:
    found, _ = embed_cached(g.documents.select(F.col("path").alias("id"), "text"), _cache(g), demo_provider, "m", 10**9)
    return found.select("id", F.size("embedding").alias("size"))


def _round_trip(g: Graph) -> DataFrame:
    where = shared_path(g.spark, "embeddings")
    cache_export(_cache(g), where)
    return cache_import(_cache(g).filter("bytes > 8"), where).select("cache_id", "model", "used", "bytes")


def _summaries(g: Graph) -> DataFrame:
    return g.vectors.select(F.concat(F.lit("symbol:"), "qualified_name").alias("id"), "embedding", F.col("language").alias("file"))


def _migrated(g: Graph) -> DataFrame:
    short = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    vectors = g.vectors.select("id", short.alias("embedding"))
    out = migrate(vectors, g.vectors.select("id", F.col("qualified_name").alias("text")), demo_provider, 64)
    return out.select("id", F.size("embedding").alias("size"))


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


QUERIES = {
    "prepare_text": _q(_prepared),
    "embed_batch": _q(_embedded),
    "embed_cached": _q(_cached),
    "embed_cache_import": _q(_round_trip),
    "embed_cache_evict": _q(lambda g: cache_evict(_cache(g), 1000).select("cache_id")),
    "embed_migrate": _q(_migrated),
    "related_symbols": _q(lambda g: related_symbols(_summaries(g), query_vector(g, 3), "part:3").select("name", "file", F.round("score", 6).alias("score"))),
}
_CA = r", ca AS (SELECT sha256('m:' || regexp_replace(trim(text, ' '), '\s+', ' ', 'g'))[1:16] AS cache_id, max(doc_id) AS doc_id FROM docs WHERE doc_id % 3 <> 0 GROUP BY 1)"
_BYTE = "('0x' || sha256(text)[{}:{}])::INT / 256"
ORACLES = {k: twin(v) for k, v in {
    "prepare_text": "SELECT qualified_name AS id, '// Language: ' || language || chr(10) || '// File: ' || file || chr(10) || '// ' || kind || ': ' || name || chr(10) || CASE WHEN s.complexity % 2 = 0 THEN '// ' || docstring || chr(10) ELSE '' END || chr(10) || signature AS text FROM symbols s JOIN files ON path = file",
    "embed_batch": f"SELECT path AS id, CASE WHEN text <> '' THEN 4::INT END AS size, CASE WHEN text <> '' THEN round({_BYTE.format(1, 2)}, 6) END AS first, CASE WHEN text <> '' THEN round({_BYTE.format(7, 8)}, 6) END AS last FROM docs",
    "embed_cached": _CA + r" SELECT path AS id, CASE WHEN cache_id IS NULL THEN 4 ELSE 1 END::INT AS size FROM (SELECT *, sha256('m:' || regexp_replace(trim(text, ' '), '\s+', ' ', 'g'))[1:16] AS k FROM docs) LEFT JOIN ca ON cache_id = k WHERE cache_id IS NOT NULL OR text <> ''",
    "embed_cache_import": _CA + " SELECT cache_id, 'm' AS model, doc_id * 100 AS used, doc_id % 9 + 4 AS bytes FROM ca",
    "embed_cache_evict": _CA + " SELECT cache_id FROM (SELECT cache_id, sum(doc_id % 9 + 4) OVER (ORDER BY doc_id DESC, cache_id ROWS UNBOUNDED PRECEDING) AS kept FROM ca) WHERE kept <= 1000",
    "embed_migrate": "SELECT id, CASE WHEN vec_id % 5 = 0 THEN 4 ELSE 64 END::INT AS size FROM vectors",
    "related_symbols": "SELECT split_part(qualified_name, ':', 2) AS name, language AS file, round(s, 6) AS score FROM (SELECT v.*, list_dot_product(v.embedding, q.embedding) / (sqrt(list_dot_product(v.embedding, v.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))) AS s FROM vectors v, (SELECT embedding FROM vectors WHERE vec_id = 3) q ORDER BY s DESC, 'symbol:' || qualified_name LIMIT 6) WHERE NOT contains('symbol:' || qualified_name, 'part:3') ORDER BY s DESC LIMIT 5",
}.items()}
