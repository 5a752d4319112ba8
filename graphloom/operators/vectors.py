"""Vector similarity and hierarchical search over embedding tables.

Similarities are computed in double precision.  A set of queries is compared with all vectors in blocks
of matrix products: in single precision, with its error allowed for, to find which pairs can be among the
best, and those in double precision.  Each task keeps the best of every query before rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin
from graphloom.staging import shared_path

#: Bytes of queries that are broadcast at once, and how many queries and vectors are multiplied at once.
QUERY_BYTES, QUERY_ROWS, VECTOR_ROWS = 16 << 20, 512, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths and for a zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Vectors with their similarity to one query; the query's norm is folded in as a constant."""
    q = F.array(*map(F.lit, query))
    return vectors.withColumn("score", cosine(F.col("embedding"), q))


def search(vectors: DataFrame, query: list[float], limit: int = 10, min_score: float = 0.5, language: str | None = None, file: str | None = None) -> DataFrame:
    """Filter, score, drop low scores, then take the best."""
    if language:
        vectors = vectors.filter(F.col("language") == language)
    if file:
        vectors = vectors.filter(F.col("file").contains(file))
    return scored(vectors, query).filter(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(limit)


def search_then_filter(vectors: DataFrame, query: list[float], limit: int, min_score: float) -> DataFrame:
    """Take the best first and drop low scores after: fewer than `limit` rows may be left."""
    return scored(vectors, query).orderBy(F.desc("score"), "id").limit(limit).filter(F.col("score") >= min_score)


def search_levels(vectors: DataFrame, query: list[float], levels: list[int], per_level: int = 5) -> DataFrame:
    """The best of each level, in one pass."""
    w = Window.partitionBy("level").orderBy(F.desc("score"), "id")
    return scored(vectors.filter(F.col("level").isin(levels)), query).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_level)


def _odd(v: Column) -> Column:
    """Vectors that aren't compared as matrices: null, or with null, infinite, very large or very small elements."""
    plain = lambda x: F.coalesce((x == 0) | F.abs(x).between(1e-100, 1e100), F.lit(False))
    return F.coalesce(F.exists(v, lambda x: ~plain(x)), F.lit(True))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of length 1 (or 0) of each block of (id, vector), vectors of one dimension."""
    for whole in batches:
        for at in range(0, len(whole), most):
            batch = whole.slice(at, most)
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            offsets = lists.offsets.to_numpy()
            values, sizes = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = values[offsets[rows][:, None] + np.arange(size)]
                norms = np.sqrt((x * x).sum(1, keepdims=True))
                yield [ids[i] for i in rows], np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, x in _blocks(batches, QUERY_ROWS):
        yield pa.RecordBatch.from_pydict({"ids": [ids], "size": [x.shape[1]], "x": [x.tobytes()]})


def _few(ids: list, x: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """The rows in order of their ids; of equal vectors, those that can be among the k first without one id."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, x = [ids[i] for i in order], x[order]
    if not x.shape[1]:
        return ids, x
    kind = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1]
    if kind.max() + 1 == len(ids):
        return ids, x
    seen, keep = {}, []
    for i, (c, name) in enumerate(zip(kind.tolist(), ids)):
        names = seen.setdefault(c, {})
        if name in names or len(names) <= k:
            names[name] = names.get(name, 0) + 1
            if names[name] <= k:
                keep.append(i)
    return [ids[i] for i in keep], x[keep]


def _nearest(cast, k: int, digits: int | None):
    """(number of the query, id, score) of each query's k best vectors in a partition, without its own id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [(names, np.frombuffer(x, np.float64).reshape(len(names), size)) for names, size, x in cast.value]
        packs = [(names, x, x.astype(np.float32)) for names, x in packs]
        starts = np.cumsum([0] + [len(names) for names, *_ in packs])
        own: dict = {}
        for p, (names, *_) in enumerate(packs):
            for i, name in enumerate(names):
                own.setdefault(name, []).append((p, i))
        best: list[list] = [[] for _ in range(starts[-1])]
        least = np.full(starts[-1], -np.inf)
        for ids, v in _blocks(batches, VECTOR_ROWS):
            ids, v = _few(ids, v, k)
            v32 = np.ascontiguousarray(v.astype(np.float32).T)
            mine: dict = {}
            for col, name in enumerate(ids):
                for p, i in own.get(name, ()):
                    mine.setdefault(p, []).append((i, col))
            # Of two products in single precision; and of rounding.
            slack = 4e-7 * (v.shape[1] + 8) + (0 if digits is None else 2 * 10.0**-digits)
            for p, (names, q, q32) in enumerate(packs):
                s = q32 @ v32 if q.shape[1] == v.shape[1] else np.zeros((len(names), len(ids)), np.float32)
                if p in mine:
                    s[tuple(np.array(mine[p]).T)] = -np.inf
                bound = least[starts[p] : starts[p + 1]]
                rows = np.flatnonzero(s.max(1) >= bound - slack)
                if not len(rows):
                    continue
                s = s[rows]
                kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(rows), -np.inf)
                r, c = np.nonzero((s >= (np.maximum(bound[rows], kth) - slack)[:, None]) & (s > -np.inf))
                score = (q[rows[r]] * v[c]).sum(1) if q.shape[1] == v.shape[1] else np.zeros(len(r))
                rank = score if digits is None else np.round(score, digits)
                ends = np.searchsorted(r, np.arange(len(rows) + 1)).tolist()
                c, score, rank = c.tolist(), score.tolist(), (-rank).tolist()
                for j, row in enumerate(rows.tolist()):
                    n = starts[p] + row
                    found = best[n] + [(rank[x], ids[c[x]], score[x]) for x in range(ends[j], ends[j + 1])]
                    found.sort()
                    best[n] = found[:k]
                    if len(found) >= k:
                        least[n] = -found[k - 1][0]
        names = [name for pack in packs for name in pack[0]]
        for at in range(0, len(best), 4096):
            rows = [(names[n], *x[1:]) for n in range(at, min(at + 4096, len(best))) for x in best[n]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["query_id", "id", "score"])

    return run


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = 1 << 20, digits: int | None = None) -> DataFrame:
    """The k best vectors of each query (query_id, query_vec), without itself, by score (rounded to `digits`) and id.

    The queries come to the driver packed, in blocks of at most `max_queries` and 16 MB; each block is broadcast and
    compared with all vectors in one pass.  Of more than one block, the best are written to the shared folder."""
    spark = vectors.sparkSession
    vectors, queries = vectors.select("id", "embedding").filter("id is not null"), queries.select("query_id", "query_vec").filter("query_id is not null")
    score = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy("query_id").orderBy(score.desc(), "id")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    plain = vectors.filter(~_odd(F.col("embedding"))).select("id", F.col("embedding").cast("array<double>").alias("embedding")).coalesce(4 * spark.sparkContext.defaultParallelism)
    packs = queries.filter(~_odd(F.col("query_vec"))).select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
    packs = packs.mapInArrow(_packed, f"ids array<{query_type}>, size long, x binary").toLocalIterator()
    tables: list[DataFrame] = []

    def compare(block: list, last: bool) -> None:
        cast = spark.sparkContext.broadcast(block)
        hits = plain.mapInArrow(_nearest(cast, k, digits), f"query_id {query_type}, id {id_type}, score double")
        if not last or tables:
            path = shared_path(spark, "nearest")
            best(hits).drop("rank").write.parquet(path)
            hits = spark.read.schema(hits.schema).parquet(path)
            cast.destroy()
        tables.append(hits)

    block, n, held = [], 0, 0
    for row in packs:
        width = 8 * row["size"]
        most = max(1, min(max_queries, QUERY_ROWS))
        for at in range(0, len(row["ids"]), most):
            ids, x = row["ids"][at : at + most], bytes(row["x"][at * width : (at + most) * width])
            if block and (n + len(ids) > max_queries or held + len(x) > QUERY_BYTES):
                compare(block, False)
                block, n, held = [], 0, 0
            block.append((ids, row["size"], x))
            n, held = n + len(ids), held + len(x)
    if block:
        compare(block, True)
    odd_vectors, odd_queries = vectors.filter(_odd(F.col("embedding"))), queries.filter(_odd(F.col("query_vec")))
    for v, q in ((odd_vectors, queries), (vectors.filter(~_odd(F.col("embedding"))), odd_queries)):
        if not tables or not (odd_vectors if q is queries else odd_queries).isEmpty():
            tables.append(v.join(q, F.col("id") != F.col("query_id")).select("query_id", "id", cosine(F.col("embedding"), F.col("query_vec")).alias("score")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return best(out)


def docs_search(docs: DataFrame, query: list[float], limit: int, min_score: float, kind: str | None = None) -> DataFrame:
    """Twice the limit is fetched, then score, type and archived filters apply, then the limit."""
    hits = scored(docs, query).orderBy(F.desc("score"), "id").limit(2 * limit).filter(F.col("score") >= min_score)
    if kind:
        hits = hits.filter(F.col("type") == kind)
    return hits.filter("status != 'archived'").orderBy(F.desc("score"), "id").limit(limit)


def scroll(vectors: DataFrame, after: str | None, limit: int = 100) -> DataFrame:
    """A page by id, after the last one seen."""
    return (vectors.filter(F.col("id") > after) if after else vectors).orderBy("id").limit(limit)


def dimension_report(vectors: DataFrame, expected: int) -> DataFrame:
    """How many vectors have each dimension, and whether it is the model's."""
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n")).withColumn("compatible", F.col("dimension") == expected)


def content_id(model: str, text: Column) -> Column:
    """Cache id of a text under a model: white space folded, 16 hex digits of SHA-256."""
    return F.substring(F.sha2(F.concat(F.lit(model + ":"), F.regexp_replace(F.trim(text), r"\s+", " ")), 256), 1, 16)


def embed_missing(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts whose id the cache has not."""
    return texts.select(content_id(model, F.col("text")).alias("cache_id")).distinct().join(cache.select("cache_id"), "cache_id", "left_anti")


def manifold(vectors: DataFrame, distance: DataFrame, query: list[float], alpha: float, limit: int) -> DataFrame:
    """Nodes within reach of the seeds, by alpha x graph distance + (1 - alpha) x embedding distance."""
    d = l2(F.col("embedding"), F.array(*map(F.lit, query)))
    return vectors.join(distance.withColumnRenamed("node", "qualified_name"), "qualified_name").withColumn("cost", F.round(alpha * F.col("distance") + (1 - alpha) * d, 6)).orderBy("cost", "id").limit(limit)


def query_vector(g: Graph, number: int = 0) -> list[float]:
    row = g.vectors.filter(F.col("vec_id") == number).select("embedding").first()
    return list(row["embedding"])


def doc_vectors(g: Graph) -> DataFrame:
    return g.vectors.join(g.documents.select(F.col("doc_id").alias("vec_id"), "type", "status", "path"), "vec_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


def _cache(g: Graph) -> DataFrame:
    return g.documents.filter("doc_id % 3 = 0").select(content_id("m", F.col("text")).alias("cache_id"))


def _manifold(g: Graph) -> DataFrame:
    from graphloom.operators.paths import reach

    seeds = scored(g.vectors, query_vector(g)).orderBy(F.desc("score"), "id").limit(5).select(F.col("qualified_name").alias("node"))
    return manifold(g.vectors, reach(g.calls, seeds, 2), query_vector(g), 0.5, 10).select("id", "distance", "cost")


QUERIES = {
    "cosine": _q(lambda g: _rounded(scored(g.vectors, query_vector(g)), "id")),
    "local_search": _q(lambda g: _rounded(search(g.vectors, query_vector(g), 10, 0.2), "id", "language")),
    "search": _q(lambda g: _rounded(search(g.vectors, query_vector(g, 3), 10, -1.0), "id")),
    "search_code": _q(lambda g: _rounded(search_then_filter(g.vectors.filter("language = 'go'"), query_vector(g, 7), 10, 0.15), "id")),
    "score_then_slice": _q(lambda g: _rounded(search(g.vectors, query_vector(g, 9), 5, 0.1, "rust"), "id")),
    "post_filter_topk": _q(lambda g: _rounded(search_then_filter(g.vectors, query_vector(g, 9), 8, 0.2), "id")),
    "search_by_level": _q(lambda g: _rounded(search_then_filter(g.vectors.filter("level = 2"), query_vector(g, 11), 10, 0.1), "id", "level")),
    "search_hierarchical": _q(lambda g: _rounded(search_levels(g.vectors, query_vector(g), [1, 2, 3]), "level", "id", "rank")),
    "search_summaries": _q(lambda g: _rounded(search(g.vectors.filter("level = 3"), query_vector(g, 5), 7, -1.0), "id", "level")),
    "get_summary": _q(lambda g: g.vectors.filter("id = 'vec:42'").select("id", "level", "language")),
    "local_index": _q(lambda g: _rounded(search_batch(g.vectors, g.vectors.filter("vec_id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), 3, digits=6), "query_id", "id", "rank")),
    "docs_search": _q(lambda g: _rounded(docs_search(doc_vectors(g), query_vector(g), 10, 0.1, None), "id", "path")),
    "scroll": _q(lambda g: scroll(g.vectors, "vec:25", 40).select("id", "level")),
    "compat_check": _q(lambda g: dimension_report(g.vectors, 64)),
    "embed_cache_misses": _q(lambda g: embed_missing(g.documents, _cache(g), "m")),
    "manifold_retrieval": _q(_manifold),
}

_COS = "round(list_dot_product(v.embedding, q.embedding) / (sqrt(list_dot_product(v.embedding, v.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 6)"
_sc = lambda n, where="true", cols="v.id": f"SELECT {cols}, {_COS} AS score FROM vectors v, (SELECT embedding FROM vectors WHERE vec_id = {n}) q WHERE {where}"
_CID = "sha256('m:' || regexp_replace(trim(text), '\\s+', ' ', 'g'))[1:16]"
ORACLES = {k: twin(v) for k, v in {
    "cosine": _sc(0),
    "local_search": f"SELECT * FROM ({_sc(0, cols='v.id, v.language')}) WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 10",
    "search": f"{_sc(3)} ORDER BY score DESC, id LIMIT 10",
    "search_code": "SELECT * FROM (" + _sc(7, "v.language = 'go'") + " ORDER BY score DESC, id LIMIT 10) WHERE score >= 0.15",
    "score_then_slice": "SELECT * FROM (" + _sc(9, "v.language = 'rust'") + ") WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 5",
    "post_filter_topk": f"SELECT * FROM ({_sc(9)} ORDER BY score DESC, id LIMIT 8) WHERE score >= 0.2",
    "search_by_level": "SELECT * FROM (" + _sc(11, "v.level = 2", "v.id, v.level") + " ORDER BY score DESC, id LIMIT 10) WHERE score >= 0.1",
    "search_hierarchical": "SELECT level, id, r::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS r FROM (" + _sc(0, "v.level IN (1, 2, 3)", "v.level, v.id") + ")) WHERE r <= 5",
    "search_summaries": _sc(5, "v.level = 3", "v.id, v.level") + " ORDER BY score DESC, id LIMIT 7",
    "get_summary": "SELECT id, level, language FROM vectors WHERE id = 'vec:42'",
    "local_index": f"SELECT query_id, id, r::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT q.id AS query_id, v.id, {_COS} AS score FROM vectors v, vectors q WHERE q.vec_id % 50 = 0 AND q.id <> v.id)) WHERE r <= 3",
    "docs_search": f"SELECT id, path, score FROM (SELECT v.id, d.path, d.status, {_COS} AS score FROM vectors v JOIN docs d ON d.doc_id = v.vec_id, (SELECT embedding FROM vectors WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 20) WHERE score >= 0.1 AND status <> 'archived' ORDER BY score DESC, id LIMIT 10",
    "scroll": "SELECT id, level FROM vectors WHERE id > 'vec:25' ORDER BY id LIMIT 40",
    "compat_check": "SELECT len(embedding)::INT AS dimension, count(*) AS n, len(embedding) = 64 AS compatible FROM vectors GROUP BY ALL",
    "embed_cache_misses": f"SELECT DISTINCT {_CID} AS cache_id FROM docs WHERE {_CID} NOT IN (SELECT {_CID} FROM docs WHERE doc_id % 3 = 0)",
    "manifold_retrieval": f", st AS MATERIALIZED (SELECT v.qualified_name AS src FROM vectors v, (SELECT embedding FROM vectors WHERE vec_id = 0) q ORDER BY {_COS} DESC, v.id LIMIT 5), walk(node, d) AS (SELECT src, 0 FROM st UNION SELECT e.dst, d + 1 FROM walk JOIN calls e ON e.src = node WHERE d < 2), lv AS (SELECT node, min(d) AS distance FROM walk GROUP BY node) SELECT v.id, distance::INT AS distance, round(0.5::DOUBLE * distance + 0.5::DOUBLE * list_distance(v.embedding, q.embedding), 6) AS cost FROM vectors v JOIN lv ON lv.node = v.qualified_name, (SELECT embedding FROM vectors WHERE vec_id = 0) q ORDER BY cost, v.id LIMIT 10",
}.items()}
