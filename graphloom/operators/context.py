"""Navigation through the code hierarchy, context assembly, intent routing and explanations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.paths import risk_level
from graphloom.operators.vectors import query_vector, scored
from graphloom.operators.windows import dedup_first, top_per_key
from graphloom.plans.model import Graph, twin


def hierarchy(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Positions: level (0 repository to 3 symbol), id, parent; root files hang under the repository."""
    module = F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise("")
    f = files.select(F.lit(2).alias("level"), F.col("path").alias("id"), module.alias("parent"))
    m = f.filter("parent != ''").select(F.lit(1).alias("level"), F.col("parent").alias("id"), F.lit("").alias("parent")).distinct()
    s = symbols.select(F.lit(3).alias("level"), F.col("qualified_name").alias("id"), F.col("file").alias("parent"))
    return m.unionByName(f).unionByName(s)


def navigate(positions: DataFrame) -> DataFrame:
    """Where each move leads from each position: in (first child), out (parent), lateral (next sibling, around the end)."""
    w = Window.partitionBy("level", "parent").orderBy("id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lateral = F.coalesce(F.lead("id").over(w), F.first("id").over(whole))
    first = positions.groupBy((F.col("level") - 1).alias("level"), F.col("parent").alias("id")).agg(F.min("id").alias("in"))
    return positions.withColumn("lateral", lateral).join(first, ["level", "id"], "left").select("level", "id", F.coalesce("in", "id").alias("in"), F.col("parent").alias("out"), "lateral")


def nav_hints(symbols: DataFrame, calls: DataFrame, entries: list[str], k: int = 3) -> DataFrame:
    """Per file: its first symbols, entry points, and calls from and to other files."""
    names = symbols.groupBy("file").agg(F.array_join(F.slice(F.array_sort(F.collect_list("qualified_name")), 1, k), ",").alias("first"), F.count_if(F.col("name").isin(entries)).alias("entry_points"))
    home = symbols.select("qualified_name", "file")
    across = calls.join(home.toDF("src", "src_file"), "src").join(home.toDF("dst", "dst_file"), "dst").filter("src_file != dst_file")
    out = across.groupBy(F.col("src_file").alias("file")).agg(F.count("*").alias("callees"))
    inc = across.groupBy(F.col("dst_file").alias("file")).agg(F.count("*").alias("callers"))
    return names.join(out, "file", "left").join(inc, "file", "left").select("file", "first", "entry_points", F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers"))


def assemble_context(hits: DataFrame, symbols: DataFrame, calls: DataFrame, budget: int) -> DataFrame:
    """Hits (relevance 1), their callees (0.6) and files' other symbols (0.4), best first, cut in proportion to the budget."""
    direct = hits.select("qualified_name", F.lit(1.0).alias("relevance"))
    called = calls.join(hits.select(F.col("qualified_name").alias("src")), "src", "left_semi").select(F.col("dst").alias("qualified_name"), F.lit(0.6).alias("relevance"))
    files = symbols.join(hits.select("qualified_name"), "qualified_name", "left_semi").select("file").distinct()
    near = symbols.join(files, "file", "left_semi").select("qualified_name", F.lit(0.4).alias("relevance"))
    best = direct.unionByName(called).unionByName(near).groupBy("qualified_name").agg(F.max("relevance").alias("relevance"))
    rows = best.join(symbols.select("qualified_name", "signature", "docstring"), "qualified_name")
    rows = rows.withColumn("tokens", F.ceil((F.length("signature") + F.length("docstring")) / 4))
    total = rows.agg(F.sum("tokens").alias("total"))
    share = F.least(F.lit(1.0), F.lit(budget) / F.col("total"))
    return rows.join(total).select("qualified_name", "relevance", "tokens", F.floor(F.col("tokens") * share).alias("granted"))


def snapshot_context(explicit: DataFrame, vector_hits: DataFrame, keyword_hits: DataFrame, most: int) -> DataFrame:
    """Sources in their order, each name at its first source, at most `most` in all."""
    tagged = [df.select("qualified_name", F.lit(i).alias("source")) for i, df in enumerate((explicit, vector_hits, keyword_hits))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return dedup_first(rows, ["qualified_name"], ["source"]).orderBy("source", "qualified_name").limit(most)


def explain_path(names: Column) -> Column:
    return F.concat(F.array_join(names, " -> "), F.lit(" ("), (F.size(names) - 1).cast("string"), F.lit(" steps)"))


def explain_risk(direct: Column, files: Column, total: Column) -> Column:
    level = risk_level(direct, files, total)
    return F.concat(F.lit("Risk "), level, F.lit(": "), direct.cast("string"), F.lit(" direct callers, "), total.cast("string"), F.lit(" in all, "), files.cast("string"), F.lit(" files"))


#: Intents by pattern, in order.
INTENTS = [
    ("callers", r"(?i)(?:who|what) calls (\w+)|callers of (\w+)"), ("callees", r"(?i)what does (\w+) call|callees of (\w+)"), ("file_symbols", r"(?i)symbols in (\S+)"), ("stats", r"(?i)how many|statistics|stats"),
    ("symbol", r"(?i)(?:find|show|where is) (\w+)"),
]


def route(query: str) -> tuple[str, str | None]:
    """Intent and argument of a question; `search` if no pattern fits."""
    for intent, pattern in INTENTS:
        m = re.search(pattern, query)
        if m:
            return intent, next((g for g in m.groups() if g), None)
    return "search", None


def routed(query: Column) -> Column:
    """The intent of each question, on the cluster."""
    out = F.lit("search")
    for intent, pattern in reversed(INTENTS):
        out = F.when(query.rlike(pattern), intent).otherwise(out)
    return out


def resume(paths: DataFrame, after: int, most: int, last_count: int) -> DataFrame:
    """The next chunk of a listing ordered by folder and path: after the index reached, from the start if the listing has changed.

    The listing is numbered by folder first, so no task ever holds all of it."""
    folder = F.regexp_extract("path", r"^(.*)/", 1)
    p = paths.withColumn("folder", folder)
    before = Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.groupBy("folder").agg(F.count("*").alias("n")).select("folder", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    total = paths.count()
    start = after + 1 if total == last_count else 0
    own = F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1
    return p.withColumn("own", own).join(starts, "folder").withColumn("index", F.col("start") + F.col("own")).filter((F.col("index") >= start) & (F.col("index") < start + most)).select("path", "index")


def _hits(g: Graph, k: int) -> DataFrame:
    return scored(g.vectors, query_vector(g)).orderBy(F.desc("score"), "id").limit(k)


def _risk(g: Graph) -> DataFrame:
    home = g.symbols.select(F.col("qualified_name").alias("src"), "file")
    row = g.calls.join(home, "src").groupBy("dst").agg(F.count("*").alias("direct"), F.count_distinct("file").alias("files"))
    return row.select("dst", explain_risk(F.col("direct"), F.col("files"), F.col("direct")).alias("text"))


def _snapshot(g: Graph) -> DataFrame:
    explicit = g.symbols.filter("file = 'Brand#3/SMALL'")
    return snapshot_context(explicit, _hits(g, 20), g.symbols.filter("name like '%widget%'"), 40)


_ASK = ["who calls parse", "what does main call", "symbols in a.py", "how many files", "find foo", "anything else"]
_q = lambda f: lambda spark, sf_dir: f(Graph(spark, sf_dir))
QUERIES = {
    "hierarchy_navigate": _q(lambda g: navigate(hierarchy(g.files, g.symbols))),
    "nav_hints": _q(lambda g: nav_hints(g.symbols, g.calls, ["red widget", "small ring"])),
    "position_context": _q(lambda g: top_per_key(g.symbols, "file", ["qualified_name"], 5).select("file", "qualified_name", "signature", "rank")),
    "assemble_context": _q(lambda g: assemble_context(_hits(g, 5), g.symbols, g.calls, 500)),
    "snapshot_context": _q(_snapshot),
    "explain_risk": _q(_risk),
    "explain_path": _q(lambda g: g.symbols.select("qualified_name", explain_path(F.array("file", "kind", "name")).alias("text"))),
    "intent_route": _q(lambda g: g.spark.createDataFrame([(x,) for x in _ASK], "query string").select("query", routed(F.col("query")).alias("intent"))),
    "chunked_resume": _q(lambda g: resume(g.documents.select("path"), 99, 50, g.documents.count())),
    "auto_context": _q(lambda g: _hits(g, 10).filter("score >= 0.1").orderBy(F.desc("score"), "id").limit(8).join(g.symbols.select("qualified_name", "signature"), "qualified_name").select("id", "signature")),
}
_TOP = "(SELECT v.id, v.qualified_name, round(list_dot_product(v.embedding, q.embedding) / (sqrt(list_dot_product(v.embedding, v.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 9) AS score FROM vectors v, (SELECT embedding FROM vectors WHERE vec_id = 0) q ORDER BY score DESC, v.id LIMIT {})"
ORACLES = {k: twin(v) for k, v in {
    "hierarchy_navigate": ", h AS (SELECT DISTINCT 1 AS level, split_part(path, '/', 1) AS id, '' AS parent FROM files UNION ALL SELECT 2, path, split_part(path, '/', 1) FROM files UNION ALL SELECT 3, qualified_name, file FROM symbols) SELECT level, id, coalesce((SELECT min(c.id) FROM h c WHERE c.parent = h.id AND c.level = h.level + 1), id) AS \"in\", parent AS out, coalesce(lead(id) OVER w, first_value(id) OVER w) AS lateral FROM h WINDOW w AS (PARTITION BY level, parent ORDER BY id)",
    "nav_hints": ", x AS (SELECT a.file AS f, b.file AS t FROM calls c JOIN symbols a ON a.qualified_name = c.src JOIN symbols b ON b.qualified_name = c.dst WHERE a.file <> b.file) SELECT file, array_to_string(list_sort(list(qualified_name))[1:3], ',') AS first, count(*) FILTER (name IN ('red widget', 'small ring')) AS entry_points, (SELECT count(*) FROM x WHERE f = s.file) AS callees, (SELECT count(*) FROM x WHERE t = s.file) AS callers FROM symbols s GROUP BY file",
    "position_context": "SELECT file, qualified_name, signature, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY qualified_name) AS r FROM symbols) WHERE r <= 5",
    "assemble_context": f", hi AS (SELECT * FROM {_TOP.format(5)}), b AS (SELECT q, max(r) AS relevance FROM (SELECT qualified_name AS q, 1.0::DOUBLE AS r FROM hi UNION ALL SELECT dst, 0.6::DOUBLE FROM calls WHERE src IN (SELECT qualified_name FROM hi) UNION ALL SELECT qualified_name, 0.4::DOUBLE FROM symbols WHERE file IN (SELECT file FROM symbols WHERE qualified_name IN (SELECT qualified_name FROM hi))) GROUP BY q), t AS (SELECT s.qualified_name, relevance, ceil((length(signature) + length(docstring)) / 4)::BIGINT AS tokens FROM b JOIN symbols s ON s.qualified_name = q) SELECT *, floor(tokens * least(1.0::DOUBLE, 500::DOUBLE / (sum(tokens) OVER ())))::BIGINT AS granted FROM t",
    "snapshot_context": f"SELECT q AS qualified_name, min(s)::INT AS source FROM (SELECT qualified_name AS q, 0 AS s FROM symbols WHERE file = 'Brand#3/SMALL' UNION ALL SELECT qualified_name, 1 FROM {_TOP.format(20)} UNION ALL SELECT qualified_name, 2 FROM symbols WHERE name LIKE '%widget%') GROUP BY q ORDER BY 2, 1 LIMIT 40",
    "explain_risk": "SELECT dst, 'Risk ' || CASE WHEN n > 20 OR f > 15 THEN 'critical' WHEN n > 10 OR f > 8 OR n > 30 THEN 'high' WHEN n > 3 OR f > 3 OR n > 10 THEN 'medium' ELSE 'low' END || ': ' || n || ' direct callers, ' || n || ' in all, ' || f || ' files' AS text FROM (SELECT dst, count(*) AS n, count(DISTINCT file) AS f FROM calls JOIN symbols ON qualified_name = src GROUP BY dst)",
    "explain_path": "SELECT qualified_name, file || ' -> ' || kind || ' -> ' || name || ' (2 steps)' AS text FROM symbols",
    "intent_route": "SELECT * FROM (VALUES " + ", ".join(f"({q!r}, {i!r})" for q, i in zip(_ASK, ["callers", "callees", "file_symbols", "stats", "symbol", "search"], strict=True)) + ") v(query, intent)",
    "chunked_resume": "SELECT path, i AS index FROM (SELECT path, row_number() OVER (ORDER BY regexp_extract(path, '^(.*)/', 1), path) - 1 AS i FROM docs) WHERE i BETWEEN 100 AND 149",
    "auto_context": f"SELECT h.id, signature FROM (SELECT * FROM {_TOP.format(10)} WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 8) h JOIN symbols USING (qualified_name)",
}.items()}
