"""Counts, degrees and roll-ups over the graph.

Degrees are aggregated per side before they are joined, so no join fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_stats(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """Node counts per label and edge counts per type."""
    return union([_count(df, f"node:{k}") for k, df in nodes.items()] + [_count(df, f"edge:{k}") for k, df in edges.items()])


def label_counts(present: DataFrame, labels: list[str]) -> DataFrame:
    """Counts per wanted label, 0 where there is no node; present: label."""
    wanted = present.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return wanted.join(present.groupBy("label").agg(F.count("*").alias("c")), "label", "left").select("label", F.coalesce("c", F.lit(0)).alias("n"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("qualified_name")).agg(F.count("*").alias("incoming"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("qualified_name")).agg(F.count("*").alias("outgoing"))


def hot_spots(symbols: DataFrame, calls: DataFrame, kind: str | None = None, above: int = 0, limit: int = 20) -> DataFrame:
    """The most-called symbols."""
    counted = in_degree(calls).filter(F.col("incoming") > above)
    if kind:
        symbols = symbols.filter(F.col("kind") == kind)
    return symbols.join(counted, "qualified_name").orderBy(F.desc("incoming"), "qualified_name").limit(limit)


def hubs(symbols: DataFrame, calls: DataFrame, least: int = 5, limit: int = 20) -> DataFrame:
    """Symbols by distinct callers and callees together."""
    n = lambda c: F.coalesce(c, F.lit(0))
    joined = symbols.join(in_degree(calls), "qualified_name", "left").join(out_degree(calls), "qualified_name", "left")
    joined = joined.withColumn("incoming", n("incoming")).withColumn("outgoing", n("outgoing")).withColumn("total", F.col("incoming") + F.col("outgoing"))
    return joined.filter(F.col("total") >= least).orderBy(F.desc("total"), "qualified_name").limit(limit)


def top_sources(edges: DataFrame, limit: int = 20) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(limit)


def core_modules(files: DataFrame, symbols: DataFrame, least: int = 3, limit: int = 8) -> DataFrame:
    """Parent directories with at least `least` files: files, symbols, one language, first names."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    by_dir = files.groupBy(folder("path").alias("module")).agg(F.count("*").alias("n_files"), F.min("language").alias("language")).filter((F.col("n_files") >= least) & (F.col("module") != ""))
    inside = symbols.groupBy(folder("file").alias("module")).agg(F.count("*").alias("n_symbols"), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), ",").alias("names"))
    return by_dir.join(inside, "module", "left").orderBy(F.desc("n_files"), F.desc("n_symbols"), "module").limit(limit)


def base_classes(inherits: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    kids = inherits.groupBy(F.col("dst").alias("qualified_name")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("subclasses"))
    return symbols.filter("kind = 'class'").join(kids, "qualified_name").orderBy(F.desc("n"), "qualified_name").limit(limit)


#: Fixed value: how utility functions begin.
UTILITY = "^(get|set|is|has|create|parse|format|validate|convert).*"


def utilities(symbols: DataFrame, calls: DataFrame, pattern: str = UTILITY, least: int = 3, limit: int = 10) -> DataFrame:
    counted = calls.groupBy(F.col("dst").alias("qualified_name")).agg(F.count_distinct("src").alias("callers")).filter(F.col("callers") >= least)
    return symbols.filter((F.col("kind") == "function") & F.col("name").rlike(pattern)).join(counted, "qualified_name").orderBy(F.desc("callers"), "qualified_name").limit(limit)


def hot_files(commits: DataFrame, modifies: DataFrame, newest: int = 10, limit: int = 10) -> DataFrame:
    """Most-changed files of the newest commits."""
    recent = commits.orderBy(F.desc("timestamp"), "sha").limit(newest).select("sha")
    return modifies.join(recent, "sha", "left_semi").groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "path").limit(limit)


def cache_rates(requests: DataFrame) -> DataFrame:
    """Hit rate in percent per namespace and in total; requests: namespace, hit."""
    counted = requests.groupingSets([["namespace"], []], "namespace").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("n"), F.grouping("namespace").alias("g"))
    rate = F.when(F.col("n") > 0, F.round(100 * F.col("hits") / F.col("n")).cast("long")).otherwise(0)
    return counted.select(F.when(F.col("g") == 1, "total").otherwise(F.col("namespace")).alias("namespace"), rate.alias("rate"))


def centrality(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    degree = F.coalesce("incoming", F.lit(0)) + F.coalesce("outgoing", F.lit(0))
    return symbols.join(in_degree(calls), "qualified_name", "left").join(out_degree(calls), "qualified_name", "left").select(
        "qualified_name", degree.alias("degree"), F.round(F.least(F.lit(1.0), F.log1p(degree.cast("double")) / 10), 6).alias("centrality")
    )


def coverage(requirements: DataFrame, implementations: DataFrame) -> DataFrame:
    """Per group: covered and uncovered requirements, percent covered."""
    done = implementations.select(F.col("dst").alias("id")).distinct().withColumn("done", F.lit(True))
    return requirements.join(done, "id", "left").groupBy("prd_id").agg(
        F.count_if(F.col("done").isNotNull()).alias("covered"), F.count_if(F.col("done").isNull()).alias("uncovered"), F.round(100.0 * F.count_if(F.col("done").isNotNull()) / F.count("*"), 2).alias("percent")
    )


def density_class(edges: Column, nodes: Column) -> Column:
    """Which retrieval an edge density favours."""
    d = edges / nodes
    return F.when(d > 3, "hybrid").when(d >= 1.5, "neutral").otherwise("vector-only")


def dependency_coverage(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean and deviation over queries of the share of the true dependencies retrieved; both: query, items."""
    share = F.size(F.array_intersect("items", "true_items")) / F.size("true_items")
    rows = retrieved.join(truth.withColumnRenamed("items", "true_items"), "query").select(share.alias("c"))
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev("c"), 6).alias("deviation"))


def _nodes(g: Graph) -> dict:
    return {"File": g.files, "Symbol": g.symbols, "Commit": g.commits, "Document": g.documents, "SessionKnowledge": g.turns}


def _edges(g: Graph) -> dict:
    return {"CALLS": g.calls, "IMPORTS": g.imports, "DEFINES": g.defines, "INHERITS": g.inherits, "MODIFIES": g.modifies, "DESCRIBES": g.describes, "REFERENCES_DOC": g.references}


def _density(g: Graph) -> DataFrame:
    n = g.calls.agg(F.count("*").alias("edges")).join(g.symbols.filter("kind = 'function'").agg(F.count("*").alias("functions")))
    return n.select("edges", "functions", F.round(F.col("edges") / F.col("functions"), 6).alias("density"), density_class(F.col("edges"), F.col("functions")).alias("advice"))


def _dependency(g: Graph) -> DataFrame:
    # Of all callees, a search that only knows functions finds those.
    items = lambda calls: calls.groupBy(F.col("src").alias("query")).agg(F.collect_set("dst").alias("items"))
    functions = g.symbols.filter("kind = 'function'").select(F.col("qualified_name").alias("dst"))
    return dependency_coverage(items(g.calls.join(functions, "dst", "left_semi")), items(g.calls))


def _q(f, *columns):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir)).select(*columns) if columns else f(Graph(spark, sf_dir))


QUERIES = {
    "graph_stats": _q(lambda g: graph_stats(_nodes(g.fixed()), _edges(g))),
    "resource_summary": _q(lambda g: g.symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")),
    "label_counts": _q(lambda g: label_counts(g.symbols.select(F.col("kind").alias("label")), ["function", "class", "Module"])),
    "nested_counts": _q(lambda g: g.files.agg(F.count("*").alias("files")).join(g.symbols.agg(F.count("*").alias("symbols"))).join(g.calls.agg(F.count("*").alias("relationships")))),
    "prompt_stats": _q(lambda g: g.files.agg(F.count("*").alias("files"), F.round(F.avg("complexity"), 3).alias("average")).join(g.symbols.agg(F.count("*").alias("symbols")))),
    "hot_spots": _q(lambda g: hot_spots(g.symbols, g.calls), "qualified_name", "name", "file", "incoming"),
    "hotspots_summary": _q(lambda g: hot_spots(g.symbols, g.calls, None, 2, 15).withColumn("line", F.split("docstring", r"[.!?]")[0]), "qualified_name", "incoming", "line"),
    "hubs": _q(lambda g: hubs(g.symbols, g.calls), "qualified_name", "incoming", "outgoing", "total"),
    "top_callers": _q(lambda g: top_sources(g.calls)),
    "top_importers": _q(lambda g: top_sources(g.imports)),
    "language_counts": _q(lambda g: g.files.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines_of_code").alias("lines"))),
    "loc_total": _q(lambda g: g.files.agg(F.sum("lines_of_code").alias("lines"))),
    "core_modules": _q(lambda g: core_modules(g.files, g.symbols)),
    "base_classes": _q(lambda g: base_classes(g.inherits, g.symbols), "qualified_name", "n", "subclasses"),
    "utilities": _q(lambda g: utilities(g.symbols, g.calls, "^(red|blue|small).*"), "qualified_name", "callers"),
    "file_complexity": _q(lambda g: g.symbols.groupBy("file").agg(F.sum("complexity").alias("complexity"))),
    "commit_totals": _q(lambda g: g.modifies.groupBy("sha").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count("*").alias("files"))),
    "hot_files": _q(lambda g: hot_files(g.commits, g.modifies)),
    "language_breakdown": _q(lambda g: hot_files(g.commits, g.modifies, 50, 40).join(g.files, "path").groupBy("language").agg(F.count("*").alias("n"))),
    "delta_stats": _q(lambda g: g.documents.agg(F.count_if(F.col("status") == "archived").alias("archived"), F.count_if(F.col("status") == "active").alias("active"), F.sum("n_chars").alias("chars"))),
    "cache_hit_rate": _q(lambda g: cache_rates(g.table("events").select(F.col("event_type").alias("namespace"), (F.col("event_id") % 3 == 0).alias("hit")))),
    "centrality": _q(lambda g: centrality(g.symbols, g.calls)),
    "prd_coverage": _q(lambda g: coverage(g.requirements, g.implementations)),
    "edge_density": _q(_density),
    "dependency_coverage": _q(_dependency),
    "embed_cache_stats": _q(lambda g: g.vectors.agg(F.count("*").alias("entries"), F.sum(F.size("embedding") * 4).cast("long").alias("bytes"))),
    "scope_mode": _q(lambda g: g.symbols.groupBy("kind", F.split("file", "/")[1].alias("scope")).agg(F.count("*").alias("n")).groupBy("kind").agg(F.min(F.struct((-F.col("n")).alias("m"), "scope")).alias("b")).select("kind", F.col("b.scope").alias("scope"))),
}

_count_sql = lambda kind, names: [f"SELECT '{kind}:{k}' AS item, count(*) AS n FROM {t}" for k, t in names.items()]
_STATS = " UNION ALL ".join(_count_sql("node", {"File": "files", "Symbol": "symbols", "Commit": "commits", "Document": "docs", "SessionKnowledge": "turns"}) + _count_sql("edge", {"CALLS": "calls", "IMPORTS": "imports", "DEFINES": "defines", "INHERITS": "inherits", "MODIFIES": "modifies", "DESCRIBES": "describes", "REFERENCES_DOC": "refs"}))
_DEG = "(SELECT dst, count(*) AS incoming FROM calls GROUP BY dst) i ON i.dst = s.qualified_name LEFT JOIN (SELECT src, count(*) AS outgoing FROM calls GROUP BY src) o ON o.src = s.qualified_name"
_HOT = "(SELECT path, count(*) AS changes FROM modifies WHERE sha IN (SELECT sha FROM commits ORDER BY timestamp DESC, sha LIMIT {}) GROUP BY path ORDER BY changes DESC, path LIMIT {})"
ORACLES = {k: twin(v) for k, v in {
    "graph_stats": _STATS,
    "resource_summary": "SELECT kind, count(*) AS n FROM symbols GROUP BY kind",
    "label_counts": "SELECT label, count(s.kind) AS n FROM (VALUES ('function'), ('class'), ('Module')) v(label) LEFT JOIN symbols s ON s.kind = label GROUP BY label",
    "nested_counts": "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM calls) AS relationships",
    "prompt_stats": "SELECT (SELECT count(*) FROM files) AS files, (SELECT round(avg(complexity), 3) FROM files) AS average, (SELECT count(*) FROM symbols) AS symbols",
    "hot_spots": "SELECT qualified_name, name, file, count(*) AS incoming FROM symbols JOIN calls ON dst = qualified_name GROUP BY ALL ORDER BY incoming DESC, qualified_name LIMIT 20",
    "hotspots_summary": "SELECT qualified_name, count(*) AS incoming, regexp_split_to_array(docstring, '[.!?]')[1] AS line FROM symbols JOIN calls ON dst = qualified_name GROUP BY qualified_name, docstring HAVING count(*) > 2 ORDER BY incoming DESC, qualified_name LIMIT 15",
    "hubs": f"SELECT qualified_name, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) + coalesce(outgoing, 0) AS total FROM symbols s LEFT JOIN {_DEG} WHERE coalesce(incoming, 0) + coalesce(outgoing, 0) >= 5 ORDER BY total DESC, qualified_name LIMIT 20",
    "top_callers": "SELECT src, count(*) AS n FROM calls GROUP BY src ORDER BY n DESC, src LIMIT 20",
    "top_importers": "SELECT src, count(*) AS n FROM imports GROUP BY src ORDER BY n DESC, src LIMIT 20",
    "language_counts": "SELECT language, count(*) AS files, sum(lines_of_code)::BIGINT AS lines FROM files GROUP BY language",
    "loc_total": "SELECT sum(lines_of_code)::BIGINT AS lines FROM files",
    "core_modules": """SELECT f.module, f.n_files, f.language, s.n_symbols, s.names FROM (SELECT split_part(path, '/', 1) AS module, count(*) AS n_files, min(language) AS language FROM files GROUP BY 1 HAVING count(*) >= 3) f
      LEFT JOIN (SELECT split_part(file, '/', 1) AS module, count(*) AS n_symbols, array_to_string(list_sort(list(DISTINCT name))[1:5], ',') AS names FROM symbols GROUP BY 1) s USING (module) ORDER BY n_files DESC, n_symbols DESC, module LIMIT 8""",
    "base_classes": "SELECT qualified_name, count(*) AS n, string_agg(i.src, ',' ORDER BY i.src) AS subclasses FROM symbols JOIN inherits i ON i.dst = qualified_name WHERE kind = 'class' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "utilities": "SELECT qualified_name, count(DISTINCT src) AS callers FROM symbols JOIN calls ON dst = qualified_name WHERE kind = 'function' AND regexp_matches(name, '^(red|blue|small)') GROUP BY 1 HAVING count(DISTINCT src) >= 3 ORDER BY callers DESC, 1 LIMIT 10",
    "file_complexity": "SELECT file, sum(complexity)::BIGINT AS complexity FROM symbols GROUP BY file",
    "commit_totals": "SELECT sha, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, count(*) AS files FROM modifies GROUP BY sha",
    "hot_files": f"SELECT * FROM {_HOT.format(10, 10)}",
    "language_breakdown": f"SELECT language, count(*) AS n FROM {_HOT.format(50, 40)} JOIN files USING (path) GROUP BY language",
    "delta_stats": "SELECT count(*) FILTER (status = 'archived') AS archived, count(*) FILTER (status = 'active') AS active, sum(n_chars)::BIGINT AS chars FROM docs",
    "cache_hit_rate": "SELECT CASE WHEN grouping(event_type) = 1 THEN 'total' ELSE event_type END AS namespace, round(100 * count(*) FILTER (event_id % 3 = 0) / count(*))::BIGINT AS rate FROM events GROUP BY GROUPING SETS ((event_type), ())",
    "centrality": f"SELECT qualified_name, coalesce(incoming, 0) + coalesce(outgoing, 0) AS degree, round(least(1.0, ln(1 + coalesce(incoming, 0) + coalesce(outgoing, 0)) / 10), 6) AS centrality FROM symbols s LEFT JOIN {_DEG}",
    "prd_coverage": "SELECT prd_id, count(*) FILTER (id IN (SELECT dst FROM implementations)) AS covered, count(*) FILTER (id NOT IN (SELECT dst FROM implementations)) AS uncovered, round(100.0::DOUBLE * count(*) FILTER (id IN (SELECT dst FROM implementations)) / count(*), 2) AS percent FROM requirements GROUP BY prd_id",
    "edge_density": "SELECT e AS edges, f AS functions, round(e / f, 6) AS density, CASE WHEN e / f > 3 THEN 'hybrid' WHEN e / f >= 1.5 THEN 'neutral' ELSE 'vector-only' END AS advice FROM (SELECT (SELECT count(*) FROM calls) AS e, (SELECT count(*) FROM symbols WHERE kind = 'function') AS f)",
    "dependency_coverage": "SELECT count(*) AS queries, round(avg(c), 6) AS mean, round(stddev(c), 6) AS deviation FROM (SELECT count(kind) / count(*) AS c FROM calls LEFT JOIN (SELECT qualified_name, kind FROM symbols WHERE kind = 'function') ON qualified_name = dst GROUP BY src HAVING count(kind) > 0)",
    "embed_cache_stats": "SELECT count(*) AS entries, sum(len(embedding) * 4)::BIGINT AS bytes FROM vectors",
    "scope_mode": "SELECT kind, scope FROM (SELECT kind, split_part(file, '/', 2) AS scope, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, split_part(file, '/', 2)) AS r FROM symbols GROUP BY kind, split_part(file, '/', 2)) WHERE r = 1",
}.items()}
