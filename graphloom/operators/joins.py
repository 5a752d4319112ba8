"""Joins between nodes along edges.  Plain equi-joins: the optimiser picks the strategy by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin


def callers(calls: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    return symbols.join(calls.filter(F.col("dst") == target).select(F.col("src").alias("qualified_name"), "call_count"), "qualified_name")


def callees(calls: DataFrame, symbols: DataFrame, source: str) -> DataFrame:
    return symbols.join(calls.filter(F.col("src") == source).select(F.col("dst").alias("qualified_name"), "call_count"), "qualified_name")


def file_symbols(defines: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    return symbols.join(defines.filter(F.col("src") == path).select(F.col("dst").alias("qualified_name")), "qualified_name")


def file_dependencies(imports: DataFrame, path: str) -> DataFrame:
    return imports.filter(F.col("src") == path).select(F.col("dst").alias("path"))


def file_dependents(imports: DataFrame, path: str) -> DataFrame:
    return imports.filter(F.col("dst") == path).select(F.col("src").alias("path"))


def docs_for_target(describes: DataFrame, docs: DataFrame, symbols: DataFrame, x: str) -> DataFrame:
    """Documents that describe a file, or the file of a symbol: two equi-joins instead of an OR join."""
    by_path = describes.filter(F.col("dst") == x).select(F.col("src").alias("path"))
    by_name = describes.join(symbols.filter(F.col("qualified_name") == x).select(F.col("file").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"))
    return docs.join(by_path.unionByName(by_name).distinct(), "path")


def related_docs(references: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    return docs.join(references.filter(F.col("src") == path).select(F.col("dst").alias("path")), "path")


def symbol_context(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name") == name).join(files.select(F.col("path").alias("file"), "language"), "file")


def related(symbols: DataFrame, calls: DataFrame, imports: DataFrame, x: str) -> DataFrame:
    """Imported files (relevance 0.7) and files of callees (0.6) of a symbol; the first seen of a path wins."""
    home = symbols.filter(F.col("qualified_name") == x)
    files = imports.join(home.select(F.col("file").alias("src")), "src").select(F.col("dst").alias("path"), F.lit(0.7).alias("relevance"), F.lit(0).alias("rank"))
    called = callees(calls, symbols, x).select(F.col("file").alias("path"), F.lit(0.6).alias("relevance"), F.lit(1).alias("rank"))
    first = F.row_number().over(Window.partitionBy("path").orderBy("rank"))
    return files.unionByName(called).withColumn("n", first).filter("n = 1").select("path", "relevance")


def prd_list(requirements: DataFrame) -> DataFrame:
    return requirements.groupBy("prd_id").agg(F.count("id").alias("chunks"))


def prd_chunks(requirements: DataFrame, implementations: DataFrame) -> DataFrame:
    """Requirements with the number of implementations, none included; priority by descending name."""
    n = implementations.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return requirements.join(n, "id", "left").withColumn("implementations", F.coalesce("n", F.lit(0))).orderBy(F.desc("priority"), "id")


def interfaces_with_implementors(symbols: DataFrame, inherits: DataFrame, limit: int = 10) -> DataFrame:
    made = inherits.groupBy(F.col("dst").alias("qualified_name")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("implementors"))
    return symbols.filter("kind = 'interface'").join(made, "qualified_name", "left").withColumn("implementors", F.coalesce("implementors", F.lit(""))).orderBy(F.desc("implementors"), "qualified_name").limit(limit)


def commit_log(commits: DataFrame, modifies: DataFrame, file: str | None = None, author: str | None = None, limit: int = 20) -> DataFrame:
    if file:
        commits = commits.join(modifies.filter(F.col("path") == file).select("sha"), "sha", "left_semi")
    if author:
        commits = commits.filter(F.col("author").contains(author))
    return commits.orderBy(F.desc("timestamp"), "sha").limit(limit)


def file_history(commits: DataFrame, modifies: DataFrame, path: str, limit: int = 10) -> DataFrame:
    return commits.join(modifies.filter(F.col("path") == path), "sha").orderBy(F.desc("timestamp"), "sha").limit(limit)


def blame_file(symbols: DataFrame, commits: DataFrame, modifies: DataFrame, path: str) -> DataFrame:
    """Symbols of a file with the file's latest commit."""
    latest = commits.join(modifies.filter(F.col("path") == path), "sha").groupBy(F.col("path").alias("file")).agg(F.max(F.struct("timestamp", "sha")).alias("last"))
    return symbols.join(latest, "file").select("qualified_name", "file", F.col("last.sha").alias("sha"), F.col("last.timestamp").alias("timestamp"))


def blame_symbols(symbols: DataFrame, commits: DataFrame, modifies: DataFrame, k: int = 5) -> DataFrame:
    """The k latest commits of the file of each symbol: ranked once per file, then joined."""
    newest = Window.partitionBy("path").orderBy(F.desc("timestamp"), "sha")
    ranked = commits.select("sha", "timestamp").join(modifies.join(symbols.select(F.col("file").alias("path")).distinct(), "path", "left_semi"), "sha").withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)
    return symbols.join(ranked.withColumnRenamed("path", "file"), "file").select("qualified_name", "sha", "rank")


def resolve_calls(raw_calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Callee names to qualified names: same file first, then imported files, then any symbol of the name.

    raw_calls: file, caller, callee (a bare name).  Ties within a tier go to the smallest target, and of
    all symbols of the name to the largest, the last registered."""
    s = symbols.select(F.col("name").alias("callee"), F.col("file").alias("t_file"), F.col("qualified_name").alias("target"))
    base = raw_calls.select("file", "caller", "callee").distinct()
    wanted = base.select("file", "callee").distinct()
    near = wanted.join(s.groupBy("callee", "t_file").agg(F.min("target").alias("target")), "callee").join(imports.select(F.col("src").alias("i_src"), F.col("dst").alias("i_dst")), (F.col("file") == F.col("i_src")) & (F.col("t_file") == F.col("i_dst")), "left")
    tier = F.when(F.col("t_file") == F.col("file"), 1).when(F.col("i_dst").isNotNull(), 2)
    close = near.withColumn("tier", tier).filter("tier is not null").groupBy("file", "callee").agg(F.min(F.struct("tier", "target")).alias("best"))
    any_ = s.groupBy("callee").agg(F.max("target").alias("last"))
    out = base.join(close, ["file", "callee"], "left").join(any_, "callee")
    return out.select("file", "caller", "callee", F.coalesce("best.target", "last").alias("target"), F.coalesce("best.tier", F.lit(3)).alias("tier"))


def symbol_vectors(symbols: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """symbol to its vectors' payloads; links: qualified_name, vector_ids (an array)."""
    ids = links.select("qualified_name", F.explode("vector_ids").alias("id"))
    return symbols.join(ids, "qualified_name").join(vectors.select("id", "language", "level"), "id")


def file_symbol_vectors(symbols: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """All symbols of a file with their vector ids, an empty list where there are none."""
    ids = vectors.groupBy("qualified_name").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("vector_ids"))
    return symbols.filter(F.col("file") == path).join(ids, "qualified_name", "left").select("qualified_name", F.coalesce("vector_ids", F.lit("")).alias("vector_ids"))


def archived(docs: DataFrame, ingested: DataFrame, keep: bool) -> DataFrame:
    """Documents whose path is (or is not) archived."""
    return docs.join(ingested.filter("archived").select("path"), "path", "left_semi" if keep else "left_anti")


def inspect(symbols: DataFrame, calls: DataFrame, x: str, first: int = 10) -> DataFrame:
    """A symbol with the number and the first callers and callees."""
    side = lambda a, b: calls.filter(F.col(a) == x).agg(F.count("*").alias(f"n_{b}"), F.array_join(F.slice(F.array_sort(F.collect_list(b)), 1, first), ",").alias(f"first_{b}"))
    one = symbols.filter(F.col("qualified_name") == x).select("qualified_name", "kind", "file")
    return one.join(side("dst", "src")).join(side("src", "dst"))


def staged_symbols(symbols: DataFrame, paths: list[str]) -> DataFrame:
    return symbols.filter(F.col("file").isin(paths)).select("file", "name", "qualified_name", "kind", "signature", "complexity")


def prev_turn(turns: DataFrame) -> DataFrame:
    """FOLLOWS edges: each turn to the one before in its session."""
    before = F.lag("turn_number").over(Window.partitionBy("session_id").orderBy("turn_number"))
    return turns.withColumn("follows", before).filter(F.col("follows") == F.col("turn_number") - 1).select("session_id", "turn_number", "follows")


def chunk_to_symbol(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks to the first symbol of the same file and name whose lines hold the chunk's."""
    c = chunks.select("chunk_id", F.col("file").alias("c_file"), F.col("name").alias("c_name"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    held = (F.col("c_file") == F.col("file")) & (F.col("c_name") == F.col("name")) & (F.col("start_line") <= F.col("c_start")) & (F.col("end_line") >= F.col("c_end"))
    return c.join(symbols, held).groupBy("chunk_id").agg(F.min("qualified_name").alias("qualified_name"))


def symbols_left_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("path").alias("file"), "language"), "file", "left")


def prd_lookup(implementations: DataFrame, requirements: DataFrame, names: list[str]) -> DataFrame:
    """Requirements that these symbols implement, each once, relevance 0.9."""
    return requirements.join(implementations.filter(F.col("src").isin(names)).select(F.col("dst").alias("id")), "id", "left_semi").withColumn("relevance", F.lit(0.9))


def resolve_imports(sources: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """Relative imports to known paths: the first extension in the list that names a known file."""
    n = F.explode(F.transform(F.array(*map(F.lit, extensions)), lambda x: F.struct(F.concat("target", x).alias("path"), F.array_position(F.array(*map(F.lit, extensions)), x).alias("order"))))
    tried = sources.select("importer", "target", n.alias("t")).select("importer", "target", "t.path", "t.order")
    return tried.join(files.select("path"), "path", "left_semi").groupBy("importer", "target").agg(F.min(F.struct("order", "path")).alias("b")).select("importer", "target", F.col("b.path").alias("path"))


def _raw_calls(g: Graph) -> DataFrame:
    home = g.symbols.select("qualified_name", "name", "file")
    return g.calls.join(home.toDF("src", "x", "file"), "src").join(home.toDF("dst", "callee", "y"), "dst").select("file", F.col("src").alias("caller"), "callee")


def _links(g: Graph) -> DataFrame:
    return g.vectors.groupBy("qualified_name").agg(F.collect_list("id").alias("vector_ids"))


def _chunks(g: Graph) -> DataFrame:
    return g.symbols.select(F.concat("qualified_name", F.lit("#1")).alias("chunk_id"), "file", "name", (F.col("start_line") + 1).alias("start"), F.col("end_line").alias("end")).filter("start <= end")


_S = ("qualified_name", "name", "kind", "file")


def _q(f, *columns):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir)).select(*columns) if columns else f(Graph(spark, sf_dir))


_INGESTED = lambda g: g.documents.select("path", (F.col("status") == "archived").alias("archived"))
QUERIES = {
    "callers": _q(lambda g: callers(g.calls, g.symbols, "part:5"), *_S, "call_count"),
    "callees": _q(lambda g: callees(g.calls, g.symbols, "part:5"), *_S, "call_count"),
    "file_symbols": _q(lambda g: file_symbols(g.defines, g.symbols, "Brand#3/SMALL"), *_S),
    "file_dependencies": _q(lambda g: file_dependencies(g.imports, "Brand#3/SMALL"), "path"),
    "file_dependents": _q(lambda g: file_dependents(g.imports, "Brand#3/SMALL"), "path"),
    "docs_for_target": _q(lambda g: docs_for_target(g.describes, g.documents, g.symbols, "part:40"), "path", "type"),
    "related_docs": _q(lambda g: related_docs(g.references, g.documents, "docs/src5/5.md"), "path", "type"),
    "symbol_ctx": _q(lambda g: symbol_context(g.symbols, g.files, "red widget"), *_S, "language"),
    "related_imports_calls": _q(lambda g: related(g.symbols, g.calls, g.imports, "part:17")),
    "symbols_left_file": _q(lambda g: symbols_left_file(g.symbols, g.files.filter("language != 'go'")), *_S, "language"),
    "prd_list": _q(lambda g: prd_list(g.requirements)),
    "prd_chunks": _q(lambda g: prd_chunks(g.requirements, g.implementations), "id", "prd_id", "priority", "implementations"),
    "interfaces_impl": _q(lambda g: interfaces_with_implementors(g.symbols, g.inherits), "qualified_name", "implementors"),
    "commits": _q(lambda g: commit_log(g.commits, g.modifies, "Brand#3/SMALL", "author1"), "sha", "author", "timestamp", "message"),
    "file_history": _q(lambda g: file_history(g.commits, g.modifies, "Brand#3/SMALL"), "sha", "timestamp", "insertions", "deletions"),
    "blame_file": _q(lambda g: blame_file(g.symbols, g.commits, g.modifies, "Brand#3/SMALL")),
    "blame_symbol": _q(lambda g: blame_symbols(g.symbols.filter("name = 'red widget'"), g.commits, g.modifies)),
    "resolve_calls": _q(lambda g: resolve_calls(_raw_calls(g), g.symbols, g.imports)),
    "symbol_vectors": _q(lambda g: symbol_vectors(g.symbols, _links(g), g.vectors), "qualified_name", "id", "language", "level"),
    "file_symbol_vectors": _q(lambda g: file_symbol_vectors(g.symbols, g.vectors, "Brand#3/SMALL")),
    "archived_semi": _q(lambda g: archived(g.documents, _INGESTED(g), True), "path"),
    "active_anti": _q(lambda g: archived(g.documents, _INGESTED(g), False), "path"),
    "inspect": _q(lambda g: inspect(g.symbols, g.calls, "part:5")),
    "staged_symbols": _q(lambda g: staged_symbols(g.symbols, ["Brand#3/SMALL", "Brand#4/PROMO"])),
    "doc_describes": _q(lambda g: g.describes.filter("src like 'docs/src5/%'"), "src", "dst"),
    "session_prev_turn": _q(lambda g: prev_turn(g.turns)),
    "chunk_to_symbol": _q(lambda g: chunk_to_symbol(_chunks(g), g.symbols)),
    "prd_impl_lookup": _q(lambda g: prd_lookup(g.implementations, g.requirements, [f"part:{i}" for i in range(60)]), "id", "prd_id", "relevance"),
    "resolve_imports": _q(lambda g: resolve_imports(g.symbols.select(F.col("qualified_name").alias("importer"), F.split("file", "/")[0].alias("target")), g.files, ["/LARGE", "/SMALL", "/PROMO"])),
}

_SC = "qualified_name, name, kind, file"
ORACLES = {k: twin(v) for k, v in {
    "callers": f"SELECT {_SC}, call_count FROM symbols JOIN calls ON src = qualified_name WHERE dst = 'part:5'",
    "callees": f"SELECT {_SC}, call_count FROM symbols JOIN calls ON dst = qualified_name WHERE src = 'part:5'",
    "file_symbols": f"SELECT {_SC} FROM symbols WHERE file = 'Brand#3/SMALL'",
    "file_dependencies": "SELECT dst AS path FROM imports WHERE src = 'Brand#3/SMALL'",
    "file_dependents": "SELECT src AS path FROM imports WHERE dst = 'Brand#3/SMALL'",
    "docs_for_target": "SELECT DISTINCT d.path, d.type FROM docs d JOIN describes e ON e.src = d.path WHERE e.dst = 'part:40' OR e.dst IN (SELECT file FROM symbols WHERE qualified_name = 'part:40')",
    "related_docs": "SELECT d.path, d.type FROM docs d JOIN refs r ON r.dst = d.path WHERE r.src = 'docs/src5/5.md'",
    "symbol_ctx": f"SELECT {_SC}, f.language FROM symbols s JOIN files f ON f.path = s.file WHERE name = 'red widget'",
    "related_imports_calls": "SELECT path, max(relevance)::DOUBLE AS relevance FROM (SELECT i.dst AS path, 0.7 AS relevance FROM imports i JOIN symbols s ON s.file = i.src WHERE s.qualified_name = 'part:17' UNION ALL SELECT t.file, 0.6 FROM calls c JOIN symbols t ON t.qualified_name = c.dst WHERE c.src = 'part:17') GROUP BY path",
    "symbols_left_file": f"SELECT {_SC}, f.language FROM symbols s LEFT JOIN (SELECT * FROM files WHERE language <> 'go') f ON f.path = s.file",
    "prd_list": "SELECT prd_id, count(id) AS chunks FROM requirements GROUP BY prd_id",
    "prd_chunks": "SELECT id, prd_id, priority, count(i.src) AS implementations FROM requirements r LEFT JOIN implementations i ON i.dst = r.id GROUP BY ALL",
    "interfaces_impl": "SELECT qualified_name, coalesce(string_agg(DISTINCT i.src, ',' ORDER BY i.src), '') AS implementors FROM symbols s LEFT JOIN inherits i ON i.dst = s.qualified_name WHERE kind = 'interface' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "commits": "SELECT sha, author, timestamp, message FROM commits WHERE sha IN (SELECT sha FROM modifies WHERE path = 'Brand#3/SMALL') AND contains(author, 'author1') ORDER BY timestamp DESC, sha LIMIT 20",
    "file_history": "SELECT sha, timestamp, insertions, deletions FROM commits JOIN modifies USING (sha) WHERE path = 'Brand#3/SMALL' ORDER BY timestamp DESC, sha LIMIT 10",
    "blame_file": "SELECT s.qualified_name, s.file, l.sha, l.timestamp FROM symbols s, (SELECT sha, timestamp FROM commits JOIN modifies USING (sha) WHERE path = 'Brand#3/SMALL' ORDER BY timestamp DESC, sha DESC LIMIT 1) l WHERE s.file = 'Brand#3/SMALL'",
    "blame_symbol": "SELECT qualified_name, sha, r::INT AS rank FROM (SELECT s.qualified_name, c.sha, row_number() OVER (PARTITION BY s.qualified_name ORDER BY c.timestamp DESC, c.sha) AS r FROM symbols s JOIN modifies m ON m.path = s.file JOIN commits c ON c.sha = m.sha WHERE s.name = 'red widget') WHERE r <= 5",
    "resolve_calls": """SELECT file, caller, callee, coalesce(min_by(target, (tier, target)) FILTER (tier < 3), max(target)) AS target, min(tier) AS tier FROM (
      SELECT r.*, s.qualified_name AS target, CASE WHEN s.file = r.file THEN 1 WHEN EXISTS (SELECT 1 FROM imports i WHERE i.src = r.file AND i.dst = s.file) THEN 2 ELSE 3 END AS tier
      FROM (SELECT DISTINCT a.file, c.src AS caller, b.name AS callee FROM calls c JOIN symbols a ON a.qualified_name = c.src JOIN symbols b ON b.qualified_name = c.dst) r JOIN symbols s ON s.name = r.callee) GROUP BY ALL""",
    "symbol_vectors": "SELECT v.qualified_name, v.id, v.language, v.level FROM vectors v JOIN symbols s USING (qualified_name)",
    "file_symbol_vectors": "SELECT s.qualified_name, coalesce(string_agg(v.id, ',' ORDER BY v.id), '') AS vector_ids FROM symbols s LEFT JOIN vectors v USING (qualified_name) WHERE s.file = 'Brand#3/SMALL' GROUP BY 1",
    "archived_semi": "SELECT path FROM docs WHERE status = 'archived'",
    "active_anti": "SELECT path FROM docs WHERE status <> 'archived'",
    "inspect": """SELECT qualified_name, kind, file, (SELECT count(*) FROM calls WHERE dst = 'part:5') AS n_src, (SELECT string_agg(src, ',' ORDER BY src) FROM (SELECT src FROM calls WHERE dst = 'part:5' ORDER BY src LIMIT 10)) AS first_src,
      (SELECT count(*) FROM calls WHERE src = 'part:5') AS n_dst, (SELECT string_agg(dst, ',' ORDER BY dst) FROM (SELECT dst FROM calls WHERE src = 'part:5' ORDER BY dst LIMIT 10)) AS first_dst FROM symbols WHERE qualified_name = 'part:5'""",
    "staged_symbols": "SELECT file, name, qualified_name, kind, signature, complexity FROM symbols WHERE file IN ('Brand#3/SMALL', 'Brand#4/PROMO')",
    "doc_describes": "SELECT src, dst FROM describes WHERE src LIKE 'docs/src5/%'",
    "session_prev_turn": "SELECT a.session_id, a.turn_number, b.turn_number AS follows FROM turns a JOIN turns b ON a.session_id = b.session_id AND b.turn_number = a.turn_number - 1",
    "chunk_to_symbol": "SELECT c.qualified_name || '#1' AS chunk_id, min(s.qualified_name) AS qualified_name FROM symbols c JOIN symbols s ON s.file = c.file AND s.name = c.name AND s.start_line <= c.start_line + 1 AND s.end_line >= c.end_line WHERE c.start_line + 1 <= c.end_line GROUP BY 1",
    "prd_impl_lookup": "SELECT id, prd_id, 0.9::DOUBLE AS relevance FROM requirements WHERE id IN (SELECT dst FROM implementations WHERE substr(src, 6)::INT < 60)",
    "resolve_imports": """SELECT importer, target, min_by(f.path, o) AS path FROM (SELECT qualified_name AS importer, split_part(file, '/', 1) AS target, unnest([1, 2, 3]) AS o FROM symbols) x
      JOIN files f ON f.path = target || ['/LARGE', '/SMALL', '/PROMO'][o] GROUP BY ALL""",
}.items()}
