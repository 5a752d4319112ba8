"""Point lookups, filters and predicates over nodes and documents.

Limits without an order in the usual tools are given a total order here, so that results are stable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin

# Names that count as entry points, and prefixes of utility functions.
ENTRY_NAMES = ["main", "init", "__init__", "constructor"]


def get(nodes: DataFrame, key: str, value: str) -> DataFrame:
    """The node with this key, or no row."""
    return nodes.filter(F.col(key) == value)


def named(x: str) -> Column:
    """The universal symbol predicate: a name or a qualified name."""
    return (F.col("name") == x) | (F.col("qualified_name") == x)


def list_files(files: DataFrame, language: str | None = None, sort: str = "path", limit: int = 20) -> DataFrame:
    if language:
        files = files.filter(F.col("language") == language)
    order = F.col(sort).desc() if sort in ("lines_of_code", "complexity") else F.col(sort)
    return files.orderBy(order, "path").limit(limit)


def list_symbols(symbols: DataFrame, kind: str | None = None, file: str | None = None, sort: str = "name", limit: int = 50) -> DataFrame:
    if kind:
        symbols = symbols.filter(F.col("kind") == kind)
    if file:
        symbols = symbols.filter(F.col("file").contains(file))
    order = F.col(sort).desc() if sort == "complexity" else F.col(sort)
    return symbols.orderBy(order, "qualified_name").limit(limit)


def find_symbol(symbols: DataFrame, x: str, limit: int = 5) -> DataFrame:
    return symbols.filter((F.col("name") == x) | F.col("qualified_name").contains(x)).orderBy("qualified_name").limit(limit)


def by_kind(symbols: DataFrame, files: DataFrame, kind: str, language: str | None = None, file: str | None = None) -> DataFrame:
    """Symbols of a kind, of files in a language and with a path that holds `file`."""
    out = symbols.filter(F.col("kind") == kind)
    if file:
        out = out.filter(F.col("file").contains(file))
    if language:
        out = out.join(files.filter(F.col("language") == language).select(F.col("path").alias("file")), "file", "left_semi")
    return out


def complex_functions(symbols: DataFrame, threshold: int = 10, limit: int = 50) -> DataFrame:
    return symbols.filter((F.col("kind") == "function") & (F.col("complexity") >= threshold)).orderBy(F.desc("complexity"), "qualified_name").limit(limit)


def docs_by_type(docs: DataFrame, kind: str) -> DataFrame:
    return docs.filter(F.col("type") == kind).orderBy("path")


def docs_by_tag(docs: DataFrame, tag: str) -> DataFrame:
    return docs.filter(F.array_contains("tags", tag)).orderBy("path")


def docs_list(docs: DataFrame, kind: str | None = None, limit: int = 50, archived: bool = False) -> DataFrame:
    """The archived filter comes after the limit, so fewer rows than the limit may be left."""
    if kind:
        docs = docs.filter(F.col("type") == kind)
    docs = docs.orderBy("path").limit(limit)
    return docs if archived else docs.filter("status != 'archived'")


def contains_any_case(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(needle.lower())
    return rows.filter(hit)


def innermost(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """For each (file, line), the narrowest symbol whose lines hold it."""
    from pyspark.sql import Window

    points = points.select(F.col("file").alias("at_file"), "line")
    hits = points.join(symbols, (F.col("at_file") == F.col("file")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    order = Window.partitionBy("at_file", "line").orderBy(F.col("end_line") - F.col("start_line"), "qualified_name")
    return hits.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("file", "line", "qualified_name")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: * stays within a folder, ** does not, ? is one character.

    Anchored at the start unless it begins with **/, open at the end if it ends in **."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def glob_match(column: str, glob: str) -> Column:
    return F.col(column).rlike(glob_pattern(glob))


def should_sync(path: str, language: str, include: list[str], exclude: list[str]) -> Column:
    """Not excluded, of a known language, and of one that is wanted."""
    kept = F.lit(True)
    for g in exclude:
        kept = kept & ~glob_match(path, g)
    return kept & (F.col(language) != "unknown") & F.col(language).isin(include)


def add_label(rows: DataFrame, label: str) -> DataFrame:
    """Back-fill a label where it is missing."""
    return rows.withColumn("labels", F.array_union("labels", F.array(F.lit(label))))


def _q(f, *columns):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir)).select(*columns)


_S, _F = ("qualified_name", "name", "kind", "file"), ("path", "language", "complexity", "lines_of_code")
QUERIES = {
    "get_file": _q(lambda g: get(g.files, "path", "Brand#7/PROMO"), *_F),
    "get_symbol": _q(lambda g: get(g.symbols, "qualified_name", "part:17"), *_S, "signature", "start_line", "end_line"),
    "get_document": _q(lambda g: get(g.documents.filter("doc_id = 17"), "type", "guide"), "path", "type", "status", "content_hash"),
    "symbol_by_name": _q(lambda g: g.symbols.filter(named("red widget")), *_S),
    "list_files": _q(lambda g: list_files(g.files, "go", "complexity"), *_F),
    "list_symbols": _q(lambda g: list_symbols(g.symbols, "method", "Brand#1", "complexity"), *_S, "complexity"),
    "find_symbol": _q(lambda g: find_symbol(g.symbols, "part:19"), *_S),
    "query_functions": _q(lambda g: by_kind(g.symbols, g.files, "function", "rust"), *_S),
    "query_classes": _q(lambda g: by_kind(g.symbols, g.files, "class", file="SMALL"), *_S),
    "query_files": _q(lambda g: g.files.filter("language = 'java'"), *_F),
    "complex_functions": _q(lambda g: complex_functions(g.symbols, 30), *_S, "complexity"),
    "docs_by_type": _q(lambda g: docs_by_type(g.documents, "adr"), "path", "type", "status"),
    "docs_by_tag": _q(lambda g: docs_by_tag(g.documents, "fr"), "path", "lang"),
    "docs_list": _q(lambda g: docs_list(g.documents, "guide"), "path", "status"),
    "in_list": _q(lambda g: g.symbols.filter(F.col("name").isin("red widget", "small ring") & F.col("kind").isin("function", "class")), *_S),
    "starts_with": _q(lambda g: g.files.filter(F.col("path").startswith("Brand#2/")), *_F),
    "contains_ci": _q(lambda g: contains_any_case(g.symbols, ["name", "qualified_name"], "WIDGET"), *_S),
    "regex_match": _q(lambda g: g.files.filter(F.col("path").rlike("^(?:.*/(SMALL|LARGE)|Brand#1[0-2]/.*)$")), *_F),
    "any_in_list": _q(lambda g: g.turns.filter(F.arrays_overlap("symbols_referenced", F.array(F.lit("part:5"), F.lit("part:66")))), "session_id", "turn_number"),
    "any_contains": _q(lambda g: g.turns.filter(F.exists("symbols_referenced", lambda x: x.contains(":11"))), "session_id", "turn_number"),
    "label_test": _q(lambda g: add_label(g.symbols.withColumn("labels", F.array("kind")), "Searchable").withColumn("labels", F.array_join("labels", ",")), "qualified_name", "labels"),
    "is_not_null_size": _q(lambda g: g.turns.filter(F.col("symbols_referenced").isNotNull() & (F.size("symbols_referenced") > 0)).groupBy("concern").agg(F.count("*").alias("n")), "concern", "n"),
    "interval_contains": _q(lambda g: innermost(g.symbols, g.symbols.select("file", (F.col("start_line") + 3).alias("line")).distinct()), "file", "line", "qualified_name"),
    "glob_match": _q(lambda g: g.documents.filter(glob_match("path", "docs/src1?/*.md")), "path"),
    "should_sync_file": _q(lambda g: g.files.filter(should_sync("path", "language", ["go", "rust"], ["**/PROMO", "Brand#1/*"])), *_F),
}

_SC, _FC = "qualified_name, name, kind, file", "path, language, complexity, lines_of_code"
ORACLES = {k: twin(v) for k, v in {
    "get_file": f"SELECT {_FC} FROM files WHERE path = 'Brand#7/PROMO'",
    "get_symbol": f"SELECT {_SC}, signature, start_line, end_line FROM symbols WHERE qualified_name = 'part:17'",
    "get_document": "SELECT path, type, status, content_hash FROM docs WHERE doc_id = 17 AND type = 'guide'",
    "symbol_by_name": f"SELECT {_SC} FROM symbols WHERE name = 'red widget' OR qualified_name = 'red widget'",
    "list_files": f"SELECT {_FC} FROM files WHERE language = 'go' ORDER BY complexity DESC, path LIMIT 20",
    "list_symbols": f"SELECT {_SC}, complexity FROM symbols WHERE kind = 'method' AND contains(file, 'Brand#1') ORDER BY complexity DESC, qualified_name LIMIT 50",
    "find_symbol": f"SELECT {_SC} FROM symbols WHERE name = 'part:19' OR contains(qualified_name, 'part:19') ORDER BY qualified_name LIMIT 5",
    "query_functions": f"SELECT {_SC} FROM symbols WHERE kind = 'function' AND file IN (SELECT path FROM files WHERE language = 'rust')",
    "query_classes": f"SELECT {_SC} FROM symbols WHERE kind = 'class' AND contains(file, 'SMALL')",
    "query_files": f"SELECT {_FC} FROM files WHERE language = 'java'",
    "complex_functions": f"SELECT {_SC}, complexity FROM symbols WHERE kind = 'function' AND complexity >= 30 ORDER BY complexity DESC, qualified_name LIMIT 50",
    "docs_by_type": "SELECT path, type, status FROM docs WHERE type = 'adr'",
    "docs_by_tag": "SELECT path, lang FROM docs WHERE list_contains(tags, 'fr')",
    "docs_list": "SELECT path, status FROM (SELECT * FROM docs WHERE type = 'guide' ORDER BY path LIMIT 50) WHERE status <> 'archived'",
    "in_list": f"SELECT {_SC} FROM symbols WHERE name IN ('red widget', 'small ring') AND kind IN ('function', 'class')",
    "starts_with": f"SELECT {_FC} FROM files WHERE starts_with(path, 'Brand#2/')",
    "contains_ci": f"SELECT {_SC} FROM symbols WHERE contains(lower(name), 'widget') OR contains(lower(qualified_name), 'widget')",
    "regex_match": f"SELECT {_FC} FROM files WHERE regexp_full_match(path, '(.*/(SMALL|LARGE)|Brand#1[0-2]/.*)')",
    "any_in_list": "SELECT session_id, turn_number FROM turns WHERE list_has_any(symbols_referenced, ['part:5', 'part:66'])",
    "any_contains": "SELECT session_id, turn_number FROM turns WHERE len(list_filter(symbols_referenced, lambda x: contains(x, ':11'))) > 0",
    "label_test": "SELECT qualified_name, kind || ',Searchable' AS labels FROM symbols",
    "is_not_null_size": "SELECT concern, count(*) AS n FROM turns WHERE len(symbols_referenced) > 0 GROUP BY concern",
    "interval_contains": "SELECT file, line, qualified_name FROM (SELECT p.file, p.line, s.qualified_name, row_number() OVER (PARTITION BY p.file, p.line ORDER BY end_line - start_line, qualified_name) AS r FROM (SELECT DISTINCT file, start_line + 3 AS line FROM symbols) p JOIN symbols s ON s.file = p.file AND p.line BETWEEN s.start_line AND s.end_line) WHERE r = 1",
    "glob_match": "SELECT path FROM docs WHERE regexp_full_match(path, 'docs/src1[^/]/[^/]*[.]md')",
    "should_sync_file": f"SELECT {_FC} FROM files WHERE language IN ('go', 'rust') AND NOT path LIKE '%/PROMO' AND NOT path LIKE 'Brand#1/%'",
}.items()}
