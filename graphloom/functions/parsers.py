"""Source files to symbols, imports, calls and chunks.

Python is parsed by its own grammar (`ast`); other languages by line patterns with brace matching.  The
parsers run per Arrow batch of files; one file is parsed whole."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import language_of
from graphloom.plans.model import Graph, twin

SCHEMA = "path string, kind string, name string, qualified_name string, start_line int, end_line int, complexity int, target string, conditional boolean"
#: Declarations by language, and words that open a branch.
DECLARATIONS = {
    "typescript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("import", r"^\s*import\s+.*?from\s+['\"]([^'\"]+)['\"]")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("import", r"^\s*(?:import\s+)?\"([^\"]+)\"\s*$")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("interface", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("import", r"^\s*use\s+([\w:]+)")],
    "java": [("class", r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("function", r"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$"), ("import", r"^\s*import\s+([\w.]+);")],
}
BRANCH = re.compile(r"\b(if|else|for|while|case|catch|switch|match|loop)\b|\?\s|&&|\|\|")
_NODES = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.Try, ast.ExceptHandler, ast.With, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Match)


def parse_python(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows = []

    def walk(node, owner: str, conditional: bool):
        for child in ast.iter_child_nodes(node):
            inside = conditional or isinstance(node, (ast.If, ast.For, ast.While, ast.Try))
            name = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{child.name}" if owner else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                rows.append((path, kind, child.name, f"{path}:{name}", child.lineno, child.end_lineno, 1 + sum(isinstance(x, _NODES) for x in ast.walk(child)), None, None))
                inside = False
            elif isinstance(child, ast.Import):
                rows.extend((path, "import", a.name, None, child.lineno, child.end_lineno, None, a.name, None) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.append((path, "import", child.module or "", None, child.lineno, child.end_lineno, None, "." * child.level + (child.module or ""), None))
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                called = child.func.id if isinstance(child.func, ast.Name) else child.func.attr
                rows.append((path, "call", called, f"{path}:{owner}" if owner else None, child.lineno, child.end_lineno, None, called, inside))
            walk(child, name, inside)

    walk(tree, "", False)
    return rows


def _block_end(lines: list[str], start: int) -> int:
    """The line on which the braces opened from here close, within 100 lines; else 20 on."""
    depth, opened = 0, False
    for i in range(start, min(len(lines), start + 100)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0:
            return i
    return min(len(lines) - 1, start + 20)


def parse_simple(path: str, text: str, language: str) -> list[tuple]:
    lines = text.split("\n")
    patterns = [(k, re.compile(p)) for k, p in DECLARATIONS.get(language, DECLARATIONS["typescript"])]
    rows = []
    for i, line in enumerate(lines):
        for kind, pattern in patterns:
            m = pattern.search(line)
            if m:
                if kind == "import":
                    rows.append((path, kind, m[1], None, i + 1, i + 1, None, m[1], None))
                else:
                    end = _block_end(lines, i)
                    rows.append((path, kind, m[1], f"{path}:{m[1]}", i + 1, end + 1, 1 + sum(len(BRANCH.findall(x)) for x in lines[i : end + 1]), None, None))
                break
    return rows


def parse(path: str, text: str, language: str) -> list[tuple]:
    return parse_python(path, text) if language == "python" else parse_simple(path, text, language)


def parse_files(files: DataFrame) -> DataFrame:
    """Declarations, imports and calls of files (path, text)."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, t, lang in zip(f["path"], f["text"], f["language"], strict=True) for r in parse(p, t or "", lang)]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("start_line", "end_line", "complexity"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", F.col("text"), language_of(F.col("path")).alias("language")).mapInPandas(run, SCHEMA)


def chunk_code(files: DataFrame, parsed: DataFrame, block: int = 50) -> DataFrame:
    """One chunk per declaration; blocks of lines for files without one."""
    declared = parsed.filter("kind in ('function', 'method', 'class', 'interface')").select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "name")
    bare = files.join(declared.select("path").distinct(), "path", "left_anti").select("path", F.size(F.split("text", "\n")).alias("n"))
    starts = bare.select("path", "n", F.explode(F.sequence(F.lit(1), "n", F.lit(block))).alias("start"))
    rows = declared.unionByName(starts.select("path", "start", F.least(F.col("start") + block - 1, "n").alias("end"), F.lit("").alias("name")))
    return rows.withColumn("chunk_id", F.concat("path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def manifest_dependencies(files: DataFrame, limit: int = 30) -> DataFrame:
    """Dependency names of package.json, requirements.txt and go.mod files, sorted, at most `limit`."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    npm = files.filter(name == "package.json").select(F.explode(F.json_object_keys(F.get_json_object("text", "$.dependencies"))).alias("dependency"))
    pip = files.filter(name == "requirements.txt").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z0-9_.-]+)"), 1)).alias("dependency"))
    go = files.filter(name == "go.mod").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(?:require)?\s+([\w./-]+) v"), 1)).alias("dependency"))
    return npm.unionByName(pip).unionByName(go).distinct().orderBy("dependency").limit(limit)


def derived_sources(g: Graph) -> DataFrame:
    """A Python source per symbol: a class with a method that calls two others."""
    body = F.format_string("import os\nclass C%s:\n    def run(self):\n        if os:\n            f%s()\n        return g%s()\n", *[F.regexp_replace("qualified_name", "\\D", "")] * 3)
    return g.symbols.select(F.concat(F.regexp_replace("qualified_name", ":", "/"), F.lit(".py")).alias("path"), body.alias("text"))


QUERIES = {
    "parse_symbols": lambda spark, d: parse_files(derived_sources(Graph(spark, d))).filter("kind in ('class', 'method')").select("path", "kind", "name", "qualified_name", "start_line", "end_line", "complexity"),
    "parse_calls": lambda spark, d: parse_files(derived_sources(Graph(spark, d))).filter("kind = 'call'").select("path", "name", "qualified_name", "start_line", "conditional"),
    "parse_imports": lambda spark, d: parse_files(derived_sources(Graph(spark, d))).filter("kind = 'import'").select("path", "target"),
    "chunk_code": lambda spark, d: chunk_code(derived_sources(Graph(spark, d)), parse_files(derived_sources(Graph(spark, d)))).select("path", "chunk_id"),
}
_P = ", ps AS (SELECT 'part/' || p_partkey || '.py' AS path, p_partkey AS k FROM part)"
ORACLES = {k: twin(v) for k, v in {
    "parse_symbols": _P + " SELECT path, 'class' AS kind, 'C' || k AS name, path || ':C' || k AS qualified_name, 2::INT AS start_line, 6::INT AS end_line, 2::INT AS complexity FROM ps UNION ALL SELECT path, 'method', 'run', path || ':C' || k || '.run', 3, 6, 2 FROM ps",
    "parse_calls": _P + " SELECT path, 'f' || k AS name, path || ':C' || k || '.run' AS qualified_name, 5::INT AS start_line, true AS conditional FROM ps UNION ALL SELECT path, 'g' || k, path || ':C' || k || '.run', 6, false FROM ps",
    "parse_imports": _P + " SELECT path, 'os' AS target FROM ps",
    "chunk_code": _P + " SELECT path, path || ':2-6' AS chunk_id FROM ps UNION ALL SELECT path, path || ':3-6' FROM ps",
}.items()}
