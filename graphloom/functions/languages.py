"""Sources of several languages made from the symbols, parsed by pattern; exported names and doc comments.

Each symbol has a source file in TypeScript, Go, Rust or Java with imports, a type, functions of a varying number of
branches, and a doc comment above some of them, so what the parser finds depends on the symbol."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.parsers import parse_files
from graphloom.plans.model import Graph, pick, twin

#: How the declarations of a file's exported names begin, by language.
EXPORTS = {
    "typescript": r"(?m)export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function|const|let|var|interface|type|enum)\s+(\w+)", "javascript": r"(?m)export\s+(?:default\s+)?(?:async\s+)?(?:class|function|const|let|var)\s+(\w+)",
    "python": r"(?m)^(?!_)(\w+)\s*=", "go": r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+)([A-Z]\w*)", "rust": r"(?m)pub\s+(?:fn|struct|enum|trait|mod)\s+(\w+)", "java": r"(?m)public\s+(?:abstract\s+|final\s+)*(?:class|interface|enum)\s+(\w+)",
    "c": r"(?m)^(?!static\s)(?:void|int|char|short|long|float|double|size_t|bool|_Bool|\w+_t)\s+\*?(\w+)\s*\(", "cpp": r"(?m)^(?!static\s)(?:class|struct)\s+(\w+)",
}
#: How a doc comment begins, and how lines of one go on; it is looked for in this many lines above.
DOC_STARTS = ("/**", '"""', "///")
COMMENT = re.compile(r"^(//|/\*|\*|#|\"\"\"|$)")
DOC_LINES = 10


def exported(text: str, language: str) -> list[str]:
    """Exported names of a file, each once, in order."""
    pattern = EXPORTS.get(language)
    return list(dict.fromkeys(re.findall(pattern, text))) if pattern else []


def doc_above(lines: list[str], row: int) -> str | None:
    """The doc comment right above a line (from 0): from the nearest line that begins one; code in between ends the search."""
    for i in range(row - 1, max(0, row - DOC_LINES) - 1, -1):
        line = lines[i].strip()
        if line.startswith(DOC_STARTS):
            return "\n".join(lines[i:row]).strip()
        if line and not COMMENT.match(line):
            return None
    return None


def exports(files: DataFrame) -> DataFrame:
    """path, position, name of every exported name; files: path, text, language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, n) for p, t, lang in zip(f["path"], f["text"], f["language"], strict=True) for i, n in enumerate(exported(t or "", lang))]
            yield pd.DataFrame(rows, columns=["path", "position", "name"]).astype({"position": "int32"})

    return files.select("path", "text", "language").mapInPandas(run, "path string, position int, name string")


def docstrings(files: DataFrame, declared: DataFrame) -> DataFrame:
    """path, name, docstring of declarations (path, name, start_line) that have a doc comment."""
    at = declared.groupBy("path").agg(F.collect_list(F.struct("name", "start_line")).alias("at"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, t, places in zip(f["path"], f["text"], f["at"], strict=True):
                lines = (t or "").split("\n")
                found = ((x["name"], doc_above(lines, x["start_line"] - 1)) for x in places)
                rows += [(p, n, d) for n, d in found if d is not None]
            yield pd.DataFrame(rows, columns=["path", "name", "docstring"])

    return files.join(at, "path").select("path", "text", "at").mapInPandas(run, "path string, name string, docstring string")


LANGUAGES = ["typescript", "go", "rust", "java"]
_EXTENSION = {"typescript": ".ts", "go": ".go", "rust": ".rs", "java": ".java"}
_HEAD = {
    "typescript": "import {x} from './lib%d'\n\n/** About %d */\nexport class T%d {\n}\n", "go": "import \"lib%d\"\n\n/// About %d\ntype T%d struct {\n}\n", "rust": "use lib%d::x;\n\n/// About %d\npub struct T%d {\n}\n",
    "java": "import lib%d.X;\n\n/** About %d */\npublic class T%d {\n}\n",
}
_FUNCTION = {"typescript": "export function run%d(a) {\n", "go": "func Run%d(a int) {\n", "rust": "pub fn run%d(a: i32) {\n", "java": "    public int run%d(int a) {\n"}


def sources(g: Graph) -> DataFrame:
    """path, text, language, k: head, then a function with complexity % 4 branches."""
    k = F.regexp_replace("qualified_name", "\\D", "").cast("long")
    language = pick(LANGUAGES, k % 4)
    chosen = lambda table, n: F.coalesce(*[F.when(language == x, F.format_string(table[x], *[k] * n)) for x in LANGUAGES])
    branches = F.repeat(F.lit("  if (a > 1) { b(); }\n"), (F.col("complexity") % 4).cast("int"))
    text = F.concat(chosen(_HEAD, 3), chosen(_FUNCTION, 1), branches, F.lit("}\n"))
    ending = F.coalesce(*[F.when(language == x, F.lit(_EXTENSION[x])) for x in LANGUAGES])
    return g.symbols.select(F.concat(F.lit("src/"), k.cast("string"), ending).alias("path"), text.alias("text"), language.alias("language"), k.alias("k"), "complexity")


def _parsed(g: Graph) -> DataFrame:
    return parse_files(sources(g))


def _declared(g: Graph) -> DataFrame:
    return _parsed(g).filter("kind != 'import'").select("path", "name", "start_line")


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


QUERIES = {
    "parse_languages": _q(lambda g: _parsed(g).filter("kind != 'import'").select("path", "kind", "name", "start_line", "end_line", "complexity")),
    "parse_language_imports": _q(lambda g: _parsed(g).filter("kind = 'import'").select("path", "target")),
    "parse_exports": _q(lambda g: exports(sources(g))),
    "docstrings": _q(lambda g: docstrings(sources(g).select("path", "text"), _declared(g))),
}
_SR = ", sr AS (SELECT substr(qualified_name, 6)::BIGINT AS k, complexity % 4 AS b, 'src/' || substr(qualified_name, 6) || ['.ts', '.go', '.rs', '.java'][substr(qualified_name, 6)::BIGINT % 4 + 1] AS path FROM symbols)"
ORACLES = {k: twin(v) for k, v in {
    "parse_languages": _SR + " SELECT path, 'class' AS kind, 'T' || k AS name, 4::INT AS start_line, 5::INT AS end_line, 1::INT AS complexity FROM sr UNION ALL SELECT path, 'function', CASE WHEN k % 4 = 1 THEN 'Run' ELSE 'run' END || k, 6, (7 + b)::INT, (1 + b)::INT FROM sr",
    "parse_language_imports": _SR + " SELECT path, ['./lib' || k, 'lib' || k, 'lib' || k || '::x', 'lib' || k || '.X'][k % 4 + 1] AS target FROM sr",
    "parse_exports": _SR + " SELECT path, 0::INT AS position, 'T' || k AS name FROM sr UNION ALL SELECT path, 1, CASE WHEN k % 4 = 1 THEN 'Run' ELSE 'run' END || k FROM sr WHERE k % 4 <> 3",
    "docstrings": _SR + " SELECT path, 'T' || k AS name, CASE WHEN k % 4 IN (0, 3) THEN '/** About ' || k || ' */' ELSE '/// About ' || k END AS docstring FROM sr",
}.items()}
