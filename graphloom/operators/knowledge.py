"""Hierarchical summaries, session knowledge, commit analysis, requirement traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, content_hash, dirname, first_sentence
from graphloom.operators.aggregates import hot_spots, union
from graphloom.operators.windows import top_per_key
from graphloom.plans.model import Graph, twin
from graphloom.staging import cut


# Words of programming languages that are no keywords of a text.
COMMON_WORDS = [
    "if", "else", "for", "while", "return", "const", "let", "var", "function", "class", "import", "export", "from", "async", "await", "try", "catch", "throw", "new", "this", "true", "false", "null", "undefined", "string", "number",
    "boolean", "any", "void", "type", "interface", "extends", "implements", "private", "public", "static", "def", "self", "None", "True", "False", "and", "or", "not", "in", "func", "package", "struct", "impl", "pub", "use", "mod", "fn",
]


def keyword_counts(texts: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """The k most frequent identifiers of each text: over 2 characters, no common words; the first seen of equal ones."""
    words = F.posexplode(F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"), 1)).alias("at", "word")
    counted = texts.select(key, words).filter((F.length("word") > 2) & ~F.col("word").isin(COMMON_WORDS)).groupBy(key, "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return top_per_key(counted, key, [F.desc("n"), "first"], k)


def aggregate_keywords(keywords: DataFrame, home: DataFrame, key: str, group: str, k: int = 15) -> DataFrame:
    """The k keywords of each group that most of its members have; equal ones by name."""
    counted = keywords.join(home, key).groupBy(group, "word").agg(F.count_distinct(key).alias("n"))
    return top_per_key(counted, group, [F.desc("n"), "word"], k)


def _listed(ranked: DataFrame, key: str) -> DataFrame:
    """Ranked words of each key as one list."""
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))


def _children_keywords(children: DataFrame, k: int = 15) -> DataFrame:
    """Per parent, the k keywords that most of its children list; equal ones by name."""
    words = children.select("parent", F.explode("keywords").alias("word")).groupBy("parent", "word").agg(F.count("*").alias("n"))
    return _listed(top_per_key(words, "parent", [F.desc("n"), "word"], k), "parent")


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


_NONE = lambda: F.array().cast("array<string>")
_HASH = lambda: F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256), 1, 16)
#: Where files and directories of the root hang.
ROOT = "repo:default"
SUMMARY = ["id", "level", "parent", "hash", "summary", "symbols", "languages", "keywords"]


def _parent(path: Column) -> Column:
    return F.when(dirname(path) == "", ROOT).otherwise(F.concat(F.lit("dir:"), dirname(path)))


def summarize_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Level 1: id, parent, hash of the code, the docstring's first sentence or a template, keywords of the code.

    The code is the signature and the docstring."""
    text = F.when(F.coalesce("docstring", F.lit("")) != "", first_sentence(F.col("docstring"))).otherwise(F.concat(F.initcap("kind"), F.lit(" "), "name", F.lit(" in "), basename(F.col("file")), F.lit(".")))
    code = symbols.withColumn("code", F.concat_ws(" ", "signature", "docstring"))
    keywords = _listed(keyword_counts(code, "qualified_name", "code"), "qualified_name")
    rows = code.join(keywords, "qualified_name", "left").join(files.select(F.col("path").alias("file"), "language"), "file", "left")
    return rows.select(
        F.concat(F.lit("symbol:"), "qualified_name").alias("id"), F.lit(1).alias("level"), F.concat(F.lit("file:"), "file").alias("parent"), content_hash(F.col("signature")).alias("hash"), text.alias("summary"), F.lit(1).cast("long").alias("symbols"),
        F.array(F.coalesce("language", F.lit("unknown"))).alias("languages"), F.coalesce("keywords", _NONE()).alias("keywords"), "file", "name", (F.col("visibility") == "public").alias("exported"),
    )


def summarize_files(level1: DataFrame, most: int = 50) -> DataFrame:
    """Level 2: up to `most` symbols a file; its exports (five at most), the number of symbols, the keywords that
    most of them have, and a hash over theirs in order."""
    few = top_per_key(level1, "parent", ["id"], most)
    exports = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("exported"), F.struct("rank", "name")))), lambda x: x["name"]), 1, 5)
    rows = few.groupBy("parent", "file").agg(F.count("*").alias("symbols"), _HASH().alias("hash"), F.first("languages").alias("languages"), exports.alias("exports")).join(_children_keywords(few), "parent", "left")
    n = F.concat(F.col("symbols").cast("string"), F.lit(" symbol"), _plural(F.col("symbols")), F.lit("."))
    language = F.col("languages")[0]
    text = F.when(F.size("exports") > 0, F.concat(language, F.lit(" file exporting "), F.array_join("exports", ", "), F.lit(". Contains "), n)).otherwise(F.concat(language, F.lit(" file with "), n))
    return rows.select(F.col("parent").alias("id"), F.lit(2).alias("level"), _parent(F.col("file")).alias("parent"), "hash", text.alias("summary"), "symbols", "languages", F.coalesce("keywords", _NONE()).alias("keywords"))


def summarize_directories(level2: DataFrame) -> DataFrame:
    """Level 3: a row for each directory that has files of its own, the deepest first, over those files and the
    directories right below it that have a row.  The root has none."""
    files = cut(level2.withColumn("depth", F.when(F.col("parent") == ROOT, 0).otherwise(F.size(F.split("parent", "/")))))
    homes = files.filter("depth > 0").select("parent", "depth").distinct()
    deepest = homes.agg(F.max("depth")).first()[0] or 0
    done: list[DataFrame] = []
    for depth in range(deepest, 0, -1):
        children = files.filter(F.col("depth") == depth).drop("depth")
        if done:
            below = done[-1].join(homes.filter(F.col("depth") == depth).select("parent"), "parent", "left_semi")
            children = children.unionByName(below.select(*children.columns))
        rows = children.groupBy("parent").agg(F.sum("symbols").alias("symbols"), F.count("*").alias("n"), _HASH().alias("hash"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"))
        rows = rows.join(_children_keywords(children), "parent", "left")
        folder = F.regexp_replace("parent", "^dir:", "")
        text = F.concat(basename(folder), F.lit(" module with "), F.col("n").cast("string"), F.lit(" "), F.array_join("languages", ", "), F.lit(" file"), _plural(F.col("n")), F.lit("."))
        done.append(cut(rows.select(F.col("parent").alias("id"), F.lit(3).alias("level"), _parent(folder).alias("parent"), "hash", text.alias("summary"), "symbols", "languages", F.coalesce("keywords", _NONE()).alias("keywords"))))
    return union(done) if done else files.drop("depth").filter("false")


def summarize_all(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """All levels, bottom up; files of the root hang under the repository, which has no row."""
    level1 = summarize_symbols(symbols, files)
    level2 = cut(summarize_files(level1))
    return level1.select(*SUMMARY).unionByName(level2.select(*SUMMARY)).unionByName(summarize_directories(level2).select(*SUMMARY))


def basic_summary(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, symbols and the languages by their number of files."""
    counted = files.groupBy("language").agg(F.count("*").alias("n")).agg(F.sum("n").alias("files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "language"))), lambda x: x["language"]), ", ").alias("languages"))
    return counted.join(symbols.agg(F.count("*").alias("symbols"))).select(F.concat(F.lit("Codebase of "), F.col("files").cast("string"), F.lit(" files and "), F.col("symbols").cast("string"), F.lit(" symbols in "), "languages", F.lit(".")).alias("summary"))


def summary_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries to make again: ids whose hash is new or has changed."""
    return new.join(old.select("id", "hash"), ["id", "hash"], "left_anti")


def delta_cost(changed: DataFrame, strategy: str, cents_per_call: float = 0.5, most: int = 100) -> DataFrame:
    """Calls and cents of a strategy: free makes none, budget at most `most`, quality all."""
    n = F.count("*")
    calls = {"free": F.lit(0).cast("long"), "budget": F.least(n, F.lit(most).cast("long")), "quality": n}[strategy]
    return changed.agg(calls.alias("calls"), F.round(calls * cents_per_call, 4).alias("cents"))


def detect_patterns(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Names of patterns of which some path matches."""
    out = None
    for name, pattern in rules.items():
        row = files.filter(F.col("path").rlike(pattern)).limit(1).select(F.lit(name).alias("pattern"))
        out = row if out is None else out.unionByName(row)
    return out


def about_edges(turns: DataFrame, symbols: DataFrame) -> DataFrame:
    """ABOUT edges of session turns to symbols that exist."""
    e = turns.select("session_id", "turn_number", F.explode("symbols_referenced").alias("qualified_name")).distinct()
    return e.join(symbols.select("qualified_name"), "qualified_name", "left_semi")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, deleted, or modified (another signature) symbols."""
    both = old.select("qualified_name", F.col("signature").alias("o"), F.col("file").alias("of"), F.col("complexity").alias("oc")).join(new.select("qualified_name", F.col("signature").alias("n"), F.col("file").alias("nf"), F.col("complexity").alias("nc")), "qualified_name", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return both.withColumn("change", change).filter("change is not null").select("qualified_name", F.coalesce("nf", "of").alias("file"), "change", F.col("oc").alias("old_complexity"), F.col("nc").alias("new_complexity"))


def affected_callers(changes: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callers in other files of modified and deleted symbols."""
    c = changes.filter("change in ('modified', 'deleted')").select(F.col("qualified_name").alias("dst"), F.col("file").alias("dst_file"), "change")
    s = symbols.select(F.col("qualified_name").alias("src"), F.col("file").alias("src_file"))
    return calls.join(c, "dst").join(s, "src").filter("src_file != dst_file").select("src", "dst", "change")


def breaking_changes(affected: DataFrame) -> DataFrame:
    return affected.groupBy("dst", "change").agg(F.count("*").alias("callers"))


def complexity_delta(changes: DataFrame) -> DataFrame:
    added = F.sum(F.when(F.col("change") == "added", F.coalesce("new_complexity", F.lit(1))).otherwise(0))
    gone = F.sum(F.when(F.col("change") == "deleted", F.coalesce("old_complexity", F.lit(1))).otherwise(0))
    return changes.agg((added - gone).alias("delta"))


def commit_type(files: DataFrame) -> DataFrame:
    """Rules in order over the paths of each commit; files: sha, path, added."""
    every = lambda p: F.bool_and(F.col("path").rlike(p))
    some = lambda p: F.bool_or(F.col("path").rlike(p))
    kind = F.when(every(r"(^|/)tests?/|\.test\."), "test").when(every(r"\.md$|^docs/"), "docs").when(every(r"package\.json$|Makefile$|Dockerfile$"), "build").when(some(r"^\.github/|\.ci"), "ci")
    kind = kind.when(F.bool_or("added"), "feat").when(F.count("*") > 3, "refactor").when(F.count("*") > 0, "fix").otherwise("chore")
    return files.groupBy("sha").agg(kind.alias("type"))


def affected_modules(paths: DataFrame) -> DataFrame:
    """The first two directories of paths, distinct."""
    parts = F.split(dirname(F.col("path")), "/")
    return paths.select(F.array_join(F.slice(parts, 1, 2), "/").alias("module")).filter("module != ''").distinct()


def traceability(requirements: DataFrame, implementations: DataFrame, docs: DataFrame) -> DataFrame:
    """Per requirement: implementations and documents that carry its number."""
    i = implementations.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("implementations"))
    d = docs.groupBy(F.col("req").alias("number")).agg(F.count("*").alias("documents"))
    return requirements.join(i, "id", "left").join(d, "number", "left").select("id", F.coalesce("implementations", F.lit(0)).alias("implementations"), F.coalesce("documents", F.lit(0)).alias("documents"))


def locate(requirements: DataFrame, x: str) -> DataFrame:
    """The exact id, else ids that hold x."""
    exact = requirements.filter(F.col("id") == x)
    return requirements.filter(F.col("id").contains(x)).join(exact.agg(F.count("*").alias("n")), F.lit(True)).filter((F.col("n") == 0) | (F.col("id") == x)).drop("n")


def risk_note(risk: Column, direct: Column) -> Column:
    return F.concat(F.initcap(risk), F.lit(" risk: "), direct.cast("string"), F.lit(" direct callers"))


def _level1(g: Graph) -> DataFrame:
    return summarize_symbols(g.symbols, g.files)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("id", "level", "parent", "hash", "summary", "symbols", F.array_join("languages", ",").alias("languages"), F.array_join("keywords", ",").alias("keywords"))


def _new(g: Graph) -> DataFrame:
    s = g.symbols.filter("complexity % 9 != 0")
    return s.withColumn("signature", F.when(F.col("complexity") % 7 == 0, F.concat("signature", F.lit("!"))).otherwise(F.col("signature")))


def _old(g: Graph) -> DataFrame:
    return g.symbols.filter("complexity % 8 != 0")


def _commit_files(g: Graph) -> DataFrame:
    path = F.when(F.col("deletions") % 5 == 0, F.concat(F.lit("docs/"), "path", F.lit(".md"))).when(F.col("deletions") % 7 == 0, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path"))
    return g.modifies.select("sha", path.alias("path"), (F.col("insertions") > 60).alias("added"))


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


PATTERNS = {"promo": "/PROMO$", "brand seven": "^Brand#7/", "tests": "/tests/"}
QUERIES = {
    "keyword_counts": _q(lambda g: keyword_counts(g.symbols, "qualified_name", "docstring").select("qualified_name", "word", "n")),
    "keyword_aggregate": _q(lambda g: aggregate_keywords(keyword_counts(g.symbols, "qualified_name", "docstring"), g.symbols.select("qualified_name", "file"), "qualified_name", "file").select("file", "word", "n")),
    "summary_symbol": _q(lambda g: _flat(_level1(g))),
    "summary_file": _q(lambda g: _flat(summarize_files(_level1(g)))),
    "summary_dir": _q(lambda g: _flat(summarize_directories(summarize_files(_level1(g))))),
    "summary_all": _q(lambda g: summarize_all(g.symbols, g.files).groupBy("level").agg(F.count("*").alias("n"), F.sum("symbols").alias("symbols"), F.count_distinct("parent").alias("parents"))),
    "basic_summary": _q(lambda g: basic_summary(g.symbols, g.files)),
    "summary_delta": _q(lambda g: delta_cost(summary_delta(_level1(g), summarize_symbols(_new(g), g.files)), "budget")),
    "summary_children": _q(lambda g: _level1(g).filter("parent = 'file:Brand#3/SMALL'").orderBy("id").limit(100).select("id", "level", "summary")),
    "codebase_summary": _q(lambda g: hot_spots(g.symbols, g.calls, "function", 0, 5).select(F.concat(F.lit("hot:"), "qualified_name").alias("item")).unionByName(g.files.groupBy("language").agg(F.count("*").alias("n")).select(F.concat_ws(":", F.lit("language"), "language", F.col("n").cast("string")).alias("item")))),
    "detect_patterns": _q(lambda g: detect_patterns(g.files, PATTERNS)),
    "session_upsert": _q(lambda g: about_edges(g.turns, g.symbols)),
    "symbol_changes": _q(lambda g: symbol_changes(_old(g), _new(g)).select("qualified_name", "file", "change")),
    "affected_callers": _q(lambda g: affected_callers(symbol_changes(_old(g), _new(g)), g.calls, g.symbols)),
    "breaking_changes": _q(lambda g: breaking_changes(affected_callers(symbol_changes(_old(g), _new(g)), g.calls, g.symbols))),
    "complexity_delta": _q(lambda g: complexity_delta(symbol_changes(_old(g), _new(g)))),
    "commit_type": _q(lambda g: commit_type(_commit_files(g))),
    "affected_modules": _q(lambda g: affected_modules(_commit_files(g))),
    "traceability": _q(lambda g: traceability(g.requirements, g.implementations, g.documents.select((F.col("doc_id") % 40).cast("int").alias("req")))),
    "prd_locate_chunk": _q(lambda g: locate(g.requirements, "NATION_2").select("id").unionByName(locate(g.requirements, "TION_1").select("id"))),
}

_CW = "['if', 'else', 'for', 'while', 'return', 'const', 'let', 'var', 'function', 'class', 'import', 'export', 'from', 'async', 'await', 'try', 'catch', 'throw', 'new', 'this', 'true', 'false', 'null', 'undefined', 'string', 'number', 'boolean', 'any', 'void', 'type', 'interface', 'extends', 'implements', 'private', 'public', 'static', 'def', 'self', 'None', 'True', 'False', 'and', 'or', 'not', 'in', 'func', 'package', 'struct', 'impl', 'pub', 'use', 'mod', 'fn']"
_kw = lambda text: f"(SELECT qualified_name, file, word, n, r FROM (SELECT qualified_name, file, word, n, row_number() OVER (PARTITION BY qualified_name ORDER BY n DESC, seen) AS r FROM (SELECT qualified_name, file, word, count(*) AS n, min(pos) AS seen FROM (SELECT qualified_name, file, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT qualified_name, file, regexp_extract_all({text}, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b') AS w FROM symbols)) WHERE length(word) > 2 AND NOT list_contains({_CW}, word) GROUP BY ALL)) WHERE r <= 10)"
_L1 = f", k1 AS (SELECT * FROM {_kw("signature || ' ' || docstring")}), l1 AS (SELECT 'symbol:' || qualified_name AS id, 1 AS level, 'file:' || file AS parent, sha256(signature)[1:16] AS hash, name || '.' AS summary, 1::BIGINT AS symbols, language AS languages, (SELECT string_agg(word, ',' ORDER BY r) FROM k1 WHERE k1.qualified_name = s.qualified_name) AS keywords, file, name, visibility FROM symbols s JOIN files ON path = file)"
_L2 = _L1 + """, l1r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id) AS r FROM l1), k2 AS (SELECT file, word, row_number() OVER (PARTITION BY file ORDER BY n DESC, word) AS r FROM (SELECT k1.file, word, count(*) AS n FROM k1 JOIN l1r ON l1r.id = 'symbol:' || k1.qualified_name WHERE l1r.r <= 50 GROUP BY ALL)),
  l2 AS (SELECT parent AS id, 2 AS level, 'dir:' || split_part(file, '/', 1) AS parent, sha256(string_agg(hash, '' ORDER BY hash))[1:16] AS hash, any_value(languages) || ' file' || coalesce(' exporting ' || array_to_string((list(name ORDER BY r) FILTER (visibility = 'public'))[1:5], ', ') || '. Contains ', ' with ') || count(*) || ' symbol' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '.' AS summary,
    count(*) AS symbols, any_value(languages) AS languages, (SELECT string_agg(word, ',' ORDER BY k2.r) FROM k2 WHERE k2.file = l1r.file AND k2.r <= 15) AS keywords FROM l1r WHERE r <= 50 GROUP BY parent, file)"""
_L3 = _L2 + """, k3 AS (SELECT parent, word, row_number() OVER (PARTITION BY parent ORDER BY n DESC, word) AS r FROM (SELECT parent, word, count(*) AS n FROM (SELECT parent, unnest(string_split(keywords, ',')) AS word FROM l2) GROUP BY ALL)),
  l3 AS (SELECT parent AS id, 3 AS level, 'repo:default' AS parent, sha256(string_agg(hash, '' ORDER BY hash))[1:16] AS hash, substr(l2.parent, 5) || ' module with ' || count(*) || ' ' || string_agg(DISTINCT languages, ', ' ORDER BY languages) || ' file' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '.' AS summary, sum(symbols)::BIGINT AS symbols,
    string_agg(DISTINCT languages, ',' ORDER BY languages) AS languages, (SELECT string_agg(word, ',' ORDER BY r) FROM k3 WHERE k3.parent = l2.parent AND r <= 15) AS keywords FROM l2 GROUP BY l2.parent)"""
_SUM = "id, level, parent, hash, summary, symbols, languages, keywords"
_CH = ", nw AS (SELECT qualified_name, file, complexity, signature || CASE WHEN complexity % 7 = 0 THEN '!' ELSE '' END AS signature FROM symbols WHERE complexity % 9 <> 0), ol AS (SELECT * FROM symbols WHERE complexity % 8 <> 0), ch AS (SELECT * FROM (SELECT coalesce(o.qualified_name, n.qualified_name) AS qualified_name, coalesce(n.file, o.file) AS file, CASE WHEN o.signature IS NULL THEN 'added' WHEN n.signature IS NULL THEN 'deleted' WHEN o.signature <> n.signature THEN 'modified' END AS change, o.complexity AS oc, n.complexity AS nc FROM ol o FULL JOIN nw n ON o.qualified_name = n.qualified_name) WHERE change IS NOT NULL)"
_AF = _CH + ", af AS (SELECT c.src, c.dst, h.change FROM calls c JOIN ch h ON h.qualified_name = c.dst JOIN symbols s ON s.qualified_name = c.src WHERE h.change IN ('modified', 'deleted') AND s.file <> h.file)"
_CF = ", cf AS (SELECT sha, CASE WHEN deletions % 5 = 0 THEN 'docs/' || path || '.md' WHEN deletions % 7 = 0 THEN 'tests/' || path ELSE path END AS path, insertions > 60 AS added FROM modifies)"
ORACLES = {k: twin(v) for k, v in {
    "keyword_counts": f"SELECT qualified_name, word, n FROM {_kw('docstring')}",
    "keyword_aggregate": f"SELECT file, word, n FROM (SELECT file, word, n, row_number() OVER (PARTITION BY file ORDER BY n DESC, word) AS r FROM (SELECT file, word, count(DISTINCT qualified_name) AS n FROM {_kw('docstring')} GROUP BY ALL)) WHERE r <= 15",
    "summary_symbol": _L1 + f" SELECT {_SUM} FROM l1",
    "summary_file": _L2 + f" SELECT {_SUM} FROM l2",
    "summary_dir": _L3 + f" SELECT {_SUM} FROM l3",
    "summary_all": _L3 + " SELECT level, count(*) AS n, sum(symbols)::BIGINT AS symbols, count(DISTINCT parent) AS parents FROM (SELECT level, symbols, parent FROM l1 UNION ALL SELECT level, symbols, parent FROM l2 UNION ALL SELECT level, symbols, parent FROM l3) GROUP BY level",
    "basic_summary": "SELECT 'Codebase of ' || (SELECT count(*) FROM files) || ' files and ' || (SELECT count(*) FROM symbols) || ' symbols in ' || (SELECT string_agg(language, ', ' ORDER BY n DESC, language) FROM (SELECT language, count(*) AS n FROM files GROUP BY 1)) || '.' AS summary",
    "summary_delta": "SELECT least(count(*), 100) AS calls, round(least(count(*), 100) * 0.5::DOUBLE, 4) AS cents FROM symbols WHERE complexity % 9 <> 0 AND complexity % 7 = 0",
    "summary_children": _L1 + " SELECT id, level, summary FROM l1 WHERE parent = 'file:Brand#3/SMALL' ORDER BY id LIMIT 100",
    "codebase_summary": "SELECT 'hot:' || q AS item FROM (SELECT qualified_name AS q, count(*) AS n FROM symbols JOIN calls ON dst = qualified_name WHERE kind = 'function' GROUP BY 1 ORDER BY n DESC, q LIMIT 5) UNION ALL SELECT 'language:' || language || ':' || count(*) FROM files GROUP BY language",
    "detect_patterns": "SELECT 'promo' AS pattern UNION ALL SELECT 'brand seven'",
    "session_upsert": "SELECT DISTINCT q AS qualified_name, session_id, turn_number FROM (SELECT session_id, turn_number, unnest(symbols_referenced) AS q FROM turns) WHERE q IN (SELECT qualified_name FROM symbols)",
    "symbol_changes": _CH + " SELECT qualified_name, file, change FROM ch",
    "affected_callers": _AF + " SELECT * FROM af",
    "breaking_changes": _AF + " SELECT dst, change, count(*) AS callers FROM af GROUP BY ALL",
    "complexity_delta": _CH + " SELECT (coalesce(sum(nc) FILTER (change = 'added'), 0) - coalesce(sum(oc) FILTER (change = 'deleted'), 0))::BIGINT AS delta FROM ch",
    "commit_type": _CF + " SELECT sha, CASE WHEN bool_and(starts_with(path, 'tests/')) THEN 'test' WHEN bool_and(starts_with(path, 'docs/')) THEN 'docs' WHEN bool_or(added) THEN 'feat' WHEN count(*) > 3 THEN 'refactor' ELSE 'fix' END AS type FROM cf GROUP BY sha",
    "affected_modules": _CF + " SELECT DISTINCT array_to_string(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/')[1:2], '/') AS module FROM cf",
    "traceability": "SELECT r.id, (SELECT count(*) FROM implementations i WHERE i.dst = r.id) AS implementations, (SELECT count(*) FROM docs d WHERE d.doc_id % 40 = r.number) AS documents FROM requirements r",
    "prd_locate_chunk": "SELECT id FROM requirements WHERE id = 'NATION_2' UNION ALL SELECT id FROM requirements WHERE contains(id, 'TION_1')",
}.items()}
