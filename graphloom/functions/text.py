"""Column expressions: paths, hashes, tokens, grammar of commits, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin

#: Languages by file extension.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "sql": "sql", "md": "markdown", "json": "json",
}
#: Words that are no keywords.
STOP_WORDS = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "with", "this", "that", "from", "have", "was", "how", "what", "when", "where", "which", "why", "who", "does", "use"]


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extname(path: Column) -> Column:
    """The extension with its dot, '' if there is none or the name only begins with a dot."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def normalize_path(path: Column) -> Column:
    """Fold . and .. segments away; .. beyond the start of a relative path stays."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(acc, x):
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1))
        up = (x == "..") & last.isNotNull() & (last != "..")
        return F.when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.regexp_replace(folded, r"^(\.\./?)+", ""))).otherwise(folded)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))), F.lit("unknown"))


def language_or_extension(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), ext)


def content_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def hash_id(text: Column) -> Column:
    """The 31-multiplier 32-bit string hash, as an absolute value."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def step(h, c):
        wrapped = F.pmod(h * 31 + c, F.lit(1 << 32))
        return F.when(wrapped >= (1 << 31), wrapped - (1 << 32)).otherwise(wrapped)

    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), step))


def fold_space(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def slug(text: Column) -> Column:
    x = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(x, "^-|-$", "")


def tokens(text: Column) -> Column:
    """Ordered distinct keywords: lower case, no punctuation, over 2 characters, no stop words or numbers."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " ")), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS) & ~w.rlike(r"^\d+$"))
    return F.array_distinct(kept)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def section_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^##\s+"))


def first_sentence(text: Column) -> Column:
    return F.concat(F.trim(F.split(text, "[.!?]")[0]), F.lit("."))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def truncate_tokens(text: Column, most: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > 4 * most, F.concat(F.substring(text, 1, 4 * most), F.lit(marker))).otherwise(text)


def version_key(version: Column) -> Column:
    """Three numbers; missing or broken parts are 0."""
    parts = F.split(version, r"\.")
    return F.array(*[F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in (1, 2, 3)])


def normalize_url(url: Column) -> Column:
    """host/path of a repository URL: no protocol, user, or .git; lower case."""
    x = F.regexp_replace(url, r"\.git$", "")
    x = F.regexp_replace(x, r"^[A-Za-z0-9._-]+@([^:/]+):", "$1/")
    x = F.regexp_replace(x, r"^[a-z+]+://", "")
    return F.lower(F.regexp_replace(x, r"^[^/@]*@", ""))


def repo_id(url: Column) -> Column:
    return F.substring(F.sha2(normalize_url(url), 256), 1, 16)


def chunk_id(file: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", file, start.cast("string"), end.cast("string"))


def parse_chunk_id(x: Column) -> Column:
    pattern = r"^(.*):(\d+):(\d+)$"
    return F.struct(F.regexp_extract(x, pattern, 1).alias("file"), F.regexp_extract(x, pattern, 2).cast("long").alias("start"), F.regexp_extract(x, pattern, 3).cast("long").alias("end"))


COMMIT = r"^(\w+)(?:\(([^)]*)\))?!?:\s*(.*)$"
BRANCH = r"^(feature|feat|fix|bugfix|hotfix|chore|docs|refactor|test)/(?:([A-Z]+-\d+)[-_])?(.*)$"


def commit_parts(message: Column) -> Column:
    """type, scope and description of a conventional commit."""
    return F.struct(F.regexp_extract(message, COMMIT, 1).alias("type"), F.regexp_extract(message, COMMIT, 2).alias("scope"), F.regexp_extract(message, COMMIT, 3).alias("description"))


def branch_parts(branch: Column) -> Column:
    return F.struct(F.regexp_extract(branch, BRANCH, 1).alias("type"), F.regexp_extract(branch, BRANCH, 2).alias("ticket"), F.regexp_replace(F.regexp_extract(branch, BRANCH, 3), "[-_]", " ").alias("description"))


def diff_stats(diff: Column) -> Column:
    """Added and removed lines and distinct target files of a unified diff."""
    lines = F.split(diff, "\n")
    files = F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\+\+\+ b/(.*)$", 1)), lambda x: x != ""))
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    removed = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return F.struct(added.alias("added"), removed.alias("removed"), F.size(files).alias("files"))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def links_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def sanitize_pattern(value: str) -> str:
    """A literal as a regular expression."""
    return re.escape(value)


def search_entities(symbols: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Substring search on names; exact names first."""
    return symbols.filter(F.lower("name").contains(needle.lower())).orderBy(F.lower("name") != needle.lower(), "qualified_name").limit(limit)


def keyword_search(symbols: DataFrame, keywords: list[str], most: int) -> DataFrame:
    """Up to `most` symbols over at most three keywords, an equal share each; first keyword wins."""
    from graphloom.operators.windows import dedup_first, top_per_key

    share = -(-most // len(keywords[:3]))
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k.lower()).alias("k")) for i, k in enumerate(keywords[:3])]))
    hits = symbols.withColumn("kw", table).filter(F.contains(F.lower("name"), F.col("kw.k"))).withColumn("number", F.col("kw.i"))
    return dedup_first(top_per_key(hits, "number", ["qualified_name"], share), ["qualified_name"], ["number"])


def turns_search(turns: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    hit = F.lower("summary").contains(needle.lower()) | F.exists("symbols_referenced", lambda x: F.lower(x).contains(needle.lower()))
    return turns.filter(hit).orderBy(F.desc("timestamp"), "session_id").limit(limit)


def turns_by_symbols(turns: DataFrame, names: list[str], excluded: str | None = None, limit: int = 10) -> DataFrame:
    out = turns.filter(F.arrays_overlap("symbols_referenced", F.array(*map(F.lit, names))))
    if excluded:
        out = out.filter(F.col("session_id") != excluded)
    return out.orderBy(F.desc("timestamp"), "session_id").limit(limit)


def turns_by_files(turns: DataFrame, paths: list[str], excluded: str | None = None, limit: int = 10) -> DataFrame:
    """The newest turns that touched one of some files, not of the session left out; turns: ..., files_touched."""
    out = turns.filter(F.arrays_overlap("files_touched", F.array(*map(F.lit, paths)).cast("array<string>")))
    if excluded:
        out = out.filter(F.col("session_id") != excluded)
    return out.orderBy(F.desc("timestamp"), "session_id").limit(limit)


def format_duration(ms: Column) -> Column:
    """Milliseconds as ms, seconds, or minutes and seconds."""
    seconds = F.floor(ms / 1000)
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60))


def format_percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, 0% of nothing."""
    return F.when(whole == 0, "0%").otherwise(F.format_string("%d%%", F.round(100.0 * part / whole).cast("long")))


def cdata(text: Column) -> Column:
    """A CDATA section; an end mark in the text is split over two."""
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


_c = F.col
QUERIES = {
    "fn_paths": _q(lambda g: g.documents.select("path", dirname(_c("path")).alias("dir"), basename(_c("path")).alias("base"), extname(_c("path")).alias("ext"), language_of(_c("path")).alias("language"))),
    "fn_normalize_path": _q(lambda g: g.files.select("path", normalize_path(F.concat(F.lit("a/./b/../"), "path", F.lit("//../x"))).alias("normal"))),
    "detect_language": _q(lambda g: g.symbols.select("qualified_name", language_of(F.concat("file", F.lit("/m."), F.element_at(F.array(*map(F.lit, ["py", "ts", "rs", "zz"])), (_c("complexity") % 4 + 1).cast("int")))).alias("language"))),
    "ext_to_language": _q(lambda g: g.files.select("path", language_or_extension(F.lower(F.split("path", "/")[1])).alias("language"))),
    "fn_hashes": _q(lambda g: g.symbols.select("qualified_name", content_hash(_c("signature")).alias("h16"), content_hash(_c("signature"), 32).alias("h32"), hash_id(_c("qualified_name")).alias("id"))),
    "fn_fold_space": _q(lambda g: g.documents.select("doc_id", fold_space(_c("text")).alias("t"))),
    "fn_slug": _q(lambda g: g.symbols.select("qualified_name", slug(F.concat(F.lit(" "), "docstring", F.lit(" -- X_y"))).alias("slug"))),
    "fn_tokens": _q(lambda g: g.symbols.select("qualified_name", F.array_join(tokens(F.concat_ws(" ", "docstring", "qualified_name", F.lit("the 123 Of"))), ",").alias("tokens"))),
    "fn_counts": _q(lambda g: g.documents.select("doc_id", word_count(_c("text")).alias("words"), token_estimate(_c("text")).alias("tokens"), section_count(F.concat(F.lit("## a\n"), "text")).alias("sections"))),
    "fn_first_sentence": _q(lambda g: g.symbols.select("qualified_name", first_sentence(_c("docstring")).alias("s"))),
    "fn_truncate": _q(lambda g: g.documents.select("doc_id", truncate_tokens(_c("text"), 20).alias("t"))),
    "fn_version": _q(lambda g: g.symbols.select("qualified_name", F.array_join(version_key(F.concat_ws(".", (_c("complexity") % 7).cast("string"), F.lit("x"), (_c("complexity") % 3).cast("string"))).cast("array<string>"), ".").alias("v"))),
    "fn_normalize_url": _q(lambda g: g.table("pages").select("page_id", normalize_url(F.concat(F.lit("https://user:pw@"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".git"))).alias("u"), repo_id(_c("url")).alias("id"))),
    "fn_chunk_id": _q(lambda g: g.symbols.select(chunk_id(_c("file"), _c("start_line"), _c("end_line")).alias("id")).select("id", parse_chunk_id(_c("id")).alias("p")).select("id", "p.file", "p.start", "p.end")),
    "commit_grammar": _q(lambda g: g.commits.select("sha", commit_parts(_c("message")).alias("p")).select("sha", "p.type", "p.scope", "p.description")),
    "branch_grammar": _q(lambda g: g.symbols.select("qualified_name", branch_parts(F.concat(F.lit("feat/ABC-"), _c("complexity").cast("string"), F.lit("_"), F.replace("name", F.lit(" "), F.lit("-")))).alias("p")).select("qualified_name", "p.type", "p.ticket", "p.description")),
    "fn_format_bytes": _q(lambda g: g.files.select("path", format_bytes(_c("lines_of_code") * 97).alias("size"))),
    "fn_escape_xml": _q(lambda g: g.table("pages").select("page_id", escape_xml(_c("html")).alias("x"))),
    "html_links": _q(lambda g: g.table("pages").select("page_id", F.posexplode(links_of(_c("html"))).alias("n", "href"))),
    "search_entities": _q(lambda g: search_entities(g.symbols, "Widget").select("qualified_name", "name")),
    "keyword_search_graph": _q(lambda g: keyword_search(g.symbols, ["ring", "red", "bolt"], 15).select("qualified_name", "number")),
    "knowledge_search": _q(lambda g: turns_search(g.turns, "part:11").select("session_id", "turn_number")),
    "knowledge_list": _q(lambda g: g.turns.filter("concern = 'assistant'").orderBy(F.desc("timestamp"), "session_id").limit(20).select("session_id", "turn_number")),
    "knowledge_show": _q(lambda g: g.turns.filter("session_id = '3'").orderBy("turn_number").select("turn_number", "concern", "summary")),
    "knowledge_by_symbols": _q(lambda g: turns_by_symbols(g.turns, ["part:5", "part:18"], "0").select("session_id", "turn_number")),
}

QUERIES |= {
    "knowledge_by_files": _q(lambda g: turns_by_files(g.turns.withColumn("files_touched", F.array(F.concat(F.lit("Brand#"), (_c("turn_number") * 7 % 25 + 1).cast("string"), F.lit("/SMALL")))), ["Brand#8/SMALL", "Brand#15/SMALL"], "3").select("session_id", "turn_number")),
    "fn_format_duration": _q(lambda g: g.symbols.select("qualified_name", format_duration(_c("complexity") * _c("start_line") * 37).alias("t"))),
    "fn_format_percent": _q(lambda g: g.symbols.select("qualified_name", format_percent(_c("complexity"), _c("start_line") % 7 * 13).alias("p"))),
    "fn_cdata": _q(lambda g: g.documents.select("doc_id", cdata(F.concat("text", F.lit("]]>x"))).alias("x"))),
    "fn_diff_stats": _q(lambda g: g.modifies.select("sha", "path", diff_stats(F.concat(F.lit("--- a/x\n+++ b/"), "path", F.lit("\n"), F.repeat(F.lit("+n\n"), (_c("insertions") % 9).cast("int")), F.repeat(F.lit("-o\n"), (_c("deletions") % 5).cast("int")))).alias("d")).select("sha", "path", "d.added", "d.removed", "d.files")),
}

_EXT = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " ELSE {} END"
ORACLES = {k: twin(v) for k, v in {
    "fn_paths": "SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, '.md' AS ext, 'markdown' AS language FROM docs",
    "fn_normalize_path": "SELECT path, 'a/' || split_part(path, '/', 1) || '/x' AS normal FROM files",
    "detect_language": "SELECT qualified_name, ['python', 'typescript', 'rust', 'unknown'][complexity % 4 + 1] AS language FROM symbols",
    "ext_to_language": "SELECT path, lower(split_part(path, '/', 2)) AS language FROM files",
    "fn_hashes": """, h(q, i, v) AS (SELECT qualified_name, 0, 0::BIGINT FROM symbols UNION ALL SELECT q, i + 1, ((((v * 31 + ascii(q[i + 1])) + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 FROM h WHERE i < length(q))
      SELECT qualified_name, sha256(signature)[1:16] AS h16, sha256(signature)[1:32] AS h32, abs(v) AS id FROM symbols JOIN h ON q = qualified_name AND i = length(q)""",
    "fn_fold_space": "SELECT doc_id, regexp_replace(trim(text, ' '), '\\s+', ' ', 'g') AS t FROM docs",
    "fn_slug": "SELECT qualified_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(' ' || docstring || ' -- X_y'), '[^a-z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM symbols",
    "fn_tokens": f"SELECT qualified_name, array_to_string(list_transform(list_sort(list_distinct(list_transform(t, lambda x: list_position(t, x)))), lambda i: t[i]), ',') AS tokens FROM (SELECT qualified_name, list_filter(regexp_split_to_array(trim(regexp_replace(lower(docstring || ' ' || qualified_name || ' the 123 Of'), '[^a-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({STOP_WORDS!r}, w) AND NOT regexp_full_match(w, '[0-9]+')) AS t FROM symbols)",
    "fn_counts": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS words, ceil(length(text) / 4)::BIGINT AS tokens, 1 + len(regexp_extract_all(text, '(?m)^##\\s+'))::INT AS sections FROM docs",
    "fn_first_sentence": "SELECT qualified_name, name || '.' AS s FROM symbols",
    "fn_truncate": "SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS t FROM docs",
    "fn_version": "SELECT qualified_name, (complexity % 7) || '.0.' || (complexity % 3) AS v FROM symbols",
    "fn_normalize_url": "SELECT page_id, lower(regexp_replace(url, '^[a-z]+://', '')) AS u, sha256(lower(regexp_replace(regexp_replace(url, '[.]git$', ''), '^[a-z]+://', '')))[1:16] AS id FROM pages",
    "fn_chunk_id": "SELECT file || ':' || start_line || ':' || end_line AS id, file, start_line AS start, end_line AS \"end\" FROM symbols",
    "commit_grammar": "SELECT sha, split_part(message, '(', 1) AS type, 'core' AS scope, 'change ' || sha AS description FROM commits",
    "branch_grammar": "SELECT qualified_name, 'feat' AS type, 'ABC-' || complexity AS ticket, name AS description FROM symbols",
    "fn_format_bytes": "SELECT path, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.1f MB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT path, lines_of_code * 97 AS n FROM files)",
    "fn_escape_xml": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS x FROM pages",
    "html_links": "SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS n, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)",
    "search_entities": "SELECT qualified_name, name FROM symbols WHERE contains(lower(name), 'widget') ORDER BY lower(name) <> 'widget', qualified_name LIMIT 10",
    "keyword_search_graph": "SELECT qualified_name, min(i)::INT AS number FROM (SELECT qualified_name, i, row_number() OVER (PARTITION BY i ORDER BY qualified_name) AS r FROM symbols, (VALUES (0, 'ring'), (1, 'red'), (2, 'bolt')) k(i, k) WHERE contains(lower(name), k)) WHERE r <= 5 GROUP BY 1",
    "knowledge_search": "SELECT session_id, turn_number FROM turns WHERE contains(lower(summary), 'part:11') OR len(list_filter(symbols_referenced, lambda x: contains(lower(x), 'part:11'))) > 0 ORDER BY timestamp DESC, session_id LIMIT 10",
    "knowledge_list": "SELECT session_id, turn_number FROM turns WHERE concern = 'assistant' ORDER BY timestamp DESC, session_id LIMIT 20",
    "knowledge_show": "SELECT turn_number, concern, summary FROM turns WHERE session_id = '3'",
    "knowledge_by_files": "SELECT session_id, turn_number FROM turns WHERE turn_number * 7 % 25 + 1 IN (8, 15) AND session_id <> '3' ORDER BY timestamp DESC, session_id LIMIT 10",
    "fn_format_duration": "SELECT qualified_name, CASE WHEN m < 1000 THEN m || 'ms' WHEN m < 60000 THEN printf('%.1fs', m / 1000) ELSE (m // 60000) || 'm ' || (m // 1000 % 60) || 's' END AS t FROM (SELECT qualified_name, complexity * start_line * 37 AS m FROM symbols)",
    "fn_format_percent": "SELECT qualified_name, CASE WHEN w = 0 THEN '0%' ELSE round(100.0::DOUBLE * complexity / w)::BIGINT || '%' END AS p FROM (SELECT *, start_line % 7 * 13 AS w FROM symbols)",
    "fn_cdata": "SELECT doc_id, '<![CDATA[' || replace(text || ']]>x', ']]>', ']]]]><![CDATA[>') || ']]>' AS x FROM docs",
    "fn_diff_stats": "SELECT sha, path, (insertions % 9)::INT AS added, (deletions % 5)::INT AS removed, 1::INT AS files FROM modifies",
    "knowledge_by_symbols": "SELECT session_id, turn_number FROM turns WHERE list_has_any(symbols_referenced, ['part:5', 'part:18']) AND session_id <> '0' ORDER BY timestamp DESC, session_id LIMIT 10",
}.items()}
