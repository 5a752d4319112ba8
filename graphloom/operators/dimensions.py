"""The nine dimensions of the context manifold: what each knows, as one line of text or more per dimension.

Each updater is a small aggregate over its own tables, so one plan computes all nine side by side; the text is
cut to its budget by `models.assemble`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import branch_parts
from graphloom.operators.aggregates import hot_files, hot_spots, union
from graphloom.operators.windows import top_per_key
from graphloom.plans.model import Graph, twin

# How many files, symbols, callers, commits and names a dimension takes.
HUBS, CHANGED_FILES, SYMBOLS_PER_FILE, CALLERS_PER_SYMBOL, LISTED, SHOWN = 5, 10, 20, 5, 20, 10
#: Types of conventional commits.
INTENT_TYPES = ["feat", "fix", "refactor", "docs", "test", "chore", "style", "perf", "build", "ci", "revert"]
COMMIT = rf"^({'|'.join(INTENT_TYPES)})(?:\(([^)]+)\))?!?:\s*(.+)"


def _one(df: DataFrame, dimension: str, text: Column) -> DataFrame:
    return df.select(F.lit(dimension).alias("dimension"), text.alias("text"))


def _listed(df: DataFrame, order: list[str], text: str, most: int, separator: str) -> DataFrame:
    """One row: the first `most` texts in order (columns that sort ascending), joined; '' if there is none."""
    few = df.orderBy(*order).limit(most).select(*order, F.col(text).alias("__t"))
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__t"))), lambda x: x["__t"]), separator).alias("list"), F.count("*").alias("n"))


def _titled(title: str, listed: Column, n: Column) -> Column:
    """A title before a list, nothing for an empty one."""
    return F.when(n > 0, F.concat(F.lit(title), listed)).otherwise("")


def structural(files: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Counts of the graph and its most-called symbols."""
    hubs = _listed(hot_spots(symbols, calls, None, 0, HUBS).withColumn("__o", -F.col("incoming")), ["__o", "qualified_name"], "name", HUBS, ", ")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = n(files, "files").join(n(symbols, "symbols")).join(n(edges, "edges")).join(hubs)
    head = F.format_string("Graph: %d files, %d symbols, %d relationships", "files", "symbols", "edges")
    return _one(row, "structural", F.concat(head, _titled("\nHub symbols: ", F.col("list"), F.col("n"))))


def semantic(vectors: DataFrame, model: str) -> DataFrame:
    return _one(vectors.agg(F.count("*").alias("n")), "semantic", F.format_string("Semantic index: %d code chunks (%s)", "n", F.lit(model)))


def temporal(commits: DataFrame, modifies: DataFrame) -> DataFrame:
    """Files most often changed by the ten newest commits, and the newest commits."""
    hot = hot_files(commits, modifies).withColumn("line", F.format_string("  %s (%d changes)", "path", "changes")).withColumn("__o", -F.col("changes"))
    newest = commits.withColumn("line", F.concat(F.lit("  "), F.substring("sha", 1, 7), F.lit(" "), F.substring("message", 1, 80))).withColumn("__o", -F.col("timestamp"))
    rename = lambda df, x: df.select(F.col("list").alias(f"{x}_list"), F.col("n").alias(f"{x}_n"))
    row = rename(_listed(hot, ["__o", "path"], "line", 5, "\n"), "hot").join(rename(_listed(newest, ["__o", "sha"], "line", 5, "\n"), "new"))
    parts = [F.when(F.col("hot_n") > 0, F.concat(F.lit("Hot files (most changed recently):\n"), "hot_list")), F.when(F.col("new_n") > 0, F.concat(F.lit("Recent commits:\n"), "new_list"))]
    return _one(row, "temporal", F.concat_ws("\n", *parts))


def requirements_state(requirements: DataFrame, implementations: DataFrame) -> DataFrame:
    row = requirements.agg(F.count_distinct("prd_id").alias("prds"), F.count("*").alias("chunks")).join(implementations.agg(F.count("*").alias("links")))
    return _one(row, "requirements", F.when(F.col("prds") == 0, "").otherwise(F.format_string("PRDs: %d documents, %d requirements, %d linked implementations", "prds", "chunks", "links")))


def summary_state(summaries: DataFrame) -> DataFrame:
    return _one(summaries.agg(F.count("*").alias("n")), "summary", F.when(F.col("n") == 0, "").otherwise(F.format_string("Cached summaries: %d entries", "n")))


def navigational(sessions: DataFrame) -> DataFrame:
    """sessions: session_id, level, target (null at the top)."""
    line = F.concat(F.lit("  Session "), "session_id", F.lit(": "), "level", F.coalesce(F.concat(F.lit(" → "), F.col("target")), F.lit("")))
    row = _listed(sessions.withColumn("line", line), ["session_id"], "line", LISTED, "\n")
    return _one(row, "navigational", _titled("Active navigation:\n", F.col("list"), F.col("n")))


def session_state(status: DataFrame, symbols: DataFrame, branch: str) -> DataFrame:
    """The working tree (path, state: modified, staged or untracked), and symbols of the first modified files."""
    names = lambda state: _listed(status.filter(F.col("state") == state), ["path"], "path", SHOWN, ", ").select(F.col("list").alias(f"{state}_list"), F.col("n").alias(f"{state}_n"))
    changed = status.filter("state = 'modified'").orderBy("path").limit(CHANGED_FILES).select(F.col("path").alias("file"))
    inside = top_per_key(symbols.join(changed, "file", "left_semi"), "file", ["qualified_name"], 10)
    row = names("modified").join(names("staged")).join(_listed(inside, ["file", "rank"], "name", SHOWN, ", "))
    text = F.concat(F.lit(f"Branch: {branch}"), _titled("\nModified: ", F.col("modified_list"), F.col("modified_n")), _titled("\nStaged: ", F.col("staged_list"), F.col("staged_n")), _titled("\nAffected symbols: ", F.col("list"), F.col("n")))
    return _one(row, "session", text)


def intent(commits: DataFrame, branch: str) -> DataFrame:
    """What the branch's name and the newest commits say they are for."""
    newest = commits.orderBy(F.desc("timestamp"), "sha").limit(10).filter(F.col("message").rlike(COMMIT)).withColumn("__o", -F.col("timestamp"))
    part = lambda i: F.regexp_extract("message", COMMIT, i)
    line = F.concat(F.lit("  "), part(1), F.when(part(2) != "", F.concat(F.lit("("), part(2), F.lit(")"))).otherwise(""), F.lit(": "), part(3))
    row = _listed(newest.withColumn("line", line), ["__o", "sha"], "line", 5, "\n").withColumn("b", branch_parts(F.lit(branch)))
    own = F.when(F.col("b.type") != "", F.concat(F.lit("Branch intent: "), F.col("b.type"), F.lit(" — "), F.col("b.description")))
    return _one(row, "intent", F.concat_ws("\n", own, F.when(F.col("n") > 0, F.concat(F.lit("Recent intents:\n"), "list"))))


def impact_state(symbols: DataFrame, calls: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: changed symbols and the callers that they affect, both in order, and the risk.

    changed: path.  The first files, symbols of each and callers of each symbol count; more than 10 callers are a high
    risk, more than 3 a medium one."""
    files = changed.select(F.col("path").alias("file")).distinct().orderBy("file").limit(CHANGED_FILES)
    inside = top_per_key(symbols.join(files, "file", "left_semi"), "file", ["qualified_name"], SYMBOLS_PER_FILE).select("file", "qualified_name", "rank")
    callers = top_per_key(calls.join(inside.select(F.col("qualified_name").alias("dst")), "dst", "left_semi"), "dst", ["src"], CALLERS_PER_SYMBOL).select(F.col("src").alias("caller")).distinct()
    n = callers.agg(F.count("*").alias("callers"))
    row = _listed(inside, ["file", "rank"], "qualified_name", LISTED, ", ").select(F.col("list").alias("changed_symbols"), F.col("n").alias("changed"))
    row = row.join(_listed(callers, ["caller"], "caller", LISTED, ", ").select(F.col("list").alias("affected_callers"))).join(n)
    return row.withColumn("risk", F.when(F.col("callers") > 10, "high").when(F.col("callers") > 3, "medium").otherwise("low"))


def impact_text(state: DataFrame) -> DataFrame:
    first = lambda c: F.array_join(F.slice(F.split(c, ", "), 1, SHOWN), ", ")
    text = F.concat(F.lit("Risk level: "), "risk", F.lit("\nChanged symbols: "), first("changed_symbols"), F.when(F.col("callers") > 0, F.concat(F.lit("\nAffected callers: "), first("affected_callers"))).otherwise(""))
    return _one(state, "impact", F.when(F.col("changed") == 0, "").otherwise(text))


BRANCH = "feat/ABC-12_wider-search"


def working_tree(g: Graph) -> DataFrame:
    """A working tree over the derived files: those of one brand are modified, of another staged."""
    state = F.when(F.col("path").startswith("Brand#3/"), "modified").when(F.col("path").startswith("Brand#4/"), "staged")
    return g.files.select("path", state.alias("state")).filter("state is not null")


def _changed(g: Graph) -> DataFrame:
    return working_tree(g).filter("state = 'modified'").select("path")


def _sessions(g: Graph) -> DataFrame:
    last = g.turns.groupBy("session_id").agg(F.max("timestamp").alias("last"), F.max(F.struct("timestamp", "concern")).alias("x")).orderBy(F.desc("last"), "session_id").limit(3)
    return last.select("session_id", F.when(F.col("x.concern") == "user", "repo").otherwise("symbol").alias("level"), F.when(F.col("x.concern") != "user", F.lit("part:5")).alias("target"))


def all_dimensions(g: Graph) -> DataFrame:
    """The nine dimensions' texts."""
    edges = g.calls.select("src").unionByName(g.imports.select("src"))
    return union([
        structural(g.files, g.symbols, edges, g.calls), semantic(g.vectors, "demo"), temporal(g.commits, g.modifies), requirements_state(g.requirements, g.implementations), summary_state(g.symbols), navigational(_sessions(g)),
        session_state(working_tree(g), g.symbols, BRANCH), intent(g.commits, BRANCH), impact_text(impact_state(g.symbols, g.calls, _changed(g))),
    ])


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir).fixed())


QUERIES = {
    "dim_updates": _q(all_dimensions),
    "impact_dim": _q(lambda g: impact_state(g.symbols, g.calls, _changed(g))),
}

_IM = """, ins AS (SELECT file, qualified_name, row_number() OVER (PARTITION BY file ORDER BY qualified_name) AS r FROM symbols WHERE file IN (SELECT path FROM files WHERE starts_with(path, 'Brand#3/') ORDER BY path LIMIT 10) QUALIFY r <= 20),
  cal AS (SELECT DISTINCT src FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM calls WHERE dst IN (SELECT qualified_name FROM ins)) WHERE r <= 5),
  im AS (SELECT (SELECT coalesce(string_agg(qualified_name, ', ' ORDER BY file, r), '') FROM (SELECT * FROM ins ORDER BY file, r LIMIT 20)) AS changed_symbols, (SELECT least(count(*), 20) FROM ins) AS changed,
    (SELECT coalesce(string_agg(src, ', ' ORDER BY src), '') FROM (SELECT * FROM cal ORDER BY src LIMIT 20)) AS affected_callers, (SELECT count(*) FROM cal) AS callers, CASE WHEN (SELECT count(*) FROM cal) > 10 THEN 'high' WHEN (SELECT count(*) FROM cal) > 3 THEN 'medium' ELSE 'low' END AS risk)"""
_DIM = _IM + """, nw AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, sha) AS r FROM commits),
  hf AS (SELECT path, count(*) AS n FROM modifies WHERE sha IN (SELECT sha FROM nw WHERE r <= 10) GROUP BY path ORDER BY n DESC, path LIMIT 5),
  ses AS (SELECT session_id, arg_max(concern, (timestamp, concern)) AS c FROM turns GROUP BY 1 ORDER BY max(timestamp) DESC, session_id LIMIT 3),
  md AS (SELECT path FROM files WHERE starts_with(path, 'Brand#3/') ORDER BY path LIMIT 10), sd AS (SELECT path FROM files WHERE starts_with(path, 'Brand#4/') ORDER BY path LIMIT 10)
SELECT 'structural' AS dimension, 'Graph: ' || (SELECT count(*) FROM files) || ' files, ' || (SELECT count(*) FROM symbols) || ' symbols, ' || ((SELECT count(*) FROM calls) + (SELECT count(*) FROM imports)) || ' relationships' || chr(10) || 'Hub symbols: ' || (SELECT string_agg(name, ', ' ORDER BY n DESC, q) FROM (SELECT dst AS q, name, count(*) AS n FROM calls JOIN symbols ON qualified_name = dst GROUP BY ALL ORDER BY n DESC, q LIMIT 5)) AS text
UNION ALL SELECT 'semantic', 'Semantic index: ' || count(*) || ' code chunks (demo)' FROM vectors
UNION ALL SELECT 'temporal', 'Hot files (most changed recently):' || chr(10) || (SELECT string_agg('  ' || path || ' (' || n || ' changes)', chr(10) ORDER BY n DESC, path) FROM hf) || chr(10) || 'Recent commits:' || chr(10) || (SELECT string_agg('  ' || sha[1:7] || ' ' || message[1:80], chr(10) ORDER BY r) FROM nw WHERE r <= 5)
UNION ALL SELECT 'requirements', 'PRDs: ' || count(DISTINCT prd_id) || ' documents, ' || count(*) || ' requirements, ' || (SELECT count(*) FROM implementations) || ' linked implementations' FROM requirements
UNION ALL SELECT 'summary', 'Cached summaries: ' || count(*) || ' entries' FROM symbols
UNION ALL SELECT 'navigational', 'Active navigation:' || chr(10) || string_agg('  Session ' || session_id || ': ' || CASE WHEN c = 'user' THEN 'repo' ELSE 'symbol → part:5' END, chr(10) ORDER BY session_id) FROM ses
UNION ALL SELECT 'session', 'Branch: feat/ABC-12_wider-search' || coalesce(chr(10) || 'Modified: ' || (SELECT string_agg(path, ', ' ORDER BY path) FROM md), '') || coalesce(chr(10) || 'Staged: ' || (SELECT string_agg(path, ', ' ORDER BY path) FROM sd), '')
  || coalesce(chr(10) || 'Affected symbols: ' || (SELECT string_agg(name, ', ' ORDER BY file, r) FROM (SELECT file, name, r FROM (SELECT file, name, row_number() OVER (PARTITION BY file ORDER BY qualified_name) AS r FROM symbols WHERE file IN (SELECT path FROM md)) WHERE r <= 10 ORDER BY file, r LIMIT 10)), '')
UNION ALL SELECT 'intent', 'Branch intent: feat — wider search' || chr(10) || 'Recent intents:' || chr(10) || string_agg('  ' || split_part(message, '(', 1) || '(core): change ' || sha, chr(10) ORDER BY r) FROM nw WHERE r <= 5
UNION ALL SELECT 'impact', CASE WHEN changed = 0 THEN '' ELSE 'Risk level: ' || risk || chr(10) || 'Changed symbols: ' || array_to_string(string_split(changed_symbols, ', ')[1:10], ', ') || CASE WHEN callers > 0 THEN chr(10) || 'Affected callers: ' || array_to_string(string_split(affected_callers, ', ')[1:10], ', ') ELSE '' END END FROM im"""
ORACLES = {"dim_updates": twin("", _DIM), "impact_dim": twin(" SELECT * FROM im", _IM)}
