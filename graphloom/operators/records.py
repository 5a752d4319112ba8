"""All node labels and edge types of the graph as keyed tables, authored records, states kept between runs, caches.

Tables of several labels are one table each of (label, key, value) or (type, src, dst, value), so one plan upserts them
all; a label's own columns travel as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.aggregates import union
from graphloom.operators.lookup import glob_match
from graphloom.operators.upsert import upsert
from graphloom.plans.model import Graph, twin
from graphloom.staging import shared_path

#: Labels of nodes and their keys; types of edges and the labels of their ends.
NODE_KEYS = {"File": ["path"], "Symbol": ["qualified_name"], "Commit": ["sha"], "Document": ["path"], "SessionKnowledge": ["session_id", "turn_number"], "Requirement": ["id"]}
EDGE_ENDS = {
    "IMPORTS": ("File", "File"), "DEFINES": ("File", "Symbol"), "CALLS": ("Symbol", "Symbol"), "INHERITS": ("Symbol", "Symbol"), "MODIFIES": ("Commit", "File"), "TOUCHES": ("Commit", "Symbol"), "DESCRIBES": ("Document", "File"),
    "REFERENCES_DOC": ("Document", "Document"), "ABOUT": ("SessionKnowledge", "Symbol"), "FOLLOWS": ("SessionKnowledge", "SessionKnowledge"), "IMPLEMENTS": ("Symbol", "Requirement"), "DEPENDS_ON": ("Requirement", "Requirement"),
}
KEY_SEPARATOR = "#"


def node_table(label: str, rows: DataFrame) -> DataFrame:
    """Rows of one label as label, key and their other columns as JSON."""
    keys = NODE_KEYS[label]
    rest = [c for c in rows.columns if c not in keys]
    key = F.concat_ws(KEY_SEPARATOR, *[F.col(k).cast("string") for k in keys])
    return rows.select(F.lit(label).alias("label"), key.alias("key"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("value"))


def edge_table(kind: str, rows: DataFrame) -> DataFrame:
    """Rows (src, dst, ...) of one type as type, src, dst and their other columns as JSON."""
    rest = [c for c in rows.columns if c not in ("src", "dst")]
    return rows.select(F.lit(kind).alias("type"), "src", "dst", (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("value"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of any labels: a new one replaces that of its label and key."""
    return upsert(old, new, ["label", "key"])


def upsert_typed_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of any types: those whose ends are no nodes of the type's labels are dropped, the others replace that of
    their type and ends."""
    ends = union([new.filter(F.col("type") == k).withColumn("src_label", F.lit(a)).withColumn("dst_label", F.lit(b)) for k, (a, b) in EDGE_ENDS.items()])
    keys = nodes.select("label", "key")
    ok = ends.join(keys.toDF("src_label", "src"), ["src_label", "src"], "left_semi").join(keys.toDF("dst_label", "dst"), ["dst_label", "dst"], "left_semi")
    return upsert(old, ok.select(*old.columns), ["type", "src", "dst"])


def delete_node(nodes: DataFrame, edges: DataFrame, label: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without one, and edges without those that it is an end of."""
    src = [k for k, (a, _) in EDGE_ENDS.items() if a == label]
    dst = [k for k, (_, b) in EDGE_ENDS.items() if b == label]
    touches = (F.col("type").isin(src) & (F.col("src") == key)) | (F.col("type").isin(dst) & (F.col("dst") == key))
    return nodes.filter(~((F.col("label") == label) & (F.col("key") == key))), edges.filter(~touches)


def clear(table: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return table.limit(0)


def document_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Authored metadata by path: the front matter's type, else the inferred one, else unknown; the status, else active;
    the first time of creation stays.  old: path, type, status, created, updated; new: path, type, inferred, status, at."""
    n = new.select("path", F.coalesce("type", "inferred", F.lit("unknown")).alias("n_type"), F.coalesce("status", F.lit("active")).alias("n_status"), "at")
    both = old.join(n, "path", "full_outer")
    return both.select("path", F.coalesce("n_type", "type").alias("type"), F.coalesce("n_status", "status").alias("status"), F.coalesce("created", "at").alias("created"), F.coalesce("at", "updated").alias("updated"))


def add_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations are only ever added; an id is type:path:kind:time.  new: path, kind, content, line, at."""
    made = new.withColumn("id", F.concat_ws(":", F.lit("annotation"), "path", "kind", F.col("at").cast("string")))
    return old.unionByName(made.select(*old.columns))


def design_merge(symbols: DataFrame, modules: DataFrame, types: DataFrame, functions: DataFrame) -> DataFrame:
    """Planned types and functions merged into symbols by name.

    modules: module, path; types: name, kind, module; functions: name, module.  A type goes to its module's types.ts, a
    function to a file of its own; without a module of that name to src/<module, or types or functions>/...  A symbol of
    that name is set to planned, others stay."""
    home = modules.select(F.col("module").alias("m"), F.col("path").alias("m_path"))
    placed = lambda df, none: df.join(home, F.col("module") == F.col("m"), "left").withColumn("folder", F.coalesce("m_path", F.concat(F.lit("src/"), F.coalesce("module", F.lit(none)))))
    t = placed(types, "types").select("name", "kind", F.concat("folder", F.lit("/types.ts")).alias("file"), F.lit("planned").alias("status"))
    f = placed(functions, "functions").select("name", F.lit("function").alias("kind"), F.concat("folder", F.lit("/"), "name", F.lit(".ts")).alias("file"), F.lit("planned").alias("status"))
    return upsert(symbols.select("name", "kind", "file", "status"), t.unionByName(f), ["name"])


def doc_pattern(path: str, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is a document's: in no excluded pattern, and in an included one."""
    out, kept = F.lit(False), F.lit(True)
    for g in include:
        out = out | glob_match(path, g)
    for g in exclude:
        kept = kept & ~glob_match(path, g)
    return kept & out


def git_status(lines: DataFrame) -> DataFrame:
    """Lines of a short status (value: two letters, a blank, a path or old -> new) to path, origin, and flags: staged,
    modified, added, deleted, renamed, untracked."""
    x, y = F.substring("value", 1, 1), F.substring("value", 2, 1)
    rest = F.expr("substring(value, 4)")
    parts = F.split(rest, " -> ")
    row = lines.select(x.alias("x"), y.alias("y"), F.element_at(parts, -1).alias("path"), F.when(F.size(parts) > 1, parts[0]).alias("origin"))
    either = lambda c: (F.col("x") == c) | (F.col("y") == c)
    return row.select("path", "origin", (~F.col("x").isin(" ", "?")).alias("staged"), either("M").alias("modified"), either("A").alias("added"), either("D").alias("deleted"), either("R").alias("renamed"), (F.col("x") == "?").alias("untracked"))


def git_files(lines: DataFrame) -> DataFrame:
    """Tracked paths of a listing (mode, hash, stage, tab, path), each once."""
    return lines.select(F.regexp_extract("value", r"\t(.*)$", 1).alias("path")).filter("path != ''").distinct()


def relevance_sort(items: DataFrame, limit: int) -> DataFrame:
    """Items by descending relevance, of equal ones by name."""
    return items.orderBy(F.desc("relevance"), "qualified_name").limit(limit)


def unified_context(requirements: DataFrame, implementations: DataFrame, symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Requirements with the symbols that implement them and the documents of those symbols' files, in one row each.

    docs: file, path."""
    code = implementations.join(symbols.select(F.col("qualified_name").alias("src"), "file"), "src").select(F.col("dst").alias("id"), "src", "file")
    by_code = code.groupBy("id").agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files"))
    by_doc = code.select("id", "file").distinct().join(docs, "file").groupBy("id").agg(F.count_distinct("path").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return requirements.select("id", "priority").join(by_code, "id", "left").join(by_doc, "id", "left").select("id", "priority", zero("symbols"), zero("files"), zero("documents"))


def save_state(state: DataFrame, path: str) -> None:
    """A state beside the old one; readers of the old one go on until they ask anew."""
    state.write.mode("overwrite").parquet(path)


def sync_errors(log: DataFrame, report: DataFrame, most_bytes: int = 100 * 1024, keep_bytes: int = 80 * 1024) -> DataFrame:
    """The rolling error log after one more report: its newest entries, if it grew beyond `most_bytes` those of the last
    `keep_bytes`.  Both: at, seq, entry."""
    rows = log.unionByName(report)
    size = F.octet_length("entry")
    total = rows.agg(F.sum(size).alias("total"))
    # Bytes per time first, so that no task holds the whole log.
    times = rows.groupBy("at").agg(F.sum(size).alias("b")).withColumn("after", F.coalesce(F.sum("b").over(Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("at", "after")
    inside = F.sum(size).over(Window.partitionBy("at").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.withColumn("inside", inside).join(times, "at").join(total).filter((F.col("total") <= most_bytes) | (F.col("after") + F.col("inside") <= keep_bytes))
    return kept.select("at", "seq", "entry")


def cache_hits(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Each request with whether a cache whose entries live `ttl_seconds` from their last use has it.

    requests: namespace, key, at (seconds), id.  An entry's age is counted anew at each use, so only the one before
    matters; entries are never pushed out for room here."""
    before = F.lag("at").over(Window.partitionBy("namespace", "key").orderBy("at", "id"))
    return requests.withColumn("hit", F.coalesce(F.col("at") - before <= ttl_seconds, F.lit(False)))


def _nodes(g: Graph) -> DataFrame:
    return union([
        node_table("File", g.files.select("path", "language")), node_table("Symbol", g.symbols.select("qualified_name", "name")), node_table("Commit", g.commits.select("sha", "author")), node_table("Document", g.documents.select("path", "type")),
        node_table("SessionKnowledge", g.turns.select("session_id", "turn_number", "concern")), node_table("Requirement", g.requirements.select("id", "priority")),
    ])


def _new_nodes(g: Graph) -> DataFrame:
    """One existing and one new node of each label."""
    rows = [("File", "Brand#3/SMALL"), ("File", "new/file"), ("Symbol", "part:5"), ("Symbol", "part:x"), ("Commit", "7"), ("Commit", "x"), ("Document", "docs/x.md"), ("SessionKnowledge", "0#0"), ("SessionKnowledge", "x#1"), ("Requirement", "NATION_2"), ("Requirement", "x")]
    return g.spark.createDataFrame([(a, b, '{"new":true}') for a, b in rows], "label string, key string, value string")


def _edges(g: Graph) -> DataFrame:
    turn = F.concat_ws(KEY_SEPARATOR, "session_id", F.col("turn_number").cast("string"))
    about = g.turns.select(turn.alias("src"), F.explode("symbols_referenced").alias("dst"))
    follows = g.turns.filter("turn_number > 0").select(turn.alias("src"), F.concat_ws(KEY_SEPARATOR, "session_id", (F.col("turn_number") - 1).cast("string")).alias("dst"))
    needs = g.requirements.select(F.col("id").alias("src"), F.concat(F.lit("NATION_"), ((F.col("number") * 3 + 1) % 40).cast("string")).alias("dst"))
    touches = g.table("lineitem").select(F.col("l_orderkey").cast("string").alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    tables = {
        "IMPORTS": g.imports, "DEFINES": g.defines, "CALLS": g.calls, "INHERITS": g.inherits, "MODIFIES": g.modifies.select(F.col("sha").alias("src"), F.col("path").alias("dst"), "insertions"), "TOUCHES": touches, "DESCRIBES": g.describes,
        "REFERENCES_DOC": g.references, "ABOUT": about, "FOLLOWS": follows, "IMPLEMENTS": g.implementations, "DEPENDS_ON": needs,
    }
    return union([edge_table(k, t) for k, t in tables.items()])


def _merged_edges(g: Graph) -> DataFrame:
    none = g.spark.createDataFrame([], "type string, src string, dst string, value string")
    return upsert_typed_edges(none, _edges(g.fixed()), _nodes(g))


def _design(g: Graph) -> DataFrame:
    s = g.symbols.groupBy("name").agg(F.min("kind").alias("kind"), F.min("file").alias("file")).withColumn("status", F.lit("active"))
    make = g.spark.createDataFrame
    return design_merge(s, make([("core", "src/core")], "module string, path string"), make([("red widget", "class", "core"), ("Plan", "interface", "other"), ("Lone", "class", None)], "name string, kind string, module string"), make([("run", "core"), ("go", None)], "name string, module string"))


def _status(g: Graph) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, [" M", "M ", "A ", " D", "??", "R ", "MM"])), (F.col("updated_at") % 7 + 1).cast("int"))
    return g.files.select(F.concat(code, F.lit(" "), F.when(code == "R ", F.lit("old/x -> ")).otherwise(""), "path").alias("value"))


def _requests(g: Graph) -> DataFrame:
    return g.table("events").select(F.col("event_type").alias("namespace"), (F.col("user_id") % 10).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))


def _hit_rates(g: Graph, minutes: int) -> DataFrame:
    return cache_hits(_requests(g), minutes * 60).groupBy("namespace").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def _errors(g: Graph) -> DataFrame:
    rows = g.table("events").filter("event_type = 'error'").select(F.to_date(F.col("ts").cast("timestamp")).cast("string").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("[parse] "), F.col("user_id").cast("string"), F.lit(": "), F.coalesce("props", F.lit(""))).alias("entry"))
    return sync_errors(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), 2000, 1500)


def _bandit_saved(g: Graph) -> DataFrame:
    """The bandit's state written and read back."""
    from graphloom.operators.models import _update

    where = shared_path(g.spark, "bandit")
    save_state(_update(g), where)
    return g.spark.read.parquet(where)


def _meta(g: Graph) -> DataFrame:
    d = g.documents
    old = d.filter("doc_id % 2 = 0").select("path", "type", F.lit("active").alias("status"), F.lit(1).alias("created"), F.lit(1).alias("updated"))
    new = d.filter("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 5 == 0, "adr").alias("type"), F.when(F.col("doc_id") % 7 != 0, "guide").alias("inferred"), F.when(F.col("doc_id") % 4 == 0, "draft").alias("status"), F.lit(9).alias("at"))
    return document_meta(old, new)


def _annotations(g: Graph) -> DataFrame:
    new = g.documents.filter("doc_id % 10 = 0").select("path", F.lit("note").alias("kind"), F.col("lang").alias("content"), F.lit(3).alias("line"), F.col("doc_id").alias("at"))
    return add_annotations(g.spark.createDataFrame([("annotation:a:note:1", "a", "note", "kept", 1)], "id string, path string, kind string, content string, line int"), new)


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


QUERIES = {
    "upsert_nodes": _q(lambda g: upsert_nodes(_nodes(g), _new_nodes(g))),
    "upsert_edges": _q(lambda g: _merged_edges(g).select("type", "src", "dst")),
    "delete_document": _q(lambda g: delete_node(_nodes(g), union([edge_table("DESCRIBES", g.describes), edge_table("REFERENCES_DOC", g.references)]), "Document", "docs/src5/5.md")[1].select("type", "src", "dst")),
    "clear": _q(lambda g: clear(_nodes(g)).groupBy("label").agg(F.count("*").alias("n"))),
    "document_meta": _q(_meta),
    "annotations": _q(_annotations),
    "design_merge": _q(_design),
    "doc_pattern": _q(lambda g: g.documents.filter(doc_pattern("path", ["docs/src1*/*.md", "docs/src5/**"], ["**/1*.md", "docs/src12/*"])).select("path")),
    "git_status": _q(lambda g: git_status(_status(g))),
    "git_files": _q(lambda g: git_files(g.documents.select(F.concat(F.lit("100644 "), "content_hash", F.lit(" 0\t"), "path").alias("value")))),
    "relevance_sort": _q(lambda g: relevance_sort(g.symbols.select("qualified_name", (F.col("complexity") % 10 / 10).alias("relevance")), 40)),
    "unified_context": _q(lambda g: unified_context(g.requirements, g.implementations, g.symbols, g.describes.select(F.col("dst").alias("file"), F.col("src").alias("path")))),
    "ttl_cache": _q(lambda g: _hit_rates(g, 5 * 60)),
    "context_cache": _q(lambda g: _hit_rates(g, 24 * 60)),
    "state_tables": _q(_errors),
    "bandit_persist": _q(_bandit_saved),
}

_ND = """, nd AS (SELECT 'File' AS label, path AS key, '{"language":"' || language || '"}' AS value FROM files UNION ALL SELECT 'Symbol', qualified_name, '{"name":"' || name || '"}' FROM symbols UNION ALL SELECT 'Commit', sha, '{"author":"' || author || '"}' FROM commits UNION ALL SELECT 'Document', path, '{"type":"' || type || '"}' FROM docs
  UNION ALL SELECT 'SessionKnowledge', session_id || '#' || turn_number, '{"concern":"' || concern || '"}' FROM turns UNION ALL SELECT 'Requirement', id, '{"priority":"' || priority || '"}' FROM requirements)"""
_HITS = "SELECT event_type AS namespace, count(*) FILTER (hit) AS hits, count(*) AS n FROM (SELECT event_type, coalesce(s - lag(s) OVER (PARTITION BY event_type, user_id % 10 ORDER BY s, event_id) <= {}, false) AS hit FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)) GROUP BY 1"
ORACLES = {k: twin(v) for k, v in {
    "upsert_nodes": _ND + """, nn AS (SELECT * FROM (VALUES ('File', 'Brand#3/SMALL'), ('File', 'new/file'), ('Symbol', 'part:5'), ('Symbol', 'part:x'), ('Commit', '7'), ('Commit', 'x'), ('Document', 'docs/x.md'), ('SessionKnowledge', '0#0'), ('SessionKnowledge', 'x#1'), ('Requirement', 'NATION_2'), ('Requirement', 'x')) v(label, key))
      SELECT nd.* FROM nd ANTI JOIN nn USING (label, key) UNION ALL SELECT label, key, '{"new":true}' FROM nn""",
    "upsert_edges": """ SELECT DISTINCT 'IMPORTS' AS type, src, dst FROM imports UNION ALL SELECT DISTINCT 'DEFINES', src, dst FROM defines UNION ALL SELECT DISTINCT 'CALLS', src, dst FROM calls WHERE src IN (SELECT qualified_name FROM symbols) AND dst IN (SELECT qualified_name FROM symbols)
      UNION ALL SELECT DISTINCT 'INHERITS', src, dst FROM inherits UNION ALL SELECT DISTINCT 'MODIFIES', sha, path FROM modifies WHERE sha IN (SELECT sha FROM commits)
      UNION ALL SELECT DISTINCT 'TOUCHES', l_orderkey::VARCHAR, 'part:' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part)
      UNION ALL SELECT DISTINCT 'DESCRIBES', src, dst FROM describes UNION ALL SELECT DISTINCT 'REFERENCES_DOC', src, dst FROM refs
      UNION ALL SELECT DISTINCT 'ABOUT', session_id || '#' || turn_number, q FROM (SELECT session_id, turn_number, unnest(symbols_referenced) AS q FROM turns) WHERE q IN (SELECT qualified_name FROM symbols)
      UNION ALL SELECT DISTINCT 'FOLLOWS', a.session_id || '#' || a.turn_number, b.session_id || '#' || b.turn_number FROM turns a JOIN turns b ON a.session_id = b.session_id AND b.turn_number = a.turn_number - 1
      UNION ALL SELECT DISTINCT 'IMPLEMENTS', src, dst FROM implementations WHERE src IN (SELECT qualified_name FROM symbols)
      UNION ALL SELECT DISTINCT 'DEPENDS_ON', a.id, b.id FROM requirements a JOIN requirements b ON b.id = 'NATION_' || ((a.number * 3 + 1) % 40)""",
    "delete_document": "SELECT 'DESCRIBES' AS type, src, dst FROM describes WHERE src <> 'docs/src5/5.md' UNION ALL SELECT 'REFERENCES_DOC', src, dst FROM refs WHERE 'docs/src5/5.md' NOT IN (src, dst)",
    "clear": "SELECT '' AS label, 0 AS n FROM files WHERE false",
    "document_meta": "SELECT path, CASE WHEN doc_id % 3 <> 0 THEN type WHEN doc_id % 5 = 0 THEN 'adr' WHEN doc_id % 7 <> 0 THEN 'guide' ELSE 'unknown' END AS type, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'draft' ELSE 'active' END AS status, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 9 END AS created, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 1 END AS updated FROM docs WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "annotations": "SELECT 'annotation:a:note:1' AS id, 'a' AS path, 'note' AS kind, 'kept' AS content, 1 AS line UNION ALL SELECT 'annotation:' || path || ':note:' || doc_id, path, 'note', lang, 3 FROM docs WHERE doc_id % 10 = 0",
    "design_merge": "SELECT name, min(kind) AS kind, min(file) AS file, 'active' AS status FROM symbols WHERE name <> 'red widget' GROUP BY name UNION ALL SELECT * FROM (VALUES ('red widget', 'class', 'src/core/types.ts', 'planned'), ('Plan', 'interface', 'src/other/types.ts', 'planned'), ('Lone', 'class', 'src/types/types.ts', 'planned'), ('run', 'function', 'src/core/run.ts', 'planned'), ('go', 'function', 'src/functions/go.ts', 'planned'))",
    "doc_pattern": "SELECT path FROM docs WHERE (regexp_full_match(path, 'docs/src1[^/]*/[^/]*[.]md') OR starts_with(path, 'docs/src5/')) AND NOT regexp_full_match(path, '(.*/)?1[^/]*[.]md') AND NOT regexp_full_match(path, 'docs/src12/[^/]*')",
    "git_status": "SELECT path, CASE WHEN k = 5 THEN 'old/x' END AS origin, k IN (1, 2, 5, 6) AS staged, k IN (0, 1, 6) AS modified, k = 2 AS added, k = 3 AS deleted, k = 5 AS renamed, k = 4 AS untracked FROM (SELECT path, updated_at % 7 AS k FROM files)",
    "git_files": "SELECT DISTINCT path FROM docs",
    "relevance_sort": "SELECT qualified_name, (complexity % 10) / 10 AS relevance FROM symbols ORDER BY relevance DESC, qualified_name LIMIT 40",
    "unified_context": ", cd AS (SELECT i.dst AS id, i.src, s.file FROM implementations i JOIN symbols s ON s.qualified_name = i.src) SELECT r.id, r.priority, (SELECT count(*) FROM cd WHERE cd.id = r.id) AS symbols, (SELECT count(DISTINCT file) FROM cd WHERE cd.id = r.id) AS files, (SELECT count(DISTINCT d.src) FROM cd JOIN describes d ON d.dst = cd.file WHERE cd.id = r.id) AS documents FROM requirements r",
    "ttl_cache": _HITS.format(5 * 3600),
    "context_cache": _HITS.format(24 * 3600),
    "state_tables": ", er AS (SELECT strftime(ts, '%Y-%m-%d') AS \"at\", event_id AS seq, '[parse] ' || user_id || ': ' || coalesce(props, '') AS entry FROM events WHERE event_type = 'error') SELECT \"at\", seq, entry FROM (SELECT *, sum(strlen(entry)) OVER (ORDER BY \"at\" DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS kept, sum(strlen(entry)) OVER () AS total FROM er) WHERE total <= 2000 OR kept <= 1500",
}.items()}


def _bandit_twin() -> str:
    from graphloom.operators import models

    return models.ORACLES["bandit_update"]


ORACLES["bandit_persist"] = _bandit_twin()
