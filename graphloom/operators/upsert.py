"""Keyed upserts, deletes and change capture over immutable tables.

Each operator returns the new table; callers write it beside the old one and swap, so no plan reads a
path that it overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; at most one new row a key is kept, the largest."""
    rest = [c for c in old.columns if c not in keys]
    latest = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest]) if rest else new.dropDuplicates(keys)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def upsert_edges(old: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose endpoints are missing are dropped, then one edge per (src, dst) stays."""
    valid = new.join(sources.select(F.col("key").alias("src")), "src", "left_semi").join(targets.select(F.col("key").alias("dst")), "dst", "left_semi")
    return upsert(old, valid.select(*old.columns), ["src", "dst"])


def with_stubs(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes, and a stub (other columns null) for each edge source that is none of them."""
    missing = edges.select(F.col("src").alias(key)).distinct().join(nodes.select(key), key, "left_anti")
    return nodes.unionByName(missing, allowMissingColumns=True)


def delete_file(symbols: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without those of a file."""
    gone = symbols.filter(F.col("file") == path).select("qualified_name")
    left = edges.join(gone.withColumnRenamed("qualified_name", "src"), "src", "left_anti").join(gone.withColumnRenamed("qualified_name", "dst"), "dst", "left_anti")
    return symbols.filter(F.col("file") != path), left


def replace_by_file(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of re-parsed files: those that vanished from a file go too."""
    return old.join(new.select("file").distinct(), "file", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def set_vector_ids(symbols: DataFrame, links: DataFrame) -> DataFrame:
    ids = links.groupBy("qualified_name").agg(F.array_sort(F.collect_set("id")).alias("vector_ids"))
    return symbols.join(ids, "qualified_name", "left").withColumn("vector_id", F.try_element_at("vector_ids", F.lit(1)))


def compute_delta(tracked: DataFrame, current: DataFrame, kind: str) -> DataFrame:
    """Change of each path; deleted are only tracked paths of the same type.  tracked: path, hash, type."""
    both = tracked.select("path", F.col("hash").alias("old"), "type").join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return both.withColumn("change", change).filter((F.col("change") != "deleted") | (F.col("type") == kind)).select("path", "change")


def mark_synced(tracked: DataFrame, delta: DataFrame, current: DataFrame, kind: str) -> DataFrame:
    """The next snapshot: changed paths overwritten, deleted ones dropped."""
    changed = current.join(delta.filter("change in ('added', 'modified')").select("path"), "path", "left_semi").select("path", "hash", F.lit(kind).alias("type"))
    gone = delta.filter("change in ('modified', 'deleted')").select("path")
    return tracked.join(gone, "path", "left_anti").select("path", "hash", "type").unionByName(changed)


def ingest(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Document log: created, updated or unchanged; the first time and the archived flag are kept."""
    o = old.select("path", F.col("hash").alias("old_hash"), "ingested_at", "archived")
    both = o.join(new.select("path", "hash"), "path", "full_outer")
    status = F.when(F.col("old_hash").isNull(), "created").when(F.col("hash").isNull() | (F.col("hash") == F.col("old_hash")), "unchanged").otherwise("updated")
    return both.select("path", F.coalesce("hash", "old_hash").alias("hash"), F.coalesce("ingested_at", F.lit(now)).alias("ingested_at"), F.coalesce("archived", F.lit(False)).alias("archived"), status.alias("status"))


def import_newer(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """import if absent, update if strictly newer, else skip."""
    both = new.select(key, F.col(stamp).alias("n")).join(old.select(key, F.col(stamp).alias("o")), key, "left")
    return both.select(key, F.when(F.col("o").isNull(), "imported").when(F.col("n") > F.col("o"), "updated").otherwise("skipped").alias("action"))


def gc(entries: DataFrame, existing: DataFrame) -> DataFrame:
    return entries.join(existing.select("path"), "path", "left_semi")


def deploy_status(services: DataFrame) -> DataFrame:
    """active only if every service of a deployment succeeded; services as JSON."""
    return services.groupBy("deployment").agg(F.when(F.bool_and("ok"), "active").otherwise("failed").alias("status"), F.to_json(F.array_sort(F.collect_set("service"))).alias("config"))


def authored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Relations keyed by (src, dst, type); the first creation time stays.

    Old relations with what is new of them, then the rest of the new ones: where both sides have constant types that
    differ, no key can match, and a full join on such a condition would compare all pairs."""
    keys = ["src", "dst", "type"]
    o, n = old.select(*keys, F.col("created").alias("oc"), F.col("note").alias("on")), new.select(*keys, F.col("created").alias("nc"), F.col("note").alias("nn"))
    kept = o.join(n, keys, "left").select(*keys, F.coalesce("oc", "nc").alias("created"), F.coalesce("nn", "on").alias("note"))
    return kept.unionByName(n.join(o.select(*keys), keys, "left_anti").select(*keys, F.col("nc").alias("created"), F.col("nn").alias("note")))


def _tracked(g: Graph) -> DataFrame:
    return g.documents.filter("doc_id % 7 != 0").select("path", F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("content_hash")).alias("hash"), F.when(F.col("doc_id") % 5 == 0, "code").otherwise("document").alias("type"))


def _current(g: Graph) -> DataFrame:
    return g.documents.filter("doc_id % 13 != 0").select("path", F.col("content_hash").alias("hash"))


def _new_symbols(g: Graph, cond: str, name: str) -> DataFrame:
    return g.symbols.filter(cond).select("qualified_name", F.lit(name).alias("name"), "file")


def _stamp(g: Graph, cond: str, by: str) -> DataFrame:
    return g.documents.filter(cond).select("path", F.expr(by).alias("updated"))


def _classes(g: Graph) -> DataFrame:
    return g.symbols.filter("kind = 'class'").select(F.col("qualified_name").alias("key"))


def _called_back(g: Graph) -> DataFrame:
    """Each call the other way round, with another count: some replace a call, some are new."""
    return g.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("call_count") + 10).alias("call_count"))


def _delta(g: Graph) -> DataFrame:
    return compute_delta(_tracked(g), _current(g), "document")


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


QUERIES = {
    "upsert_node": _q(lambda g: upsert(g.symbols.select("qualified_name", "name", "file"), _new_symbols(g, "complexity > 40", "renamed"), ["qualified_name"])),
    "upsert_edge": _q(lambda g: upsert_edges(g.calls, _called_back(g), _classes(g), _classes(g))),
    "merge_creates_endpoint": _q(lambda g: with_stubs(g.symbols.filter("kind = 'class'").select("qualified_name", "name"), g.implementations, "qualified_name")),
    "delete_file": _q(lambda g: delete_file(g.symbols, g.calls, "Brand#3/SMALL")[1]),
    "replace_by_file": _q(lambda g: replace_by_file(g.symbols.select("qualified_name", "name", "file"), _new_symbols(g, "file like 'Brand#3/%' and complexity % 2 = 0", "new"))),
    "set_vector_ids": _q(lambda g: set_vector_ids(g.symbols, g.vectors).select("qualified_name", F.when(F.col("vector_ids").isNull(), 0).otherwise(F.size("vector_ids")).alias("n"), "vector_id")),
    "compute_delta": _q(_delta),
    "mark_synced": _q(lambda g: mark_synced(_tracked(g), _delta(g), _current(g), "document")),
    "ingest": _q(lambda g: ingest(_tracked(g).select("path", "hash", F.lit(5).alias("ingested_at"), (F.col("type") == "code").alias("archived")), _current(g), 9)),
    "import_newer_wins": _q(lambda g: import_newer(_stamp(g, "doc_id % 3 != 0", "doc_id % 10"), _stamp(g, "doc_id % 2 = 0", "doc_id % 7"), "path", "updated")),
    "authored_upsert": _q(lambda g: authored(g.describes.select("src", "dst", F.lit("D").alias("type"), F.lit(1).alias("created"), F.lit("a").alias("note")), g.references.select("src", "dst", F.lit("R").alias("type"), F.lit(2).alias("created"), F.lit("b").alias("note")))),
    "authored_gc": _q(lambda g: gc(g.describes.select(F.col("dst").alias("path")).distinct(), g.files.filter("language = 'go'"))),
    "deploy_record": _q(lambda g: deploy_status(g.table("events").select((F.col("user_id") % 40).alias("deployment"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("service")))),
    "clear_vector_ids": _q(lambda g: set_vector_ids(g.symbols, g.vectors).filter("vector_id is not null").agg(F.count("*").alias("cleared"))),
}

_TR = "(SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE content_hash END AS hash, CASE WHEN doc_id % 5 = 0 THEN 'code' ELSE 'document' END AS type FROM docs WHERE doc_id % 7 <> 0)"
_CU = "(SELECT path, content_hash AS hash FROM docs WHERE doc_id % 13 <> 0)"
_DE = f"(SELECT path, change FROM (SELECT coalesce(o.path, n.path) AS path, o.type, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS change FROM {_TR} o FULL JOIN {_CU} n ON o.path = n.path) WHERE change <> 'deleted' OR type = 'document')"
_CLASS = "(SELECT qualified_name FROM symbols WHERE kind = 'class')"
ORACLES = {k: twin(v) for k, v in {
    "upsert_node": "SELECT qualified_name, CASE WHEN complexity > 40 THEN 'renamed' ELSE name END AS name, file FROM symbols",
    "upsert_edge": f", back AS (SELECT dst AS src, src AS dst, call_count + 10 AS call_count FROM calls WHERE src IN {_CLASS} AND dst IN {_CLASS}) SELECT * FROM calls WHERE (src, dst) NOT IN (SELECT (src, dst) FROM back) UNION ALL SELECT * FROM back",
    "merge_creates_endpoint": "SELECT qualified_name, name FROM symbols WHERE kind = 'class' UNION ALL SELECT DISTINCT src, NULL FROM implementations WHERE src NOT IN (SELECT qualified_name FROM symbols WHERE kind = 'class')",
    "delete_file": "SELECT dst, src, call_count FROM calls WHERE src NOT IN (SELECT qualified_name FROM symbols WHERE file = 'Brand#3/SMALL') AND dst NOT IN (SELECT qualified_name FROM symbols WHERE file = 'Brand#3/SMALL')",
    "replace_by_file": ", n AS (SELECT * FROM symbols WHERE file LIKE 'Brand#3/%' AND complexity % 2 = 0) SELECT qualified_name, name, file FROM symbols WHERE file NOT IN (SELECT file FROM n) UNION ALL SELECT qualified_name, 'new', file FROM n",
    "set_vector_ids": "SELECT s.qualified_name, count(v.id)::INT AS n, min(v.id) AS vector_id FROM symbols s LEFT JOIN vectors v USING (qualified_name) GROUP BY 1",
    "compute_delta": f"SELECT * FROM {_DE}",
    "mark_synced": f"SELECT path, hash, type FROM {_TR} WHERE path NOT IN (SELECT path FROM {_DE} WHERE change IN ('modified', 'deleted')) UNION ALL SELECT path, hash, 'document' FROM {_CU} WHERE path IN (SELECT path FROM {_DE} WHERE change IN ('added', 'modified'))",
    "ingest": f"SELECT coalesce(o.path, n.path) AS path, coalesce(n.hash, o.hash) AS hash, CASE WHEN o.path IS NULL THEN 9 ELSE 5 END AS ingested_at, coalesce(o.type = 'code', false) AS archived, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL OR n.hash = o.hash THEN 'unchanged' ELSE 'updated' END AS status FROM {_TR} o FULL JOIN {_CU} n ON o.path = n.path",
    "import_newer_wins": "SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'imported' WHEN doc_id % 7 > doc_id % 10 THEN 'updated' ELSE 'skipped' END AS action FROM docs WHERE doc_id % 2 = 0",
    "authored_upsert": "SELECT src, dst, 'D' AS type, 1 AS created, 'a' AS note FROM describes UNION ALL SELECT src, dst, 'R', 2, 'b' FROM refs",
    "authored_gc": "SELECT DISTINCT dst AS path FROM describes WHERE dst IN (SELECT path FROM files WHERE language = 'go')",
    "deploy_record": "SELECT user_id % 40 AS deployment, CASE WHEN bool_and(event_type <> 'error') THEN 'active' ELSE 'failed' END AS status, '[' || string_agg(DISTINCT '\"' || event_type || '\"', ',' ORDER BY '\"' || event_type || '\"') || ']' AS config FROM events GROUP BY 1",
    "clear_vector_ids": "SELECT count(DISTINCT qualified_name) AS cleared FROM vectors WHERE qualified_name IN (SELECT qualified_name FROM symbols)",
}.items()}
