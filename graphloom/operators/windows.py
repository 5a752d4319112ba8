"""Ranking, top-k, ordered folds and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin


def top_per_key(edges: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dedup_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def next_sibling(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The next row's key in order within its group; the last one's is the first."""
    w = Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("next", F.coalesce(F.lead(order).over(w), F.first(order).over(whole)))


def transitions(steps: DataFrame, sequence: str, order: list[str], phase: str) -> DataFrame:
    """Counts of consecutive phase pairs within sequences."""
    w = Window.partitionBy(sequence).orderBy(*order)
    return steps.select(F.col(phase).alias("from"), F.lead(phase).over(w).alias("to")).filter("to is not null").groupBy("from", "to").agg(F.count("*").alias("n"))


def predict(counts: DataFrame, phases: list[str]) -> DataFrame:
    """Probability of each next phase; uniform from phases never seen."""
    all_ = counts.sparkSession.createDataFrame([(a, b) for a in phases for b in phases], "from string, to string")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("from"))
    p = F.when(total > 0, F.coalesce("n", F.lit(0)) / total).otherwise(1 / len(phases))
    return all_.join(counts, ["from", "to"], "left").withColumn("p", p).filter("p > 0").select("from", "to", F.round("p", 6).alias("p"))


def most_likely(predicted: DataFrame) -> DataFrame:
    return dedup_first(predicted, ["from"], [F.desc("p"), "to"])


def budget_fill(rows: DataFrame, group: str, cost: str, key: str, order: Column, budget: int) -> DataFrame:
    """Greedy fill in order: what does not fit is skipped, later rows may still fit.  One fold per group."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(acc, x):
        fits = acc["used"] + x["c"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["k"].cast("string")))).otherwise(acc["taken"]).alias("taken"))

    return rows.groupBy(group).agg(items.alias("items")).select(group, F.aggregate("items", start, step).alias("f")).select(group, "f.used", F.explode("f.taken").alias("taken"))


def keep_recent(rows: DataFrame, group: str, order: str, most: int = 50) -> DataFrame:
    return top_per_key(rows, group, [F.desc(order)], most).drop("rank")


def lru_evict(entries: DataFrame, target: int) -> DataFrame:
    """Entries to evict, oldest access first, until the rest is at most `target` bytes.

    Bytes of newer entries are summed per hour of access first, so no task ever holds all entries."""
    newer_hours = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = entries.groupBy("hour").agg(F.sum("bytes").alias("b")).withColumn("newer", F.coalesce(F.sum("b").over(newer_hours), F.lit(0))).select("hour", "newer")
    inside = Window.partitionBy("hour").orderBy(F.desc("accessed"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.col("newer") + F.sum("bytes").over(inside)
    return entries.join(hours, "hour").withColumn("kept", kept).filter(F.col("kept") > target).select("id")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, hash_: str) -> DataFrame:
    """added, modified, unchanged or deleted for every key of two snapshots."""
    a, b = old.select(key, F.col(hash_).alias("old_hash")), new.select(key, F.col(hash_).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def union_dedup(a: DataFrame, b: DataFrame, keys: list[str], newest: str, limit: int) -> DataFrame:
    return a.unionByName(b).dropDuplicates(keys).orderBy(F.desc(newest), *keys).limit(limit)


def merge_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a, and those of b whose key is not in a."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("qualified_name").alias("src")), "src", "left_semi").join(nodes.select(F.col("qualified_name").alias("dst")), "dst", "left_semi")


PHASES = ["signup", "view", "click", "purchase", "error", "refund", "idle"]


def _previous(g: Graph) -> DataFrame:
    """An earlier snapshot: each seventh document missing, each eleventh with another content."""
    d = g.documents.filter("doc_id % 7 != 0")
    return d.select("path", F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))


def _turns_with(g: Graph, x: str) -> DataFrame:
    return g.turns.filter(F.array_contains("symbols_referenced", x)).select("session_id", "turn_number", "timestamp")


def _access(g: Graph) -> DataFrame:
    return g.table("events").select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("accessed"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), (F.col("event_id") % 90 + 10).alias("bytes"))


def _q(f, *columns):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir)).select(*columns) if columns else f(Graph(spark, sf_dir))


QUERIES = {
    "topk_per_symbol": _q(lambda g: top_per_key(g.calls, "dst", [F.desc("call_count"), "src"], 5), "dst", "src", "rank"),
    "lateral_sibling": _q(lambda g: next_sibling(g.symbols, "file", "qualified_name"), "file", "qualified_name", "next"),
    "prev_turn": _q(lambda g: g.turns.withColumn("p", F.lag("turn_number").over(Window.partitionBy("session_id").orderBy("turn_number"))), "session_id", "turn_number", "p"),
    "transitions": _q(lambda g: transitions(g.table("events"), "user_id", ["ts", "event_id"], "event_type")),
    "markov_predict": _q(lambda g: predict(transitions(g.table("events"), "user_id", ["ts", "event_id"], "event_type"), PHASES)),
    "markov_most_likely": _q(lambda g: most_likely(predict(transitions(g.table("events"), "user_id", ["ts", "event_id"], "event_type"), PHASES)), "from", "to", "p"),
    "budget_fill": _q(lambda g: budget_fill(g.symbols, "file", "complexity", "qualified_name", -F.col("complexity"), 120)),
    "history_bound": _q(lambda g: keep_recent(g.table("events").select("user_id", "event_id"), "user_id", "event_id")),
    "dedup_first": _q(lambda g: dedup_first(g.symbols, ["name"], ["qualified_name"]), "name", "qualified_name"),
    "lru_evict": _q(lambda g: lru_evict(_access(g), 200_000)),
    "session_evict": _q(lambda g: g.turns.groupBy("session_id").agg(F.max("timestamp").alias("last")).orderBy(F.desc("last"), "session_id").limit(30)),
    "order_limit": _q(lambda g: g.symbols.orderBy(F.desc("complexity"), "qualified_name").limit(25), "qualified_name", "complexity"),
    "limit_unordered": _q(lambda g: g.symbols.filter("kind = 'class'").orderBy("qualified_name").limit(100), "qualified_name"),
    "multi_key_sort": _q(lambda g: g.imports.orderBy(F.desc("weight"), "src", "dst").limit(50)),
    "sort_by_depth": _q(lambda g: g.files.select("path", F.size(F.split("path", "/")).alias("depth")).orderBy(F.desc("depth"), "path")),
    "union_dedup_knowledge": _q(lambda g: union_dedup(_turns_with(g, "part:5"), _turns_with(g, "part:6"), ["session_id", "turn_number"], "timestamp", 10)),
    "union_distinct": _q(lambda g: g.calls.filter("dst = 'part:5'").select(F.col("src").alias("x")).union(g.calls.filter("dst = 'part:6'").select("src")).distinct()),
    "intersect": _q(lambda g: g.calls.filter("dst in ('part:5', 'part:7', 'part:9')").select(F.col("src").alias("x")).intersect(g.calls.filter("src > 'part:1' and dst > 'part:19'").select("src"))),
    "except_deleted": _q(lambda g: _previous(g).select("path").exceptAll(g.documents.filter("doc_id % 5 != 0").select("path"))),
    "snapshot_diff": _q(lambda g: snapshot_diff(_previous(g), g.documents.filter("doc_id % 13 != 0"), "path", "content_hash")),
    "rel_induced": _q(lambda g: induced(g.calls, g.symbols.filter("kind = 'class'")), "src", "dst"),
    "merge_similar": _q(lambda g: merge_first(g.symbols.filter("kind = 'class'").select("name", F.lit("graph").alias("via")).distinct(), g.symbols.filter("complexity > 40").select("name", F.lit("vector").alias("via")).distinct(), "name")),
}

_TRANS = "(SELECT \"from\", \"to\", count(*) AS n FROM (SELECT event_type AS \"from\", lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"to\" FROM events) WHERE \"to\" IS NOT NULL GROUP BY ALL)"
_PREV = "(SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE content_hash END AS content_hash FROM docs WHERE doc_id % 7 <> 0)"
_PRED = f"(SELECT \"from\", \"to\", round(p, 6) AS p FROM (SELECT a.x AS \"from\", b.x AS \"to\", CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY a.x) > 0 THEN coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.x) ELSE 1.0::DOUBLE / 7 END AS p FROM (SELECT unnest({PHASES!r}) AS x) a, (SELECT unnest({PHASES!r}) AS x) b LEFT JOIN {_TRANS} t ON t.\"from\" = a.x AND t.\"to\" = b.x) WHERE p > 0)"
ORACLES = {k: twin(v) for k, v in {
    "topk_per_symbol": "SELECT dst, src, r::INT AS rank FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY call_count DESC, src) AS r FROM calls) WHERE r <= 5",
    "lateral_sibling": "SELECT file, qualified_name, coalesce(lead(qualified_name) OVER (PARTITION BY file ORDER BY qualified_name), first_value(qualified_name) OVER (PARTITION BY file ORDER BY qualified_name)) AS next FROM symbols",
    "prev_turn": "SELECT session_id, turn_number, lag(turn_number) OVER (PARTITION BY session_id ORDER BY turn_number) AS p FROM turns",
    "transitions": f"SELECT * FROM {_TRANS}",
    "markov_predict": f"SELECT * FROM {_PRED}",
    "markov_most_likely": f"SELECT \"from\", \"to\", p FROM (SELECT *, row_number() OVER (PARTITION BY \"from\" ORDER BY p DESC, \"to\") AS r FROM {_PRED}) WHERE r = 1",
    "budget_fill": """, o AS (SELECT file, qualified_name, complexity, row_number() OVER (PARTITION BY file ORDER BY -complexity, qualified_name) AS r FROM symbols),
      f(file, r, used, taken) AS (SELECT file, 0, 0::BIGINT, NULL::VARCHAR FROM o WHERE r = 1 UNION ALL SELECT o.file, o.r, f.used + CASE WHEN f.used + o.complexity <= 120 THEN o.complexity ELSE 0 END, CASE WHEN f.used + o.complexity <= 120 THEN o.qualified_name END FROM f JOIN o ON o.file = f.file AND o.r = f.r + 1)
      SELECT file, max(used) OVER (PARTITION BY file) AS used, taken FROM f QUALIFY taken IS NOT NULL""",
    "history_bound": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50",
    "dedup_first": "SELECT name, min(qualified_name) AS qualified_name FROM symbols GROUP BY name",
    "lru_evict": "SELECT id FROM (SELECT id, sum(bytes) OVER (ORDER BY h DESC, accessed DESC, id ROWS UNBOUNDED PRECEDING) AS kept FROM (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS accessed, floor(floor(epoch(ts)) / 3600) AS h, event_id % 90 + 10 AS bytes FROM events)) WHERE kept > 200000",
    "session_evict": "SELECT session_id, max(timestamp) AS last FROM turns GROUP BY session_id ORDER BY last DESC, session_id LIMIT 30",
    "order_limit": "SELECT qualified_name, complexity FROM symbols ORDER BY complexity DESC, qualified_name LIMIT 25",
    "limit_unordered": "SELECT qualified_name FROM symbols WHERE kind = 'class' ORDER BY qualified_name LIMIT 100",
    "multi_key_sort": "SELECT src, dst, weight FROM imports ORDER BY weight DESC, src, dst LIMIT 50",
    "sort_by_depth": "SELECT path, len(string_split(path, '/'))::INT AS depth FROM files",
    "union_dedup_knowledge": "SELECT session_id, turn_number, timestamp FROM turns WHERE list_has_any(symbols_referenced, ['part:5', 'part:6']) ORDER BY timestamp DESC, session_id, turn_number LIMIT 10",
    "union_distinct": "SELECT DISTINCT src AS x FROM calls WHERE dst IN ('part:5', 'part:6')",
    "intersect": "SELECT src AS x FROM calls WHERE dst IN ('part:5', 'part:7', 'part:9') INTERSECT SELECT src FROM calls WHERE src > 'part:1' AND dst > 'part:19'",
    "except_deleted": f"SELECT path FROM {_PREV} EXCEPT ALL SELECT path FROM docs WHERE doc_id % 5 <> 0",
    "snapshot_diff": f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.content_hash <> b.content_hash THEN 'modified' ELSE 'unchanged' END AS change FROM {_PREV} a FULL JOIN (SELECT * FROM docs WHERE doc_id % 13 <> 0) b ON a.path = b.path",
    "rel_induced": "SELECT src, dst FROM calls WHERE src IN (SELECT qualified_name FROM symbols WHERE kind = 'class') AND dst IN (SELECT qualified_name FROM symbols WHERE kind = 'class')",
    "merge_similar": "SELECT DISTINCT name, 'graph' AS via FROM symbols WHERE kind = 'class' UNION ALL SELECT DISTINCT name, 'vector' FROM symbols WHERE complexity > 40 AND name NOT IN (SELECT name FROM symbols WHERE kind = 'class')",
}.items()}
