"""Traversal: reachability, shortest and all paths, cycles, neighbourhoods, impact.

Reachability advances a frontier level by level and keeps one row per node; paths are enumerated as
edge-unique trails (or simple paths) up to a bounded depth.  Each level is checkpointed, so plans
stay short and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.aggregates import union
from graphloom.plans.model import Graph, twin
from graphloom.staging import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of typed edges (src, dst, type), the true direction kept in `forward`."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit(False).alias("forward"))
    return edges.select("src", "dst", "type", F.lit(True).alias("forward")).unionByName(back)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, distance) within `depth` steps along src to dst; start: node, at distance 0."""
    steps = cut(edges.select("src", "dst").distinct())
    seen = cut(start.select("node", F.lit(0).alias("distance")))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def trails(edges: DataFrame, start: DataFrame, depth: int, mode: str = "trail", keep: Column | None = None) -> DataFrame:
    """All paths of 1 to `depth` edges from the start nodes: nodes (array) and length.

    mode trail: no edge twice; simple: no node twice.  `keep` filters what is returned, not what goes on."""
    step = cut(edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst")).distinct())
    front = start.select(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("used"))
    found = []
    for length in range(1, depth + 1):
        edge = F.concat_ws(">", "e_src", "e_dst")
        free = ~F.array_contains("nodes", F.col("e_dst")) if mode == "simple" else ~F.array_contains("used", edge)
        front = front.join(step, F.element_at("nodes", -1) == F.col("e_src")).filter(free)
        front = cut(front.select(F.concat("nodes", F.array("e_dst")).alias("nodes"), F.concat("used", F.array(edge)).alias("used")))
        found.append(front.select("nodes", F.lit(length).alias("length")))
    out = union(found)
    return out.filter(keep) if keep is not None else out


def paths_to(edges: DataFrame, start: DataFrame, targets: DataFrame, depth: int, limit: int, mode: str = "trail") -> DataFrame:
    """The first `limit` paths of 1 to `depth` edges from start nodes to targets, by length, then names: path, length.

    One length is searched after the other, over nodes from which a target is near enough; as shorter paths come
    first, no longer ones are searched once there are `limit` of them."""
    step = cut(edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst")).distinct())
    back = step.select(F.col("e_dst").alias("src"), F.col("e_src").alias("dst"))
    rest = reach(back, targets.select("node").distinct(), depth).select(F.col("node").alias("e_dst"), F.col("distance").alias("rest"))
    start = cut(start.select("node"))
    least = rest.join(start, F.col("e_dst") == F.col("node")).agg(F.min("rest")).first()[0]
    first = start.select(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("used"))
    found, n = [first.select("nodes", F.lit(0).alias("length")).limit(0)], 0
    for length in range(max(1, least), depth + 1) if least is not None else ():
        front = first
        for at in range(1, length + 1):
            edge = F.concat_ws(">", "e_src", "e_dst")
            free = ~F.array_contains("nodes", F.col("e_dst")) if mode == "simple" else ~F.array_contains("used", edge)
            near = rest.filter(F.col("rest") <= length - at)
            front = front.join(step.join(near, "e_dst", "left_semi"), F.element_at("nodes", -1) == F.col("e_src")).filter(free)
            front = cut(front.select(F.concat("nodes", F.array("e_dst")).alias("nodes"), F.concat("used", F.array(edge)).alias("used")))
        found.append(front.select("nodes", F.lit(length).alias("length")))
        n += front.count()
        if n >= limit:
            break
    return union(found).select(F.array_join("nodes", ">").alias("path"), "length").orderBy("length", "path").limit(limit)


def call_paths(calls: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = 10, limit: int = 100) -> DataFrame:
    """Directed call paths between two sets of symbols, shortest first."""
    return paths_to(calls, sources, targets, depth, limit)


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 10) -> DataFrame:
    """The shortest undirected path (smallest node names among equals): path, length, or no row."""
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    both = undirected(edges).select("src", "dst").distinct()
    # Parents point to the smallest node one level nearer to the source.
    levels = [cut(one(source).select("node", F.lit(None).cast("string").alias("parent")))]
    seen = levels[0].select("node")
    hit = source == target
    while not hit and len(levels) <= depth:
        step = levels[-1].select(F.col("node").alias("src")).join(both, "src").join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        level = cut(step.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("node"))
        hit = not level.filter(F.col("node") == target).isEmpty()
    if not hit:
        return one(source).select(F.lit("").alias("path"), F.lit(0).alias("length")).limit(0)
    path = one(target).select(F.col("node").alias("at"), F.array("node").alias("nodes"))
    for level in reversed(levels[1:]):
        path = path.join(level, path["at"] == level["node"]).select(F.col("parent").alias("at"), F.concat(F.array("parent"), "nodes").alias("nodes"))
    return path.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("length"))


def all_paths(edges: DataFrame, source: str, target: str, depth: int = 6, limit: int = 10) -> DataFrame:
    """Undirected trails between two nodes, by length, then names."""
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    return paths_to(undirected(edges), one(source), one(target), depth, limit, "simple")


def cycles(edges: DataFrame, longest: int, limit: int, least: int = 2) -> DataFrame:
    """Cycles of `least` to `longest` edges, one row per rotation; self-loops are left out.

    Only nodes that can lie on a cycle stay: those without a way in or out are peeled off first.  As shorter cycles
    come first, no longer ones are searched once there are `limit` of them."""
    edges = cut(edges.filter("src != dst").select("src", "dst").distinct())
    for _ in range(longest):
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    nodes = edges.select(F.col("src").alias("node")).distinct()
    front = nodes.select(F.array("node").alias("nodes"))
    found, n = [], 0
    step = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))
    for length in range(1, longest + 1):
        grown = front.join(step, F.element_at("nodes", -1) == F.col("e_src"))
        if length >= least:
            found.append(grown.filter(F.col("e_dst") == F.col("nodes")[0]).select(F.array_join(F.concat("nodes", F.array("e_dst")), ">").alias("path"), F.lit(length).alias("length")))
            if length < longest and (n := n + found[-1].count()) >= limit:
                break
        front = cut(grown.filter(~F.array_contains("nodes", F.col("e_dst"))).select(F.concat("nodes", F.array("e_dst")).alias("nodes")))
    return union(found).orderBy("length", "path").limit(limit)


def dead_code(symbols: DataFrame, calls: DataFrame, entries: list[str], limit: int = 100) -> DataFrame:
    called = calls.select(F.col("dst").alias("qualified_name"))
    return symbols.filter((F.col("kind") == "function") & ~F.col("name").isin(entries)).join(called, "qualified_name", "left_anti").orderBy("qualified_name").limit(limit)


def neighborhood(edges: DataFrame, center: str, depth: int = 2, limit: int | None = 50, direction: str = "both") -> DataFrame:
    """Neighbours of a node by distance: first relationship type and 1-hop direction (outgoing, incoming, both).

    One row per neighbour, at its smallest distance, with the smallest type among its last edges; limit None: all of them."""
    spark = edges.sparkSession
    steps = undirected(edges)
    if direction != "both":
        steps = steps.filter(F.col("forward") == (direction == "outgoing"))
    steps = cut(steps)
    seen = cut(reach(steps, spark.createDataFrame([(center,)], "node string"), depth))
    near = seen.filter("distance > 0")
    into = steps.join(seen.select(F.col("node").alias("src"), (F.col("distance") + 1).alias("distance")), "src").join(near.select(F.col("node").alias("dst"), "distance"), ["dst", "distance"])
    kind = into.groupBy(F.col("dst").alias("node")).agg(F.min("type").alias("relationship"))
    one = steps.filter(F.col("src") == center).groupBy(F.col("dst").alias("node")).agg(F.max("forward").alias("out"), F.max(~F.col("forward")).alias("in"))
    way = F.when(F.col("out") & F.col("in"), "both").when(F.col("out"), "outgoing").when(F.col("in"), "incoming").otherwise("indirect")
    out = near.join(kind, "node").join(one, "node", "left").select("node", "distance", "relationship", way.alias("direction"))
    return out if limit is None else out.orderBy("distance", "node").limit(limit)


def risk_level(direct: Column, files: Column, total: Column) -> Column:
    """Fixed thresholds of the impact rating."""
    return (
        F.when((direct > 20) | (files > 15), "critical").when((direct > 10) | (files > 8) | (total > 30), "high").when((direct > 3) | (files > 3) | (total > 10), "medium").otherwise("low")
    )


def impact(symbols: DataFrame, calls: DataFrame, inherits: DataFrame, target: str, depth: int = 3, indirect_limit: int = 50) -> DataFrame:
    """Counts of direct and indirect callers, implementors, extenders and files, and the risk."""
    spark = symbols.sparkSession
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = reach(back, spark.createDataFrame([(target,)], "node string"), depth).filter("distance > 0")
    indirect = seen.filter("distance > 1").orderBy("distance", "node").limit(indirect_limit)
    kids = inherits.filter(F.col("dst") == target).select(F.col("src").alias("node"), "type")
    touched = seen.filter("distance = 1").select("node").unionByName(indirect.select("node")).unionByName(kids.select("node")).distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    files = symbols.join(touched.withColumnRenamed("node", "qualified_name"), "qualified_name", "left_semi").filter("file != ''").select("file").distinct()
    row = n(seen.filter("distance = 1"), "direct").join(n(indirect, "indirect")).join(n(kids.filter("type = 'implements'"), "implementors")).join(n(kids.filter("type = 'extends'"), "extenders")).join(n(files, "files")).join(n(touched, "total"))
    return row.withColumn("risk", risk_level(F.col("direct"), F.col("files"), F.col("total")))


def connected_directly(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.agg(F.coalesce(F.bool_or(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))), F.lit(False)).alias("direct"))


def bridge(edges: DataFrame, a: str, b: str, depth: int = 6, limit: int = 5) -> DataFrame:
    """The first `limit` undirected ways of up to `depth` edges between two nodes, and whether an edge joins them: path,
    types of its edges (the smallest of several), length, direct, explanation."""
    ways = all_paths(edges, a, b, depth, limit)
    types = undirected(edges).groupBy("src", "dst").agg(F.min("type").alias("type"))
    steps = ways.select("path", "length", F.split("path", ">").alias("n")).select("path", "length", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.struct(F.get("n", i - 1).alias("src"), F.get("n", i).alias("dst")))).alias("at", "s"))
    named = steps.join(types, (F.col("s.src") == F.col("src")) & (F.col("s.dst") == F.col("dst"))).groupBy("path", "length").agg(F.array_sort(F.collect_list(F.struct("at", "type"))).alias("t"))
    kinds = F.array_join(F.transform("t", lambda x: x["type"]), ",")
    text = F.concat(F.lit(f"{a} reaches {b} by "), kinds, F.lit(" in "), F.col("length").cast("string"), F.when(F.col("length") == 1, " step").otherwise(" steps"))
    return named.join(connected_directly(edges, a, b)).select("path", kinds.alias("types"), "length", "direct", text.alias("explanation"))


def modules(files: DataFrame) -> DataFrame:
    """Top directories of files that are in one."""
    return files.filter(F.col("path").contains("/")).select(F.split("path", "/")[0].alias("module")).distinct().orderBy("module")


def hierarchy_level(module: str | None, file: str | None, symbol: str | None) -> int:
    """0 repository, 1 module, 2 file, 3 symbol."""
    return 3 if symbol else 2 if file else 1 if module else 0


def typed_edges(g: Graph) -> DataFrame:
    return g.calls.select("src", "dst", F.lit("CALLS").alias("type")).unionByName(g.inherits.select("src", "dst", F.lit("INHERITS").alias("type")))


def _nodes(g: Graph, *names: str) -> DataFrame:
    return g.spark.createDataFrame([(x,) for x in names], "node string")


def _q(f, *columns):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir).fixed()).select(*columns) if columns else f(Graph(spark, sf_dir).fixed())


# The start is the symbol with the most calls out, so that there is something to find at any scale.
def _busiest(g: Graph) -> str:
    row = g.calls.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    return row["src"] if row else "part:0"


def _far(g: Graph) -> str:
    row = reach(undirected(typed_edges(g)), _nodes(g, _busiest(g)), 4).orderBy(F.desc("distance"), "node").first()
    return row["node"]


QUERIES = {
    "reachability": _q(lambda g: reach(g.calls, _nodes(g, _busiest(g)), 4)),
    "find_call_paths": _q(lambda g: call_paths(g.calls, g.symbols.filter("name = 'red widget'").select(F.col("qualified_name").alias("node")), g.symbols.filter("kind = 'function'").select(F.col("qualified_name").alias("node")))),
    "shortest_path": _q(lambda g: shortest_path(typed_edges(g), _busiest(g), _far(g)).select("length")),
    "all_paths": _q(lambda g: all_paths(typed_edges(g), _busiest(g), _far(g))),
    "neighborhood": _q(lambda g: neighborhood(typed_edges(g), _busiest(g))),
    "neighborhood_by_distance": _q(lambda g: neighborhood(typed_edges(g), _busiest(g), 3, None).groupBy("distance", "relationship").agg(F.count("*").alias("n"))),
    "impact": _q(lambda g: impact(g.symbols, g.calls, g.inherits, "part:5")),
    "bridge_direct": _q(lambda g: connected_directly(typed_edges(g), "part:5", "part:6")),
    "bridge": _q(lambda g: bridge(typed_edges(g), _busiest(g), _far(g))),
    "cycles_calls": _q(lambda g: cycles(g.calls, 5, 50)),
    "cycles_imports": _q(lambda g: cycles(g.imports, 4, 10)),
    "dead_code": _q(lambda g: dead_code(g.symbols, g.calls, ["main", "init", "__init__", "constructor"]), "qualified_name", "name", "file"),
    "k_hop_calls": _q(lambda g: reach(g.calls, _nodes(g, "part:5"), 1).filter("distance = 1"), "node"),
    "modules": _q(lambda g: modules(g.files)),
    "requirement_dependencies": _q(lambda g: reach(g.requirements.select(F.col("id").alias("src"), F.concat(F.lit("NATION_"), ((F.col("number") * 3 + 1) % 25).cast("string")).alias("dst")), _nodes(g, "NATION_2"), 3)),
}

_START = "(SELECT src FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_TYPED = ", te AS (SELECT src, dst, 'CALLS' AS type FROM calls UNION ALL SELECT src, dst, 'INHERITS' FROM inherits), ud AS (SELECT src, dst, type, true AS fwd FROM te UNION ALL SELECT dst, src, type, false FROM te)"
_BFS = ", st AS MATERIALIZED {start}, walk(node, d) AS (SELECT src, 0 FROM st UNION SELECT e.dst, d + 1 FROM walk JOIN {edges} e ON e.src = node WHERE d < {depth}), lv AS (SELECT node, min(d) AS distance FROM walk GROUP BY node)"
_FAR = ", far AS MATERIALIZED (SELECT node AS f FROM lv ORDER BY distance DESC, node LIMIT 1)"
ORACLES = {k: twin(v) for k, v in {
    "reachability": _BFS.format(start=_START, edges="calls", depth=4) + " SELECT node, distance::INT AS distance FROM lv",
    "shortest_path": _TYPED + _BFS.format(start=_START, edges="ud", depth=4) + _FAR + " SELECT distance::INT AS length FROM lv WHERE node = (SELECT f FROM far)",
    "neighborhood": _TYPED + _BFS.format(start=_START, edges="ud", depth=2) + " SELECT l.node, l.distance::INT AS distance, (SELECT min(u.type) FROM ud u JOIN lv x ON x.node = u.src WHERE u.dst = l.node AND x.distance = l.distance - 1) AS relationship, coalesce((SELECT CASE WHEN bool_or(fwd) AND bool_or(NOT fwd) THEN 'both' WHEN bool_or(fwd) THEN 'outgoing' WHEN bool_or(NOT fwd) THEN 'incoming' END FROM ud WHERE src = (SELECT src FROM st) AND dst = l.node), 'indirect') AS direction FROM lv l WHERE l.distance > 0 ORDER BY 2, 1 LIMIT 50",
    "neighborhood_by_distance": _TYPED + _BFS.format(start=_START, edges="ud", depth=3) + " SELECT distance, relationship, count(*) AS n FROM (SELECT l.distance::INT AS distance, (SELECT min(u.type) FROM ud u JOIN lv x ON x.node = u.src WHERE u.dst = l.node AND x.distance = l.distance - 1) AS relationship FROM lv l WHERE l.distance > 0) GROUP BY ALL",
    "impact": _BFS.format(start="(SELECT 'part:5' AS src)", edges="(SELECT dst AS src, src AS dst FROM calls)", depth=3) + ", ind AS (SELECT node FROM lv WHERE distance > 1 ORDER BY distance, node LIMIT 50), kids AS (SELECT src AS node, type FROM inherits WHERE dst = 'part:5'), touched AS (SELECT node FROM lv WHERE distance = 1 UNION SELECT node FROM ind UNION SELECT node FROM kids), c AS (SELECT (SELECT count(*) FROM lv WHERE distance = 1) AS direct, (SELECT count(*) FROM ind) AS indirect, (SELECT count(*) FROM kids WHERE type = 'implements') AS implementors, (SELECT count(*) FROM kids WHERE type = 'extends') AS extenders, (SELECT count(DISTINCT file) FROM symbols WHERE qualified_name IN (SELECT node FROM touched)) AS files, (SELECT count(*) FROM touched) AS total) SELECT *, CASE WHEN direct > 20 OR files > 15 THEN 'critical' WHEN direct > 10 OR files > 8 OR total > 30 THEN 'high' WHEN direct > 3 OR files > 3 OR total > 10 THEN 'medium' ELSE 'low' END AS risk FROM c",
    "bridge_direct": "SELECT (SELECT count(*) FROM calls WHERE (src, dst) IN (('part:5', 'part:6'), ('part:6', 'part:5'))) > 0 AS direct",
    "dead_code": "SELECT qualified_name, name, file FROM symbols WHERE kind = 'function' AND qualified_name NOT IN (SELECT dst FROM calls) ORDER BY qualified_name LIMIT 100",
    "k_hop_calls": "SELECT DISTINCT dst AS node FROM calls WHERE src = 'part:5' AND dst <> 'part:5'",
    "modules": "SELECT DISTINCT split_part(path, '/', 1) AS module FROM files",
    "requirement_dependencies": _BFS.format(start="(SELECT 'NATION_2' AS src)", edges="(SELECT id AS src, 'NATION_' || ((number * 3 + 1) % 25) AS dst FROM requirements)", depth=3) + " SELECT node, distance::INT AS distance FROM lv",
}.items()}
