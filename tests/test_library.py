"""Hand-checked fixtures and property tests of the graph library."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import markdown, parsers, text
from graphloom.operators import aggregates, hybrid, lookup, models, paths, upsert, vectors, windows
from graphloom.sources import portable
from graphloom.staging import shared_path
from graphloom.streaming import events


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def brute_distances(pairs, start, depth):
    seen, front = {start: 0}, {start}
    for level in range(1, depth + 1):
        front = {b for a, b in pairs if a in front} - set(seen)
        seen |= {x: level for x in front}
    return seen


def brute_trails(pairs, start, depth, simple=False):
    out, front = [], [([start], [])]
    for _ in range(depth):
        front = [(p + [b], used + [(a, b)]) for p, used in front for a, b in set(pairs) if a == p[-1] and ((b not in p) if simple else ((a, b) not in used))]
        out += [p for p, _ in front]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_traversals_on_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(16)})
    df = edges_of(spark, pairs)
    got = {x["node"]: x["distance"] for x in paths.reach(df, nodes(spark, "n0"), 4).collect()}
    assert got == brute_distances(pairs, "n0", 4)
    for mode in ("trail", "simple"):
        got = sorted(x["nodes"] for x in paths.trails(df, nodes(spark, "n0"), 3, mode).collect())
        assert got == sorted(brute_trails(pairs, "n0", 3, mode == "simple"))
    want = sorted(">".join([*c, c[0]]) for n in (2, 3, 4) for c in product([f"n{i}" for i in range(9)], repeat=n) if len(set(c)) == n and all(e in pairs for e in zip(c, c[1:] + c[:1], strict=True)))
    assert sorted(x["path"] for x in paths.cycles(df, 4, 10_000).collect()) == want


def test_cycles_fixture(spark):
    df = edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "x"), ("d", "e")])
    got = {x["path"] for x in paths.cycles(df, 4, 100).collect()}
    assert got == {"a>b>a", "b>a>b", "b>c>d>b", "c>d>b>c", "d>b>c>d"}
    assert paths.cycles(edges_of(spark, []), 3, 10).count() == 0


def test_shortest_and_all_paths_of_a_diamond(spark):
    df = edges_of(spark, [("s", "b"), ("s", "a"), ("a", "t"), ("t", "b"), ("u", "v")]).withColumn("type", F.lit("CALLS"))
    assert [tuple(x) for x in paths.shortest_path(df, "s", "t").collect()] == [("s>a>t", 2)]
    assert [x["path"] for x in paths.all_paths(df, "s", "t").collect()] == ["s>a>t", "s>b>t"]
    assert paths.shortest_path(df, "s", "u").count() == 0
    assert [tuple(x) for x in paths.shortest_path(df, "s", "s").collect()] == [("s", 0)]


def test_neighborhood_direction_and_one_row_each(spark):
    df = spark.createDataFrame([("c", "v", "CALLS"), ("p", "c", "CALLS"), ("c", "v", "INHERITS"), ("v", "w", "CALLS"), ("c", "p", "INHERITS")], "src string, dst string, type string")
    got = {x["node"]: (x["distance"], x["relationship"], x["direction"]) for x in paths.neighborhood(df, "c").collect()}
    assert got == {"v": (1, "CALLS", "outgoing"), "p": (1, "CALLS", "both"), "w": (2, "CALLS", "indirect")}
    assert {x["node"] for x in paths.neighborhood(df, "c", direction="incoming").collect()} == {"p"}


def test_impact_counts_each_kind_once(spark):
    symbols = spark.createDataFrame([(f"s{i}", f"f{i % 2}") for i in range(6)], "qualified_name string, file string")
    calls = edges_of(spark, [("s1", "s0"), ("s2", "s1"), ("s0", "s2")])
    inherits = spark.createDataFrame([("s3", "s0", "implements"), ("s4", "s0", "extends")], "src string, dst string, type string")
    row = paths.impact(symbols, calls, inherits, "s0").first()
    assert (row["direct"], row["indirect"], row["implementors"], row["extenders"], row["total"], row["files"], row["risk"]) == (1, 1, 1, 1, 4, 2, "low")


def test_globs_and_sync_rules(spark):
    rows = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/x/b.ts", "a.ts", "src/abc.ts")], "path string")
    pick = lambda g: {x["path"] for x in rows.filter(lookup.glob_match("path", g)).collect()}
    assert pick("src/*.ts") == {"src/a.ts", "src/abc.ts"} and pick("**/*.ts") == {"src/a.ts", "src/x/b.ts", "a.ts", "src/abc.ts"} and pick("src/?.ts") == {"src/a.ts"} and pick("src/**") == {"src/a.ts", "src/x/b.ts", "src/abc.ts"}


def test_delta_fixtures(spark):
    t = spark.createDataFrame([("keep", "1", "code"), ("change", "1", "code"), ("gone", "1", "code"), ("doc", "1", "document")], "path string, hash string, type string")
    c = spark.createDataFrame([("keep", "1"), ("change", "2"), ("new", "1")], "path string, hash string")
    delta = upsert.compute_delta(t, c, "code")
    assert {tuple(x) for x in delta.collect()} == {("keep", "unchanged"), ("change", "modified"), ("gone", "deleted"), ("new", "added")}
    after = {tuple(x) for x in upsert.mark_synced(t, delta, c, "code").collect()}
    assert after == {("keep", "1", "code"), ("change", "2", "code"), ("new", "1", "code"), ("doc", "1", "document")}
    empty = c.filter("false")
    assert {tuple(x) for x in upsert.compute_delta(t, empty, "code").collect()} == {("keep", "deleted"), ("change", "deleted"), ("gone", "deleted")}


def test_upsert_keeps_one_row_a_key_and_drops_dangling_edges(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert {tuple(x) for x in upsert.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 1)}
    e = spark.createDataFrame([("a", "b", 1)], "src string, dst string, n int")
    n = spark.createDataFrame([("a", "zz", 1), ("b", "a", 2)], "src string, dst string, n int")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {tuple(x) for x in upsert.upsert_edges(e, n, keys, keys).collect()} == {("a", "b", 1), ("b", "a", 2)}


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("g", "a", 60), ("g", "b", 50), ("g", "c", 30), ("g", "d", 11)], "g string, k string, cost int")
    got = windows.budget_fill(rows, "g", "cost", "k", F.col("k"), 100).collect()
    assert [x["taken"] for x in got] == ["a", "c"] and got[0]["used"] == 90


def test_watch_events_batch_and_stream(spark):
    rules = [("", "add", "add"), ("add", "unlink", ""), ("unlink", "add", "change"), ("change", "unlink", "unlink"), ("add", "change", "add"), ("change", "add", "change")]
    assert all(events.merge_event(a, b) == c for a, b, c in rules)
    r = random.Random(3)
    rows = [(f"p{r.randrange(4)}", i, r.choice(["add", "change", "unlink"])) for i in range(60)]
    held: dict = {}
    for p, _, k in rows:
        held[p] = events.merge_event(held.get(p, ""), k)
    df = spark.createDataFrame(rows, "path string, seq long, kind string")
    assert {tuple(x) for x in events.coalesce_events(df).collect()} == {(p, k) for p, k in held.items() if k}


def test_coalescing_stream_emits_after_a_quiet_time(spark):
    import time

    where = shared_path(spark, "watch").removeprefix("file://")
    rows = [("a", 1, "add"), ("a", 2, "unlink"), ("b", 3, "unlink"), ("b", 4, "add")]
    spark.createDataFrame(rows, "path string, seq long, kind string").coalesce(1).write.json(where)
    stream = spark.readStream.schema("path string, seq long, kind string").json(where)
    out = events.coalesce_stream(stream, 200)
    q = out.writeStream.format("memory").queryName("watch_out").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            if spark.sql("SELECT * FROM watch_out").count():
                break
            time.sleep(0.5)
        assert [tuple(x) for x in spark.sql("SELECT * FROM watch_out").collect()] == [("b", "change")]
    finally:
        q.stop()


def test_delta_by_micro_batches(spark):
    t = spark.createDataFrame([("a", "1", "code")], "path string, hash string, type string")
    apply = events.delta_batches(t, "code")
    apply(spark.createDataFrame([("b", "1"), ("a", "2")], "path string, hash string"), 0)
    apply(spark.createDataFrame([("b", "2")], "path string, hash string"), 1)
    assert {(x["path"], x["hash"]) for x in spark.read.parquet(apply.snapshot).collect()} == {("a", "2"), ("b", "2")}


def test_authored_relations_of_constant_types_are_not_compared_in_pairs(spark):
    columns = "src string, dst string, type string, created int, note string"
    old = spark.createDataFrame([("a", "b", "D", 1, "x"), ("a", "b", "D", 2, None), ("a", None, "D", 3, "n"), ("c", "d", "D", None, None)], columns)
    new = spark.createDataFrame([("a", "b", "D", 5, "y"), ("a", None, "D", 6, "m"), ("c", "d", "D", 7, None), ("e", "f", "D", 8, "z")], columns)
    want = [("a", "b", "D", 1, "y"), ("a", "b", "D", 2, "y"), ("a", None, "D", 3, "n"), ("a", None, "D", 6, "m"), ("c", "d", "D", 7, None), ("e", "f", "D", 8, "z")]
    assert sorted(map(tuple, upsert.authored(old, new).collect()), key=repr) == sorted(want, key=repr)
    other = upsert.authored(old, new.withColumn("type", F.lit("R")))
    apart = upsert.authored(old.withColumn("type", F.lit("D")), new.withColumn("type", F.lit("R")))
    assert sorted(map(tuple, apart.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr)
    assert "NestedLoop" not in apart._jdf.queryExecution().executedPlan().toString()


def test_vector_edge_cases(spark):
    rows = spark.createDataFrame([("z", [0.0, 0.0]), ("short", [1.0]), ("same", [2.0, 0.0]), ("tie", [4.0, 0.0])], "id string, embedding array<double>")
    got = {x["id"]: x["score"] for x in vectors.scored(rows, [1.0, 0.0]).collect()}
    assert got == {"z": 0.0, "short": 0.0, "same": 1.0, "tie": 1.0}
    assert [x["id"] for x in vectors.search(rows, [1.0, 0.0], 1).collect()] == ["same"]
    q = rows.filter("id in ('same', 'tie')").selectExpr("id AS query_id", "embedding AS query_vec")
    both = [{tuple(x) for x in vectors.search_batch(rows, q, 2, n).select("query_id", "id").collect()} for n in (10, 1)]
    assert both[0] == both[1] and ("same", "tie") in both[0]


def test_search_batch_against_brute_force(spark):
    """Copies, scaled copies, scores that are equal once rounded, zero, short, null and infinite vectors, repeated rows; in
    one block and in several, as matrices."""
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 8)).round(2)
    base[100:150], base[150:160] = base[7], 3 * base[7]
    base[160:200] = base[9] + 1e-8 * r.normal(size=(40, 8))
    rows = [(f"v{i}", [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [("zero", [0.0] * 8), ("short", [1.0]), ("none", None), ("hole", [1.0, None]), ("far", [float("inf")] * 8), rows[7], rows[100]]
    v = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    q = v.filter("id rlike '^v[0-9]*[05]$' or id in ('v7', 'v9', 'zero', 'short', 'none', 'far')").selectExpr("id AS query_id", "embedding AS query_vec")
    pairs = v.crossJoin(q).filter("id != query_id").select("query_id", "id", F.round(vectors.cosine(F.col("embedding"), F.col("query_vec")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    want = sorted(map(str, pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("query_id", "rank", "id", "score").collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for most, batch in ((1 << 20, "10000"), (30, "7")):
        spark.conf.set(size, batch)
        got = vectors.search_batch(v, q, 3, most, digits=6).select("query_id", "rank", "id", F.round("score", 6).alias("score")).collect()
        spark.conf.unset(size)
        assert sorted(map(str, got)) == want
    many = vectors.search_batch(v.filter("id like 'v%'"), q.filter("query_id like 'v%'"), 3, digits=6)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_embedding_ids_fold_white_space(spark):
    row = spark.range(1).select(*[vectors.content_id(m, F.lit(t)).alias(f"c{i}") for i, (m, t) in enumerate([("m", "hello   world"), ("m", "  hello world  "), ("n", "hello world")])]).first()
    assert row["c0"] == row["c1"] != row["c2"] and len(row["c0"]) == 16


def test_bandit_against_numpy(spark):
    r = np.random.default_rng(1)
    x, reward = r.random((40, 3)).round(3), r.random(40).round(3)
    rows = [("a" if i % 2 else "b", *map(float, x[i]), float(reward[i])) for i in range(40)]
    arms = models.bandit_update(spark.createDataFrame(rows, "arm string, x0 double, x1 double, x2 double, r double"), "arm", ["x0", "x1", "x2"], "r")
    got = {s["arm"]: s["score"] for s in models.bandit_score(arms, "arm", [0.3, 0.6, 0.1]).collect()}
    for arm, pick in (("a", slice(1, None, 2)), ("b", slice(0, None, 2))):
        a, b, v = np.eye(3) + x[pick].T @ x[pick], x[pick].T @ reward[pick], np.array([0.3, 0.6, 0.1])
        inv = np.linalg.inv(a)
        assert got[arm] == pytest.approx(v @ inv @ b + np.sqrt(v @ inv @ v), abs=1e-8)


def test_markov_is_uniform_from_unseen_phases(spark):
    steps = spark.createDataFrame([("s", i, p) for i, p in enumerate("aabab")], "s string, i int, p string")
    got = {(x["from"], x["to"]): x["p"] for x in windows.predict(windows.transitions(steps, "s", ["i"], "p"), ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(2 / 3, abs=1e-6) and got[("b", "a")] == 1 and got[("c", "b")] == pytest.approx(1 / 3, abs=1e-6) and ("b", "c") not in got


MD = '---\ntitle: "A"\ntype: api_doc\ntags: [x, \'y\']\nowner: me\n---\n# One\ntext [l](../o/p.ts#a) <https://e.org/q>\n```\n# not\n```\n### Deep\n## Two ##\n[self](#two)\n'


def test_markdown(spark):
    d = spark.createDataFrame([("docs/a/b.md", MD), ("plain.md", "no heading\n")], "path string, text string")
    m = d.select(markdown.front_matter(F.col("text")).alias("m")).first()["m"]
    assert m == {"title": "A", "type": "api_doc", "tags": "[x, 'y']", "owner": "me"}
    assert [(x["line"], x["level"], x["text"]) for x in markdown.headings(d).orderBy("line").collect()] == [(7, 1, "One"), (12, 3, "Deep"), (13, 2, "Two")]
    got = {(x["target"], x["internal"], x["code"]) for x in markdown.links(d).collect()}
    assert got == {("../o/p.ts#a", True, True), ("https://e.org/q", False, False), ("#two", True, False)}
    one = spark.range(1).select(markdown.resolve_link(F.lit("docs/a/b.md"), F.lit("../o/p.ts#a")).alias("x"), markdown.resolve_link(F.lit("docs/a/b.md"), F.lit("#two")).alias("y"), markdown.resolve_link(F.lit("docs/a/b.md"), F.lit("/src/z.ts")).alias("z")).first()
    assert tuple(one) == ("docs/o/p.ts", "docs/a/b.md", "src/z.ts")
    s = {(x["path"], x["start"], x["end"]) for x in markdown.sections(d).collect()}
    assert s == {("docs/a/b.md", 1, 6), ("docs/a/b.md", 7, 12), ("docs/a/b.md", 13, 15), ("plain.md", 1, 2)}


def test_parsers():
    py = parsers.parse("m.py", "class A:\n    def f(self):\n        if x:\n            g()\n        return h()\nimport a.b\nfrom .c import d\n", "python")
    assert [(r[1], r[2]) for r in py if r[1] in ("class", "method")] == [("class", "A"), ("method", "f")]
    assert {(r[2], r[8]) for r in py if r[1] == "call"} == {("g", True), ("h", False)} and {r[7] for r in py if r[1] == "import"} == {"a.b", ".c"}
    ts = parsers.parse("m.ts", "import {a} from './x'\nexport function f(a) {\n  if (a) {\n  }\n}\nexport class K {}\ninterface I { }\nconst z = (q) => q\n", "typescript")
    assert [(r[1], r[2], r[4], r[5]) for r in ts] == [("import", "./x", 1, 1), ("function", "f", 2, 5), ("class", "K", 6, 6), ("interface", "I", 7, 7), ("function", "z", 8, 9)]
    assert [r[2] for r in parsers.parse("m.go", "func (s *S) Run() {\n}\ntype S struct {\n}\n", "go")] == ["Run", "S"]
    assert parsers.parse("bad.py", "def (", "python") == []


def test_chunks_and_manifests(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "\n".join(["x = 1"] * 120)), ("package.json", '{"dependencies": {"z": "1", "a": "2"}}'), ("requirements.txt", "numpy==1\n# c\npandas>=2\n"), ("go.mod", "module m\nrequire example.org/q v1\n")], "path string, text string")
    code = files.filter("path like '%.py'")
    assert {x["chunk_id"] for x in parsers.chunk_code(code, parsers.parse_files(code)).collect()} == {"a.py:1-2", "b.py:1-50", "b.py:51-100", "b.py:101-120"}
    assert [x["dependency"] for x in parsers.manifest_dependencies(files).collect()] == ["a", "example.org/q", "numpy", "pandas", "z"]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.normalize_path(F.lit("a/../b/./c//d")).alias("p"), text.normalize_path(F.lit("../x/../../y")).alias("up"), text.normalize_path(F.lit("/../a")).alias("root"), text.slug(F.lit("Hello, World! -x-")).alias("slug"),
        text.normalize_url(F.lit("git@Host.org:Me/Repo.git")).alias("ssh"), text.normalize_url(F.lit("https://tok@host.org/me/repo")).alias("https"), text.version_key(F.lit("1.x.3")).alias("v"), text.extname(F.lit("a/.env")).alias("dot"),
        text.commit_parts(F.lit("feat(api)!: add x"))["scope"].alias("scope"), text.diff_stats(F.lit("--- a/x\n+++ b/x\n+1\n+2\n-3\n"))["added"].alias("added"), text.format_bytes(F.lit(1536)).alias("kb"),
    ).first()
    assert tuple(row) == ("b/c/d", "../../y", "/a", "hello-world-x", "host.org/me/repo", "host.org/me/repo", [1, 0, 3], "", "api", 2, "1.5 KB")


def test_degrees_and_density(spark):
    symbols = spark.createDataFrame([("a", "function"), ("b", "function"), ("c", "class")], "qualified_name string, kind string")
    calls = edges_of(spark, [("a", "b"), ("c", "b"), ("b", "a")])
    assert {(x["qualified_name"], x["total"]) for x in aggregates.hubs(symbols, calls, 2).collect()} == {("a", 2), ("b", 3)}
    assert [x["qualified_name"] for x in aggregates.hot_spots(symbols, calls, "function").collect()] == ["b", "a"]
    assert spark.range(1).select(aggregates.density_class(F.lit(31), F.lit(10)).alias("x")).first()["x"] == "hybrid"
    assert hybrid.auto_budget(100, {"a": 0.4, "b": 0.2, "c": 0.4}, ["a", "b"]) == {"a": 66, "b": 33}


def test_portable_files(spark):
    where = shared_path(spark, "t")
    assert portable.read_rows(spark, where, portable.NODE_SCHEMA).count() == 0
    portable.write_rows(spark.createDataFrame([("file:a", "file:b", "imports"), ("file:a", "sym:gone", "calls")], portable.EDGE_SCHEMA), f"{where}/e")
    portable.write_rows(spark.createDataFrame([("file:a", "file", "a", "a", None), ("file:b", "file", "b", "b", None)], portable.NODE_SCHEMA), f"{where}/n")
    found, edges = portable.load(spark, f"{where}/n", f"{where}/e")
    assert {x["id"] for x in found.collect()} == {"a", "b"} and [tuple(x) for x in edges.collect()] == [("a", "b", "imports")]


def test_text_files_skip_binaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hé\n")
    (tmp_path / "b.bin").write_bytes(b"x\x00y")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe")
    assert [x["text"] for x in portable.text_files(spark, str(tmp_path)).collect()] == ["hé\n"]
