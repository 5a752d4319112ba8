"""Queries see every row and whole texts: tables made here, with what earlier cuts left out."""

import random

import pytest

from graphloom import registry
from graphloom.functions import markdown
from graphloom.operators import knowledge, paths
from tests.test_library import brute_trails, edges_of, nodes


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def run(spark, folder, name):
    return registry.queries()[name](spark, str(folder)).collect()


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    rows = [(i, "word " * n + "see https://far.org/x", "en", "src1", 5 * n + 21) for i, n in ((1, 2), (299, 40), (300, 100), (5000, 200))]
    write(spark, folder, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    return folder


def test_markdown_has_all_documents_and_whole_texts(spark, documents):
    paths = {f"docs/src1/{i}.md" for i in (1, 299, 300, 5000)}
    for name in ("md_frontmatter", "md_headings", "md_links", "md_sections", "md_type"):
        assert {r["path"] for r in run(spark, documents, name)} == paths
    assert {r["path"] for r in run(spark, documents, "md_links") if r["target"] == "https://far.org/x"} == paths
    chars = {r["id"]: r["chars"] for r in run(spark, documents, "md_chunks")}
    fence = len("\n```\n# no heading\n```")
    assert {i: chars[f"doc:docs/src1/{i}.md:5-9"] for i in (1, 299, 300, 5000)} == {i: len(f"# Title {i}\n") + 5 * n + 21 + fence for i, n in ((1, 2), (299, 40), (300, 100), (5000, 200))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_between_sets_on_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(8)}", f"n{r.randrange(8)}") for _ in range(14)})
    for mode, limit in (("trail", 7), ("trail", 1000), ("simple", 3), ("simple", 1000)):
        all_ = [p for s in ("n0", "n1") for p in brute_trails(pairs, s, 5, mode == "simple") if p[-1] in ("n1", "n2")]
        want = sorted((len(p) - 1, ">".join(p)) for p in all_)[:limit]
        got = paths.paths_to(edges_of(spark, pairs), nodes(spark, "n0", "n1"), nodes(spark, "n1", "n2"), 5, limit, mode)
        assert [(x["length"], x["path"]) for x in got.collect()] == want
    every = [x["path"] for x in paths.cycles(edges_of(spark, pairs), 4, 1000).collect()]
    assert [x["path"] for x in paths.cycles(edges_of(spark, pairs), 4, 3).collect()] == every[:3]


def test_symbol_vectors_has_late_vectors(spark, tmp_path):
    write(spark, tmp_path, "part", [(i, f"p{i}", "Brand#1", "SMALL", 3) for i in (1, 199, 200, 450)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    write(spark, tmp_path, "embeddings", [(i, [1.0, 0.0], 1) for i in (1, 199, 200, 450, 451)], "vec_id long, embedding array<float>, label int")
    assert {r["id"] for r in run(spark, tmp_path, "symbol_vectors")} == {"vec:1", "vec:199", "vec:200", "vec:450"}


def test_space_and_xml_of_whole_texts(spark, documents, tmp_path):
    assert {r["doc_id"]: len(r["t"]) for r in run(spark, documents, "fn_fold_space")} == {1: 31, 299: 221, 300: 521, 5000: 1021}
    write(spark, tmp_path, "pages", [(1, "<b>" + "x" * 300 + "&")], "page_id long, html string")
    assert run(spark, tmp_path, "fn_escape_xml")[0]["x"] == "&lt;b&gt;" + "x" * 300 + "&amp;"


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """A ring of four files, and a chain of eight calls from a red widget to the only function."""
    folder = tmp_path_factory.mktemp("chain")
    parts = [(i, "red widget" if i == 1 else f"p{i}", "Brand#1", f"T{i % 4}", 4 if i == 9 else 5) for i in range(1, 10)]
    write(spark, folder, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    lines = [(1, i, i, 1, 1.0, 1.0) for i in range(1, 10)]
    write(spark, folder, "lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double")
    return folder


def test_long_paths_and_import_cycles(spark, chain):
    assert [r["length"] for r in run(spark, chain, "find_call_paths")] == [8]
    assert {(r["path"].count(">"), r["length"]) for r in run(spark, chain, "cycles_imports")} == {(4, 4)}


def test_all_paths_takes_six_steps(spark, monkeypatch, chain):
    monkeypatch.setattr(paths, "_busiest", lambda g: "part:1")
    monkeypatch.setattr(paths, "_far", lambda g: "part:7")
    assert [r["length"] for r in run(spark, chain, "all_paths")] == [6]


def test_neighborhood_by_distance_counts_a_large_hub(spark, tmp_path):
    n = 10_050
    spark.range(n + 1).selectExpr("id as p_partkey", "'p' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "5 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    pairs = spark.range(1, n + 1).selectExpr("id as l_orderkey", "explode(array(struct(0L as k, 1 as n), struct(id as k, 2 as n))) as x")
    pairs.selectExpr("l_orderkey", "x.k as l_partkey", "x.n as l_linenumber", "1L as l_suppkey", "1.0D as l_quantity", "1.0D as l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in run(spark, tmp_path, "neighborhood_by_distance")] == [(1, "CALLS", n)]


def test_summaries_of_a_ragged_tree(spark):
    """Files at the root, in a folder and below it, and a folder that only has a folder: it gets no row."""
    rows = [("r.py:f", "f", "function", "r.py", None, "public"), ("x:g", "g", "function", "a/x.py", "Gets it. More", "public"), ("y:h", "h", "class", "a/b/y.ts", "", "private"), ("z:k", "k", "method", "c/d/z.py", None, "private")]
    symbols = spark.createDataFrame([(q, n, k, f, d, v, f"{n}(alpha beta)") for q, n, k, f, d, v in rows], "qualified_name string, name string, kind string, file string, docstring string, visibility string, signature string")
    files = spark.createDataFrame([(f, "typescript" if f.endswith("ts") else "python") for *_, f, _, _ in rows], "path string, language string")
    got = {r["id"]: r for r in knowledge.summarize_all(symbols, files).collect()}
    assert {k: r["parent"] for k, r in got.items() if r["level"] > 1} == {
        "file:r.py": "repo:default", "file:a/x.py": "dir:a", "file:a/b/y.ts": "dir:a/b", "file:c/d/z.py": "dir:c/d", "dir:a": "repo:default", "dir:a/b": "dir:a", "dir:c/d": "dir:c",
    }
    assert (got["dir:a"]["symbols"], got["dir:a"]["languages"], got["dir:a"]["summary"]) == (2, ["python", "typescript"], "a module with 2 python, typescript files.")
    assert got["symbol:r.py:f"]["summary"] == "Function f in r.py." and got["symbol:x:g"]["summary"] == "Gets it." and got["symbol:x:g"]["keywords"] == ["alpha", "beta", "Gets", "More"]
    assert got["file:a/x.py"]["summary"] == "python file exporting g. Contains 1 symbol." and got["file:c/d/z.py"]["summary"] == "python file with 1 symbol."
    assert got["file:a/x.py"]["keywords"] == ["Gets", "More", "alpha", "beta"]


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("docs/README.md", "", "readme"), ("HISTORY.md", "", "changelog"), ("adr_1.md", "", "adr"), ("my-summary.md", "", "session_notes"), ("ApiRef.md", "", "api_doc"), ("install.md", "", "guide"), ("x/decisions/1.md", "", "adr"), ("adr/1.md", "", "unknown"),
        ("x.md", "## Decision", "unknown"), ("x.md", "## Decision\n## Context", "adr"), ("x.md", "## Status: Accepted", "adr"), ("x.md", "# API Reference", "api_doc"), ("x.md", "## What's New", "release_note"), ("x.md", "## System Design\n## Endpoints", "design_spec"),
    ],
)
def test_document_types(spark, path, text, kind):
    d = spark.createDataFrame([(path, text)], "path string, text string")
    assert d.select(markdown.document_type(d["path"], d["text"]).alias("t")).first()["t"] == kind
