"""Markdown as tables: front matter, headings, links, sections, document types, chunks.

Headings inside fenced code are left out and line numbers are those of the whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import slug
from graphloom.plans.model import Graph, twin

FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
KNOWN_KEYS = ["title", "type", "status", "priority", "author", "tags"]


def front_matter(text: Column) -> Column:
    """A map of the keys of the leading --- block, values unquoted; empty if there is none."""
    block = F.regexp_extract(text, FRONT, 1)
    pairs = F.transform(F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:")), lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[\w-]+:", "")), "^[\"']|[\"']$", "").alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))


def inline_array(value: Column) -> Column:
    """[a, b] as an array of strings; null if it is none."""
    items = F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.when(value.rlike(r"^\[.*\]$"), F.filter(items, lambda x: x != ""))


def lines(docs: DataFrame) -> DataFrame:
    """path, line (from 1), content, and whether the line is in fenced code or front matter."""
    fences = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(r"^\s*(```|~~~)"), i)), lambda i: i.isNotNull())
    head = F.size(F.split(F.regexp_extract("text", FRONT, 0), "\n")) - 1
    rows = docs.select("path", fences.alias("fences"), head.alias("head"), F.posexplode(F.split("text", "\n")).alias("n", "content"))
    open_ = F.size(F.filter("fences", lambda i: i < F.col("n"))) % 2 == 1
    return rows.select("path", (F.col("n") + 1).alias("line"), "content", (open_ | F.array_contains("fences", F.col("n")) | (F.col("n") < F.col("head"))).alias("inside"))


def headings(docs: DataFrame) -> DataFrame:
    """path, line, level, text and anchor of each heading."""
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    rows = lines(docs).filter(~F.col("inside") & F.col("content").rlike(pattern))
    text = F.regexp_extract("content", pattern, 2)
    return rows.select("path", "line", F.length(F.regexp_extract("content", pattern, 1)).alias("level"), text.alias("text"), slug(text).alias("anchor"))


def links(docs: DataFrame) -> DataFrame:
    """path, line, target, internal and code flags of inline links and bare URLs."""
    inline = F.transform(F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1), lambda x: x)
    bare = F.regexp_extract_all(F.regexp_replace("content", r"\[[^\]]*\]\([^)]*\)", " "), F.lit(r"(https?://[^\s)>\]]+)"), 1)
    rows = lines(docs).select("path", "line", F.explode(F.concat(inline, bare)).alias("target"))
    internal = ~F.col("target").rlike(r"^(https?:|mailto:)")
    return rows.withColumn("internal", internal).withColumn("code", internal & F.col("target").rlike(r"\.(ts|tsx|js|py|go|rs|java)(#.*)?$"))


def resolve_link(document: Column, target: Column) -> Column:
    """The path that an internal link names: #anchor is the document, / the root, else the document's folder."""
    from graphloom.functions.text import dirname, normalize_path

    bare = F.regexp_replace(target, "#.*$", "")
    joined = F.when(bare.startswith("/"), F.substring(bare, F.lit(2), F.length(bare))).otherwise(F.concat_ws("/", dirname(document), bare))
    return F.when(bare == "", document).otherwise(normalize_path(joined))


def sections(docs: DataFrame, depth: int = 2) -> DataFrame:
    """Parts of a document between headings of level <= depth, the part before the first one included."""
    last = docs.select("path", F.size(F.split("text", "\n")).alias("last"))
    heads = headings(docs).filter(F.col("level") <= depth).select("path", "line", "text")
    first = docs.select("path", F.lit(1).alias("line"), F.lit("").alias("text")).join(heads.filter("line = 1").select("path"), "path", "left_anti")
    w = Window.partitionBy("path").orderBy("line")
    rows = heads.unionByName(first).withColumn("end", F.lead("line").over(w) - 1).join(last, "path")
    rows = rows.select("path", F.col("line").alias("start"), F.coalesce("end", "last").alias("end"), F.col("text").alias("heading"))
    return rows.withColumn("id", F.concat(F.lit("doc:"), "path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


# Document types by the file's name, by its folder, and by what its text holds, the first that fits.
NAME_TYPES = [
    ("readme", r"^readme\.(md|markdown)$"), ("changelog", r"^(changelog|changes|history)\.md$"), ("adr", "^adr[-_]"), ("roadmap", "roadmap"), ("session_notes", "session|notes|summary"), ("phase_doc", "phase"),
    ("api_doc", "^(?=.*api).*(doc|ref)"), ("release_note", "^(?=.*release).*note"), ("guide", "guide|quickstart|getting-started"), ("tutorial", "tutorial"), ("reference", "reference"), ("guide", "setup|install"),
]
FOLDER_TYPES = [("adr", "/adr|/decisions"), ("guide", "/guides|/howto"), ("tutorial", "/tutorials"), ("api_doc", "/api|/reference"), ("design_spec", "/design|/architecture")]
TEXT_TYPES = [
    ("design_spec", ["# architecture", "## design", "## system design"]), ("api_doc", ["# api reference", "## endpoints", "## api methods"]), ("guide", ["## installation", "## getting started", "## prerequisites"]),
    ("adr", ["## status: accepted", "## status: deprecated"]), ("release_note", ["## what's new", "## release notes", "## breaking changes"]), ("technical_spec", ["## technical specification", "## implementation details"]),
]
#: Both of these make a text an adr as well.
ADR_PARTS = ["## decision", "## context"]


def document_type(path: Column, text: Column) -> Column:
    """The name decides, then the folder, then the text; all in lower case."""
    from graphloom.functions.text import dirname

    name, folder, low = F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), F.lower(dirname(path)), F.lower(text)
    tests = [(name.rlike(p), label) for label, p in NAME_TYPES] + [(folder.rlike(p), label) for label, p in FOLDER_TYPES]
    for label, phrases in TEXT_TYPES:
        found = low.contains(phrases[0])
        for x in phrases[1:]:
            found = found | low.contains(x)
        if label == "adr":
            found = found | (low.contains(ADR_PARTS[0]) & low.contains(ADR_PARTS[1]))
        tests.append((found, label))
    return F.coalesce(*[F.when(test, label) for test, label in tests], F.lit("unknown"))


def chunks(docs: DataFrame) -> DataFrame:
    """One chunk per section with its text."""
    text = F.array_join(F.slice(F.split("text", "\n"), F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    return docs.select("path", "text").join(sections(docs).select("path", "id", "start", "end"), "path").select("path", "id", text.alias("text"))


def derived(g: Graph) -> DataFrame:
    """Documents of the data made Markdown: front matter, two headings, a link and a fence around the whole text, in one line."""
    head = F.format_string("---\ntitle: Doc %d\ntags: [%s, \"x y\"]\n---\n# Title %d\n", "doc_id", "lang", "doc_id")
    body = F.regexp_replace("text", "[\n`~#-]", " ")
    return g.documents.select("path", F.concat(head, body, F.lit("\n```\n# no heading\n```\n## Part Two\nsee [x](../b/c.ts) and https://e.org/z\n"), F.repeat(F.lit("line\n"), (F.col("doc_id") % 4).cast("int"))).alias("text"), "doc_id")


#: Files and endings of the derived documents, in turn.
_FILES = ["README.md", "docs/changes.md", "adr-7.md", "x/Roadmap-2.md", "sessions.md", "phase_2.md", "api-docs.md", "release-note.md", "quickstart.md", "a/tutorial.md", "reference.md", "setup.md", "docs/adr/n.md", "x/howto/n.md", "y/api/n.md", "z/design/n.md", "z/n.md", "api/n.md"]
_TAILS = ["", "## Decision\n", "## Decision\n## Context\n", "## Endpoints\n", "## Prerequisites\n", "## What's new\n", "## Implementation details\n", "# Architecture\n"]


def _typed(d: DataFrame) -> DataFrame:
    turn = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return d.select("path", turn(_FILES, F.col("doc_id")).alias("file"), F.concat("text", turn(_TAILS, F.floor(F.col("doc_id") / len(_FILES)))).alias("text"))


def _q(f):
    return lambda spark, sf_dir: f(derived(Graph(spark, sf_dir)))


QUERIES = {
    "md_frontmatter": _q(lambda d: d.select("path", front_matter(F.col("text")).alias("m")).select("path", F.try_element_at("m", F.lit("title")).alias("title"), F.array_join(inline_array(F.try_element_at("m", F.lit("tags"))), "|").alias("tags"))),
    "md_headings": _q(headings),
    "md_links": _q(lambda d: links(d).withColumn("resolved", F.when(F.col("internal"), resolve_link(F.col("path"), F.col("target"))))),
    "md_sections": _q(sections),
    "md_type": _q(lambda d: _typed(d).select("path", document_type(F.col("file"), F.col("text")).alias("type"))),
    "md_chunks": _q(lambda d: chunks(d).select("id", F.length("text").alias("chars"))),
}
_D = ", md AS (SELECT path, doc_id, lang FROM docs)"
_END = "(11 + doc_id % 4)"
ORACLES = {k: twin(v) for k, v in {
    "md_frontmatter": _D + " SELECT path, 'Doc ' || doc_id AS title, lang || '|x y' AS tags FROM md",
    "md_headings": _D + " SELECT path, 5::INT AS line, 1::INT AS level, 'Title ' || doc_id AS text, 'title-' || doc_id AS anchor FROM md UNION ALL SELECT path, 10, 2, 'Part Two', 'part-two' FROM md",
    "md_links": _D + " SELECT path, 11::INT AS line, '../b/c.ts' AS target, true AS internal, true AS code, 'docs/b/c.ts' AS resolved FROM md UNION ALL SELECT path, 11, 'https://e.org/z', false, false, NULL FROM md",
    "md_sections": _D + " SELECT path, s::INT AS start, e::INT AS \"end\", h AS heading, 'doc:' || path || ':' || s || '-' || e AS id FROM (SELECT path, 1 AS s, 4 AS e, '' AS h FROM md UNION ALL SELECT path, 5, 9, 'Title ' || doc_id FROM md UNION ALL SELECT path, 10, 12 + doc_id % 4, 'Part Two' FROM md)",
    "md_type": _D + " SELECT path, coalesce(['readme', 'changelog', 'adr', 'roadmap', 'session_notes', 'phase_doc', 'api_doc', 'release_note', 'guide', 'tutorial', 'reference', 'guide', 'adr', 'guide', 'api_doc', 'design_spec', NULL, NULL][doc_id % 18 + 1], ['unknown', 'unknown', 'adr', 'api_doc', 'guide', 'release_note', 'technical_spec', 'design_spec'][doc_id // 18 % 8 + 1]) AS type FROM md",
    "md_chunks": _D + ", b AS (SELECT path, doc_id, lang, length(text) AS n FROM docs) SELECT 'doc:' || path || ':1-4' AS id, (3 + 1 + length('title: Doc ' || doc_id) + 1 + length('tags: [' || lang || ', \"x y\"]') + 1 + 3)::INT AS chars FROM b UNION ALL SELECT 'doc:' || path || ':5-9', (length('# Title ' || doc_id) + 1 + n + 1 + 3 + 1 + 12 + 1 + 3)::INT FROM b UNION ALL SELECT 'doc:' || path || ':10-' || (12 + doc_id % 4), (11 + 1 + 38 + 1 + 5 * (doc_id % 4))::INT FROM b",
}.items()}
