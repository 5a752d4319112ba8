"""Portable files: JSONL nodes, edges and vectors, a manifest, source files, listings.

Files are written and read by Spark, so any store that it reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.model import Graph, twin
from graphloom.staging import shared_path

NODE_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("file", T.StringType()), T.StructField("updated", T.StringType())])
EDGE_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("type", T.StringType())])
VECTOR_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("text", T.StringType())])
MAX_BYTES = 1 << 20


def write_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSONL; mode overwrite or append."""
    rows.write.mode(mode).json(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSONL rows under a fixed schema; a missing path is an empty table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def iso_time(value: Column) -> Column:
    """Epoch milliseconds as an ISO string, null kept."""
    return F.date_format(F.timestamp_millis(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def export_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols with prefixed ids."""
    f = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"), F.col("path").alias("file"), iso_time(F.col("updated_at") * 1000).alias("updated"))
    s = symbols.select(F.concat(F.lit("sym:"), "qualified_name").alias("id"), F.lit("symbol").alias("type"), "name", "file", F.lit(None).cast("string").alias("updated"))
    return f.unionByName(s)


def export_edges(calls: DataFrame, imports: DataFrame, defines: DataFrame) -> DataFrame:
    e = lambda df, a, b, kind: df.select(F.concat(F.lit(a), "src").alias("source"), F.concat(F.lit(b), "dst").alias("target"), F.lit(kind).alias("type"))
    return e(calls, "sym:", "sym:", "calls").unionByName(e(imports, "file:", "file:", "imports")).unionByName(e(defines, "file:", "sym:", "contains"))


def strip_prefix(id_: Column) -> Column:
    return F.regexp_replace(id_, "^(file|sym|prd|chunk):", "")


def load(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """Portable files back to nodes and edges without prefixes; edges without both ends are dropped."""
    nodes = read_rows(spark, nodes_path, NODE_SCHEMA)
    edges = read_rows(spark, edges_path, EDGE_SCHEMA)
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.withColumn("id", strip_prefix(F.col("id"))), edges.select(strip_prefix(F.col("source")).alias("src"), strip_prefix(F.col("target")).alias("dst"), "type")


def storage_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).withColumn("of", F.lit("nodes"))
    return n.unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).withColumn("of", F.lit("edges")))


def page(rows: DataFrame, key: str, offset: int = 0, limit: int = 100) -> DataFrame:
    return rows.orderBy(key).offset(offset).limit(limit)


def text_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, text of files that are text: at most 1 MB, no NUL byte, valid UTF-8."""
    raw = spark.read.format("binaryFile").load(glob).filter(F.col("length") <= MAX_BYTES)
    head = F.expr("substring(content, 1, 8192)")
    return raw.filter(F.is_valid_utf8(F.col("content").cast("string")) & (F.position(F.lit("00"), F.regexp_replace(F.hex(head), "(..)", "$1 ")) == 0)).select("path", F.col("content").cast("string").alias("text"))


def listing_hashes(lines: DataFrame) -> DataFrame:
    """mode hash stage<TAB>path lines to path and hash."""
    return lines.select(F.regexp_extract("value", r"\t(.*)$", 1).alias("path"), F.regexp_extract("value", r"^\d+ ([0-9a-f]+)", 1).alias("hash"))


def manifest(nodes: DataFrame, edges: DataFrame, version: str = "1.0.0") -> DataFrame:
    """One row: version, counts and the types that are there."""
    n = nodes.agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("node_types"))
    return n.join(edges.agg(F.count("*").alias("edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("edge_types"))).withColumn("version", F.lit(version))


def needs_sync(old: Column, new: Column) -> Column:
    return old.isNull() | (old != new)


def _round_trip(g: Graph) -> tuple[DataFrame, DataFrame]:
    where = shared_path(g.spark, "portable")
    write_rows(export_nodes(g.files, g.symbols), f"{where}/nodes")
    write_rows(export_edges(g.calls, g.imports, g.defines), f"{where}/edges")
    return load(g.spark, f"{where}/nodes", f"{where}/edges")


def _vectors(g: Graph) -> DataFrame:
    where = shared_path(g.spark, "vectors")
    rows = g.vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("qualified_name").alias("text"))
    write_rows(rows.filter("vec_id < 100"), where)
    write_rows(rows.filter("vec_id >= 100"), where, "append")
    return read_rows(g.spark, where, VECTOR_SCHEMA)


def _lines(g: Graph) -> DataFrame:
    return g.documents.select(F.concat(F.lit("100644 "), "content_hash", F.lit(" 0\t"), "path").alias("value"))


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


QUERIES = {
    "export_all": _q(lambda g: export_nodes(g.files, g.symbols)),
    "scan_edges": _q(lambda g: export_edges(g.calls, g.imports, g.defines)),
    "load_all": _q(lambda g: _round_trip(g)[1]),
    "src_jsonl_nodes": _q(lambda g: _round_trip(g)[0].select("id", "type", "name")),
    "src_jsonl_vectors": _q(lambda g: _vectors(g).select("id", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))),
    "src_vectors_page": _q(lambda g: page(g.vectors.select("id", "level"), "id", 100, 50)),
    "storage_stats": _q(lambda g: storage_stats(export_nodes(g.files, g.symbols), export_edges(g.calls, g.imports, g.defines))),
    "manifest": _q(lambda g: manifest(export_nodes(g.files, g.symbols), export_edges(g.calls, g.imports, g.defines))),
    "src_git_hashes": _q(lambda g: listing_hashes(_lines(g))),
    "src_git_commits": _q(lambda g: g.commits.orderBy(F.desc("timestamp"), "sha").limit(10).select("sha", "author")),
    "src_git_commit_files": _q(lambda g: g.modifies.filter("sha = '7'").select("path")),
    "src_git_file_history": _q(lambda g: g.modifies.filter("path = 'Brand#7/PROMO'").select("sha")),
    "src_git_diff": _q(lambda g: g.modifies.filter("sha in ('7', '8')").groupBy("path").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))),
    "raw_sql": _q(lambda g: g.spark.sql("SELECT qualified_name, name FROM {s} WHERE kind = :kind AND complexity > :least", args={"kind": "class", "least": 45}, s=g.symbols)),
    "scan_label": _q(lambda g: g.symbols.filter("kind = 'interface'").select("qualified_name")),
    "prd_import": _q(lambda g: g.requirements.select(F.concat(F.lit("chunk:"), "id").alias("id"), "prd_id").select(strip_prefix(F.col("id")).alias("id"), "prd_id")),
}
_EX = ", ex AS (SELECT 'file:' || path AS id, 'file' AS type, path AS name, path AS file, strftime(epoch_ms(updated_at * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated FROM files UNION ALL SELECT 'sym:' || qualified_name, 'symbol', name, file, NULL FROM symbols), ee AS (SELECT 'sym:' || src AS source, 'sym:' || dst AS target, 'calls' AS type FROM calls UNION ALL SELECT 'file:' || src, 'file:' || dst, 'imports' FROM imports UNION ALL SELECT 'file:' || src, 'sym:' || dst, 'contains' FROM defines)"
ORACLES = {k: twin(v) for k, v in {
    "export_all": _EX + " SELECT * FROM ex",
    "scan_edges": _EX + " SELECT * FROM ee",
    "load_all": _EX + " SELECT regexp_replace(source, '^(file|sym):', '') AS src, regexp_replace(target, '^(file|sym):', '') AS dst, type FROM ee",
    "src_jsonl_nodes": _EX + " SELECT regexp_replace(id, '^(file|sym):', '') AS id, type, name FROM ex",
    "src_jsonl_vectors": "SELECT id, len(embedding)::INT AS size, round(embedding[1], 5) AS first FROM vectors",
    "src_vectors_page": "SELECT id, level FROM vectors ORDER BY id LIMIT 50 OFFSET 100",
    "storage_stats": _EX + " SELECT type, count(*) AS n, 'nodes' AS of FROM ex GROUP BY type UNION ALL SELECT type, count(*), 'edges' FROM ee GROUP BY type",
    "manifest": _EX + " SELECT (SELECT count(*) FROM ex) AS nodes, 'file,symbol' AS node_types, (SELECT count(*) FROM ee) AS edges, 'calls,contains,imports' AS edge_types, '1.0.0' AS version",
    "src_git_hashes": "SELECT path, content_hash AS hash FROM docs",
    "src_git_commits": "SELECT sha, author FROM commits ORDER BY timestamp DESC, sha LIMIT 10",
    "src_git_commit_files": "SELECT path FROM modifies WHERE sha = '7'",
    "src_git_file_history": "SELECT sha FROM modifies WHERE path = 'Brand#7/PROMO'",
    "src_git_diff": "SELECT path, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions FROM modifies WHERE sha IN ('7', '8') GROUP BY path",
    "raw_sql": "SELECT qualified_name, name FROM symbols WHERE kind = 'class' AND complexity > 45",
    "scan_label": "SELECT qualified_name FROM symbols WHERE kind = 'interface'",
    "prd_import": "SELECT id, prd_id FROM requirements",
}.items()}
