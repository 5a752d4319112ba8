"""The code-knowledge graph as DataFrames, derived from the star-schema tables.

`Graph` makes each table when it is first asked for.  `CTES` defines the same tables in DuckDB SQL, for
the SQL twins of the queries.

symbol = part, file = brand/type, call = a line item to the next one of its order, commit = order,
modification = order's lines per file, document = text document, vector = embedding, session turn =
conversation turn, requirement group = region, requirement = nation, implementation = customer.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.staging import cut

#: Languages of the derived files, symbol kinds and document types in their order of use.
LANGUAGES = ["python", "typescript", "go", "rust", "java"]
KINDS = ["function", "method", "class", "interface"]
DOC_TYPES = ["api_doc", "guide", "adr", "requirement"]


def pick(values: list[str], number: Column) -> Column:
    """The value at a number from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (number + 1).cast("int"))


class Graph:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def symbols(self) -> DataFrame:
        key = F.col("p_partkey")
        start = (key % 50) * 10 + 1
        return self.table("part").select(
            F.concat(F.lit("part:"), key.cast("string")).alias("qualified_name"), F.col("p_name").alias("name"), pick(KINDS, F.col("p_size") % 4).alias("kind"),
            F.concat_ws("/", "p_brand", "p_type").alias("file"), start.alias("start_line"), (start + F.col("p_size")).alias("end_line"), F.col("p_size").cast("long").alias("complexity"),
            F.concat(F.col("p_name"), F.lit("("), (key % 5).cast("string"), F.lit(")")).alias("signature"), F.concat(F.col("p_name"), F.lit(". Of type "), F.col("p_type"), F.lit("!")).alias("docstring"),
            pick(["public", "private", "internal"], key % 3).alias("visibility"),
        )

    @cached_property
    def files(self) -> DataFrame:
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        return self.table("part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("path")).agg(
            F.first(pick(LANGUAGES, number % 5)).alias("language"), F.count("*").alias("symbol_count"),
            F.sum("p_size").cast("long").alias("complexity"), (F.sum("p_size") * 10).cast("long").alias("lines_of_code"), F.max("p_partkey").alias("updated_at"),
        )

    @cached_property
    def defines(self) -> DataFrame:
        return self.symbols.select(F.col("file").alias("src"), F.col("qualified_name").alias("dst"), F.col("start_line").alias("line"))

    @cached_property
    def calls(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        name = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
        pairs = self.table("lineitem").select("l_partkey", F.lead("l_partkey").over(order).alias("next")).filter("next is not null")
        return pairs.groupBy("l_partkey", "next").agg(F.count("*").alias("call_count")).select(name("l_partkey").alias("src"), name("next").alias("dst"), "call_count")

    def fixed(self) -> Graph:
        """This graph with its calls computed once, for queries that go over them several times."""
        self.calls = cut(self.calls)
        return self

    @cached_property
    def imports(self) -> DataFrame:
        home = self.symbols.select("qualified_name", "file")
        joined = self.calls.join(home.toDF("src", "src_file"), "src").join(home.toDF("dst", "dst_file"), "dst").filter("src_file != dst_file")
        return joined.groupBy(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.count("*").alias("weight"))

    @cached_property
    def inherits(self) -> DataFrame:
        kinds = self.symbols.select("qualified_name", "kind")
        joined = self.calls.join(kinds.toDF("src", "src_kind"), "src").join(kinds.toDF("dst", "dst_kind"), "dst")
        return joined.filter("src_kind = 'class' and dst_kind in ('class', 'interface')").select("src", "dst", F.when(F.col("dst_kind") == "interface", "implements").otherwise("extends").alias("type"))

    @cached_property
    def commits(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("sha"), F.concat(F.lit("author"), F.col("o_custkey").cast("string")).alias("author"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
            F.concat(pick(["feat", "fix", "docs", "chore"], F.col("o_orderkey") % 4), F.lit("(core): change "), F.col("o_orderkey").cast("string")).alias("message"),
        )

    @cached_property
    def modifies(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("path"))
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").cast("string").alias("sha"), "path").agg(
            F.sum(F.col("l_quantity").cast("long")).alias("insertions"), F.sum("l_linenumber").cast("long").alias("deletions")
        )

    @cached_property
    def documents(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), pick(DOC_TYPES, F.col("doc_id") % 4).alias("type"),
            F.when(F.col("doc_id") % 11 == 0, "archived").otherwise("active").alias("status"), F.array("lang", "source").alias("tags"), "lang", "doc_id", "text", F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"), "n_chars",
        )

    @cached_property
    def describes(self) -> DataFrame:
        """Each document describes the file of the symbol that has its number, if there is one."""
        home = self.symbols.select(F.col("qualified_name"), "file")
        return self.documents.select(F.col("path").alias("src"), F.concat(F.lit("part:"), F.col("doc_id").cast("string")).alias("qualified_name")).join(home, "qualified_name").select("src", F.col("file").alias("dst"))

    @cached_property
    def references(self) -> DataFrame:
        """Document n refers to document 7 n + 3 modulo 997, if there is one and it is another."""
        d = self.documents.select("doc_id", "path")
        return d.select(F.col("path").alias("src"), "doc_id", ((F.col("doc_id") * 7 + 3) % 997).alias("to")).join(d.toDF("to", "dst"), "to").filter("src != dst").select("src", "dst")

    @cached_property
    def turns(self) -> DataFrame:
        c = F.col("conv_id") * 13 + F.col("turn") * 5
        return self.table("conversations").select(
            F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_number"), F.substring(F.trim("text"), 1, 500).alias("summary"), F.col("role").alias("concern"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"), F.array(F.concat(F.lit("part:"), (c % 200).cast("string")), F.concat(F.lit("part:"), ((c + 1) % 200).cast("string"))).alias("symbols_referenced"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") % 5).alias("level"),
            pick(LANGUAGES, F.col("label") % 5).alias("language"), F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("qualified_name"), F.col("vec_id"),
        )

    @cached_property
    def requirements(self) -> DataFrame:
        return self.table("nation").select(F.col("n_name").alias("id"), F.concat(F.lit("prd"), F.col("n_regionkey").cast("string")).alias("prd_id"), F.col("n_nationkey").alias("number"), pick(["low", "medium", "high"], F.col("n_nationkey") % 3).alias("priority"))

    @cached_property
    def implementations(self) -> DataFrame:
        """Customers with an order implement their nation's requirement, if their balance is above 5000."""
        buyers = self.table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
        c = self.table("customer").filter("c_acctbal > 5000 and c_nationkey % 4 != 0").join(buyers, "c_custkey", "left_semi")
        return c.join(self.requirements, F.col("number") == F.col("c_nationkey")).select(F.concat(F.lit("part:"), F.col("c_custkey").cast("string")).alias("src"), F.col("id").alias("dst"))


def _sql_pick(values: list[str], number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number}) + 1]"


CTES = f"""WITH RECURSIVE symbols AS (SELECT 'part:' || p_partkey AS qualified_name, p_name AS name, {_sql_pick(KINDS, "p_size % 4")} AS kind, p_brand || '/' || p_type AS file,
  (p_partkey % 50) * 10 + 1 AS start_line, (p_partkey % 50) * 10 + 1 + p_size AS end_line, p_size::BIGINT AS complexity, p_name || '(' || (p_partkey % 5) || ')' AS signature,
  p_name || '. Of type ' || p_type || '!' AS docstring, {_sql_pick(["public", "private", "internal"], "p_partkey % 3")} AS visibility FROM part),
files AS (SELECT p_brand || '/' || p_type AS path, first({_sql_pick(LANGUAGES, "regexp_extract(p_brand, '([0-9]+)', 1)::INT % 5")}) AS language, count(*) AS symbol_count, sum(p_size)::BIGINT AS complexity,
  (sum(p_size) * 10)::BIGINT AS lines_of_code, max(p_partkey) AS updated_at FROM part GROUP BY 1),
defines AS (SELECT file AS src, qualified_name AS dst, start_line AS line FROM symbols),
call_pairs AS (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS next FROM lineitem),
calls AS (SELECT 'part:' || l_partkey AS src, 'part:' || next AS dst, count(*) AS call_count FROM call_pairs WHERE next IS NOT NULL GROUP BY l_partkey, next),
imports AS (SELECT a.file AS src, b.file AS dst, count(*) AS weight FROM calls c JOIN symbols a ON a.qualified_name = c.src JOIN symbols b ON b.qualified_name = c.dst WHERE a.file <> b.file GROUP BY 1, 2),
inherits AS (SELECT c.src, c.dst, CASE WHEN b.kind = 'interface' THEN 'implements' ELSE 'extends' END AS type FROM calls c JOIN symbols a ON a.qualified_name = c.src JOIN symbols b ON b.qualified_name = c.dst
  WHERE a.kind = 'class' AND b.kind IN ('class', 'interface')),
commits AS (SELECT o_orderkey::VARCHAR AS sha, 'author' || o_custkey AS author, epoch_ms(o_orderdate) AS timestamp, {_sql_pick(["feat", "fix", "docs", "chore"], "o_orderkey % 4")} || '(core): change ' || o_orderkey AS message FROM orders),
modifies AS (SELECT l_orderkey::VARCHAR AS sha, p_brand || '/' || p_type AS path, sum(l_quantity::BIGINT)::BIGINT AS insertions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
docs AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, {_sql_pick(DOC_TYPES, "doc_id % 4")} AS type, CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status, [lang, source] AS tags, lang, doc_id, text, sha256(text)[1:16] AS content_hash, n_chars FROM documents),
describes AS (SELECT d.path AS src, s.file AS dst FROM docs d JOIN symbols s ON s.qualified_name = 'part:' || d.doc_id),
refs AS (SELECT a.path AS src, b.path AS dst FROM docs a JOIN docs b ON b.doc_id = (a.doc_id * 7 + 3) % 997 WHERE a.path <> b.path),
turns AS (SELECT conv_id::VARCHAR AS session_id, turn AS turn_number, trim(text)[1:500] AS summary, role AS concern, conv_id * 1000 + turn AS timestamp,
  ['part:' || ((conv_id * 13 + turn * 5) % 200), 'part:' || ((conv_id * 13 + turn * 5 + 1) % 200)] AS symbols_referenced FROM conversations),
vectors AS (SELECT 'vec:' || vec_id AS id, embedding::DOUBLE[] AS embedding, label % 5 AS level, {_sql_pick(LANGUAGES, "label % 5")} AS language, 'part:' || vec_id AS qualified_name, vec_id FROM embeddings),
requirements AS (SELECT n_name AS id, 'prd' || n_regionkey AS prd_id, n_nationkey AS number, {_sql_pick(["low", "medium", "high"], "n_nationkey % 3")} AS priority FROM nation),
implementations AS (SELECT 'part:' || c_custkey AS src, id AS dst FROM customer JOIN requirements ON number = c_nationkey WHERE c_acctbal > 5000 AND c_nationkey % 4 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders))
"""


def twin(sql: str, more: str = "") -> str:
    """A query over the derived tables as one DuckDB statement; `more` adds tables (starting with a comma)."""
    return f"{CTES}{more}\n{sql}"
