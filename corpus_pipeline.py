"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, segmentation.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents.  Between stages the rows are written as
Parquet in the shared folder and read again, so a lost executor costs at most one stage; what a stage
has read is removed once the next table is written.

Defined results, of all stages: an empty table stays empty; extra columns, whatever their names, pass
through all stages but the last; repeated rows and rows that share a doc_id are rows like others, except
where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, linestore, neardup, quality, scratch, segment


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go: null, empty and short texts among them.

    A null source has no host verdict; equal rows are judged and counted each; a null doc_id is no reason to go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents hold stay in one of them only, that with the largest doc_id; no row goes.

    Rows that share a doc_id count as one document; a row without a doc_id keeps its lines and is not counted; a null
    text stays null; n_chars is counted anew where lines went."""
    return linestore.filter_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, 0.8), that with the smallest doc_id.

    Of rows that share a doc_id one stays, that with the smallest text; rows without a doc_id all stay; texts without
    words are linked with nothing."""
    return neardup.filter_documents(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; items with a null id or text have none, an empty benchmark removes nothing."""
    return decontaminate.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, lossless and the sampled piece ids of each document; a null or empty text has no pieces."""
    import public_tokenizers

    return segment.sample(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sampled_pieces", sampled_pieces)]

#: Sampled segmentation can't be expressed in SQL; the tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = scratch.Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        since = scratch.mark()
        docs = tables.put(stage(spark, docs, sf_dir), name)
        scratch.sweep(since)
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
