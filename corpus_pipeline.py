"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes the rows its predecessor kept and returns the columns of documents; the last returns the packed
pieces with their places. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common, line_dedup, packing, quality, span_dedup
from galley.llm.jaccard import JaccardJoin


ROW = "__galley_row"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier keeps. Null and empty texts are scored like any other; rows that share an id are judged
    each by its own text, of any length; an empty table stays empty."""
    found = quality.classify_documents(docs, common.read(spark, sf_dir, "labels"))
    return found.where("keep").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated multi-line chunks. Null and empty texts pass, long ones are cut whole; every row stays."""
    return line_dedup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, five-word shingles and a similarity of 0.8: that of least id, rows without
    an id last. Each row counts alone, whether or not others share its id. Rows without words have no copies and stay; texts
    may be of any length; an empty table stays empty. docs must have no column named as ROW."""
    rows = common.materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    groups = JaccardJoin(rows, ROW, k=5, num=4, den=5).groups()
    groups = common.materialize(groups.select(F.col("id").alias(ROW), "component"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)
    many = groups.groupBy("component").count().where("count > 1").select("component")
    groups = common.materialize(groups.join(common.large(many), "component", "left_semi"), "copies")
    named = rows.select(ROW, "doc_id").join(common.large(groups), ROW)
    first = named.groupBy("component").agg(F.min(order)[ROW].alias("first"))
    late = common.materialize(groups.join(common.large(first), "component").where(F.col(ROW) != F.col("first")).select(ROW), "late")
    return rows.join(late, ROW, "left_anti").select(*docs.columns)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that repeated spans cover. Null and empty texts pass, long ones are cut whole; every row
    stays."""
    return span_dedup.span_dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, each with its sequence and offset. A null or empty text is one piece of one id, a long
    one as many pieces as it needs; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("spans", repeated_spans),
    ("packing", packed),
]
#: The classifier and the packing are no SQL; tests/llm/test_pipeline.py holds all rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
