"""Word search over whole texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token): distinct lower-case words of letters and digits."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("([\\p{L}\\p{N}]+)"), 1))
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("token"))


def holds(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """For every term, some word in some of the columns begins with it. Decided within the row, one pattern a term."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for t in terms:
        out = out & text.rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{t.lower()}\E")
    return out


def search(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """Ids of documents that hold, for every term, a word beginning with it. One scan, no shuffle; rows that share an id
    count each by its own text."""
    return docs.where(holds([text_col], terms)).select(F.col(id_col).alias("id"))


def write_index(docs: DataFrame, id_col: str, fields: Sequence[str], path: str) -> None:
    """A stored word index in a folder: rows (field, token, id) of the words of each field, dealt by ranges of tokens and
    sorted, so that a search reads only the row groups that may hold its words. More documents are added by writing to the
    same folder again; a null field has no words."""
    parts = [docs.select(F.lit(f).alias("field"), F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(f), F.lit("([\\p{L}\\p{N}]+)"), 1))).alias("token")) for f in fields]
    rows = reduce(DataFrame.unionByName, parts).select("field", "token", "id")
    rows.repartitionByRange("token", "field").sortWithinPartitions("token", "field", "id").write.mode("append").parquet(path)


def search_index(spark: SparkSession, path: str, terms: Sequence[str], field: str | None = None) -> DataFrame:
    """Ids that hold, for every term, a word beginning with it, in the field or in any. Each term is a range of tokens, which
    reaches the scan; ids of all terms meet in one aggregation. Without terms nothing is found."""
    wanted = sorted({t.lower() for t in terms if t})
    index = spark.read.parquet(path)
    if field is not None:
        index = index.where(F.col("field") == field)
    inside = lambda t: (F.col("token") >= t) & (F.col("token") < t + "\U0010ffff")
    hits = [index.where(inside(t)).select("id", F.lit(i).alias("term")) for i, t in enumerate(wanted)]
    if not hits:
        return index.select("id").limit(0)
    by = reduce(DataFrame.union, hits).groupBy("id").agg(F.countDistinct("term").alias("n"))
    return by.where(F.col("n") == len(wanted)).select("id")
