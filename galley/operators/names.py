"""Canonical names of ingredients, by joins with vocabulary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import nouns
from galley.functions.classify import folded

#: Kinds of vocabulary rows (kind, key, target): 'exact' and 'synonym' map a phrase to a name, 'noun' is a name, 'noise' is a
#: word that says nothing about what a thing is.
KINDS = ("exact", "synonym", "noun", "noise")


def words(phrase: Column) -> Column:
    """Folded words of letters, digits and apostrophes, brackets left out."""
    bare = F.regexp_replace(folded(F.coalesce(phrase, F.lit(""))), r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.filter(F.split(F.regexp_replace(bare, "[^a-z0-9']+", " "), " "), lambda w: w != "")


def kept(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(phrase, rest): of each distinct phrase the singular words that are no noise, hyphens kept, in their order."""
    bare = F.regexp_replace(F.regexp_replace(folded(F.coalesce("phrase", F.lit(""))), r"\([^)]*\)", " "), "[^a-z0-9'\\- ]+", " ")
    word = F.transform(F.split(bare, " +"), lambda w: F.regexp_replace(w, "^[-']+|[-']+$", ""))
    noise = vocabulary.where("kind = 'noise'").select(F.col("key").alias("word"), F.lit(True).alias("noise")).distinct()
    parts = phrases.select("phrase").distinct().select("phrase", F.posexplode(word).alias("at", "word")).join(noise, "word", "left")
    own = F.when(F.col("noise").isNull() & (F.col("word") != ""), F.struct("at", nouns.singular(F.col("word")).alias("w")))
    return parts.groupBy("phrase").agg(F.array_sort(F.collect_list(own)).alias("own")).select("phrase", F.col("own.w").alias("rest"))


def _keys(vocabulary: DataFrame) -> DataFrame:
    """(kind, key, to): the vocabulary by the forms that phrases are looked up in."""
    to, text = F.coalesce("target", "key").alias("to"), lambda c: F.array_join(c, " ").alias("key")
    of = lambda kind: vocabulary.where(F.col("kind") == kind)
    bare = kept(of("synonym").select(F.col("key").alias("phrase")), vocabulary).where(F.size("rest") > 0)
    rows = [
        of("exact").select(F.lit("exact").alias("kind"), text(words(F.col("key"))), to),
        of("synonym").select(F.lit("plain").alias("kind"), text(words(F.col("key"))), to),
        of("synonym").select(F.lit("synonym").alias("kind"), text(F.transform(words(F.col("key")), nouns.singular)), to),
        bare.join(of("synonym").withColumnRenamed("key", "phrase"), "phrase").select(F.lit("bare").alias("kind"), text("rest"), F.col("target").alias("to")),
        of("noun").select("kind", "key", to),
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("kind", "key").agg(F.min("to").alias("to"))


def canonical(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(phrase, canonical) of the distinct phrases, '' where nothing is left of one.

    In this order: the phrase in its own words is an exact or a synonym; its singular words are a synonym; what is left of
    it without noise is a synonym, a noun, or what is left of a synonym; it holds a noun of several words (the longest,
    then the first in the alphabet); its last word is a noun; else all that is left of it. A vocabulary may be of any
    size: every phrase is looked up in all its forms by one join on the key."""
    most = vocabulary.where("kind = 'noun'").agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
    text = lambda c: F.array_join(c, " ")
    own, rest = words(F.col("phrase")), F.col("rest")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(max(2, most))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("rest") - n + 1)), lambda i: text(F.slice("rest", i, n)))))
    runs = F.when(F.size("rest") > 1, F.filter(runs, lambda r: r.contains(" "))).otherwise(F.array().cast("array<string>"))
    form = lambda rank, kind, key: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))
    whole = text(rest)
    forms = F.array(
        form(0, "exact", text(own)), form(1, "plain", text(own)), form(2, "synonym", text(F.transform(own, nouns.singular))), form(3, "synonym", whole), form(4, "noun", whole),
        form(5, "bare", whole), form(7, "noun", F.coalesce(F.try_element_at(rest, F.lit(-1)), F.lit(""))), form(8, "", whole),
    )
    looked = F.concat(forms, F.transform(F.array_distinct(runs), lambda r: F.struct(F.lit(6).alias("rank"), F.lit("noun").alias("kind"), r.alias("key"))))
    rows = kept(phrases, vocabulary).select("phrase", F.explode(looked).alias("f")).select("phrase", "f.*").join(_keys(vocabulary), ["kind", "key"], "left")
    rows = rows.select("phrase", "rank", "key", F.when(F.col("rank") == 8, F.col("key")).otherwise(F.col("to")).alias("to")).where("to is not null")
    return rows.groupBy("phrase").agg(F.min_by("to", F.struct("rank", -F.length("key"), "key")).alias("canonical"))


def parted(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(phrase, position, part, canonical): phrases parted at 'and' and '&', where every part is a known name; others whole."""
    rows = phrases.select("phrase").distinct().withColumn("parts", F.filter(F.split("phrase", r"(?i)\s+and\s+|\s*&\s*"), lambda p: F.trim(p) != ""))
    each = rows.select("phrase", F.posexplode("parts").alias("position", "part"))
    both = each.select(F.col("part").alias("phrase")).union(rows.select("phrase"))
    named = canonical(both, vocabulary)
    sure = vocabulary.where("kind in ('noun', 'synonym', 'exact')").select(F.coalesce("target", "key").alias("canonical")).distinct().withColumn("sure", F.lit(True))
    named = named.join(sure, "canonical", "left")
    found = each.join(named.withColumnRenamed("phrase", "part"), "part")
    ok = found.groupBy("phrase").agg((F.count("*") == F.count("sure")).alias("ok"), F.count("*").alias("n"))
    split = found.join(ok.where("ok and n > 1"), "phrase").select("phrase", "position", "part", "canonical")
    rest = rows.join(ok.where("not ok or n = 1"), "phrase", "left_semi").select("phrase").join(named, "phrase")
    return split.unionByName(rest.select("phrase", F.lit(0).alias("position"), F.col("phrase").alias("part"), "canonical"))
