"""Spelling: the nearest dictionary word within one edit, by keys made of deletions rather than by comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lexicon(texts: DataFrame, text: str) -> DataFrame:
    """Words in lower case with how often they stand in the texts: term, freq."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")
    return texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def deletions(word: Column) -> Column:
    """The word and every form of it with one character less."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def nearest(words: DataFrame, word: str, terms: DataFrame) -> DataFrame:
    """For each distinct word the best term within one edit: closest, then most frequent, then first by letters."""
    asked = words.select(F.col(word).alias("word")).distinct().select("word", F.explode(deletions(F.col("word"))).alias("_k"))
    known = terms.select("term", "freq", F.explode(deletions(F.col("term"))).alias("_k"))
    both = asked.join(known, "_k").select("word", "term", "freq").distinct()
    both = both.withColumn("distance", F.levenshtein("word", "term")).where("distance <= 1")
    best = F.min_by(F.struct("term", "distance", "freq"), F.struct("distance", -F.col("freq"), "term"))
    return both.groupBy("word").agg(best.alias("_b")).select("word", "_b.*")


def cased(original: Column, corrected: Column) -> Column:
    """The correction in the original's case: all capitals, a first capital, or as it is."""
    upper = (original == F.upper(original)) & (original != F.lower(original))
    title = (F.substring(original, 1, 1) == F.upper(F.substring(original, 1, 1))) & (F.substring(original, 1, 1) != F.lower(F.substring(original, 1, 1)))
    return F.when(upper & (F.length(original) > 1), F.upper(corrected)).when(title, F.concat(F.upper(F.substring(corrected, 1, 1)), F.substring(corrected, 2, 1 << 20))).otherwise(corrected)


def correct_lines(lines: DataFrame, key: str, text: str, terms: DataFrame, strip_punctuation: bool = True) -> DataFrame:
    """Lines with every word replaced by its nearest term: key, corrected."""
    spots = lines.select(key, F.posexplode(F.split(text, " ")).alias("i", "w"))
    edge = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$" if strip_punctuation else r"^$"
    spots = spots.withColumn("bare", F.regexp_replace("w", edge, "")).withColumn("low", F.lower("bare"))
    fixed = spots.join(nearest(spots.where("low <> ''"), "low", terms).select(F.col("word").alias("low"), "term"), "low", "left")
    word = F.when(F.col("term").isNull(), F.col("w")).otherwise(
        F.concat(F.regexp_extract("w", r"^[^\p{L}\p{N}_]*", 0), cased(F.col("bare"), F.col("term")), F.regexp_extract("w", r"[^\p{L}\p{N}_]*$", 0))
    )
    parts = F.sort_array(F.collect_list(F.struct("i", word.alias("w"))))
    return fixed.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["w"]), " ").alias("corrected"))


