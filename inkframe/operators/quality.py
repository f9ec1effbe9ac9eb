"""Diagnostics of recognised pages: per line, per page and per group, and checks of labelled data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import text as T


def as_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: line_index from 0, and line."""
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_index", "line"))


def line_measures(lines: DataFrame, line: str = "line") -> DataFrame:
    """Counts that add up over lines, and the flags of each line."""
    t, digits = F.col("_spaced"), F.col("_digit")
    # spaced once, and rules about digits and capitals only where there are any (two capitals are two of \\p{Lu}, which is one look in a table)
    out = lines.withColumn("_spaced", T.spaced(F.col(line)))
    out = out.withColumns({"_digit": t.rlike(r"\p{Nd}"), "_solid": F.length(F.replace(t, F.lit(" "), F.lit("")))})
    out = out.withColumn("_suspicious", F.when(digits, T.suspicious_tokens(t)))
    out = out.withColumns(
        {
            "n_suspicious": F.when(digits, F.size("_suspicious")).otherwise(0),
            "n_digits": F.when(digits, T.digit_count(F.col(line))).otherwise(0),
            "n_noise_digits": F.when(digits, T.digits_of(F.col("_suspicious"))).otherwise(0),
            "n_abnormal": F.regexp_count(t, F.lit(rf"(?U)[^{T.EXPECTED}]")),
            "n_visible": F.col("_solid"),
            "n_capitals": F.when(t.rlike(r"\p{Lu}{2}"), F.size(T.capital_tokens(t))).otherwise(0),
            "n_tokens": F.when(t == "", 0).otherwise(1 + F.length(t) - F.col("_solid")),
            "n_repeated": F.when(digits, F.size(T.repeated_numbers(t))).otherwise(0),
            "is_garbage": T.is_garbage(F.col(line)),
        }
    ).drop("_spaced", "_digit", "_solid", "_suspicious")
    rate = F.when(F.col("n_digits") > 0, F.col("n_noise_digits") / F.col("n_digits")).otherwise(0.0)
    odd = F.when(F.col("n_visible") > 0, F.col("n_abnormal") / F.col("n_visible")).otherwise(0.0)
    return out.withColumns(
        {
            "noise_rate": rate,
            "is_hallucinated": (F.length(line) > 0)
            & ((F.col("n_capitals") >= 1) | (F.col("n_repeated") >= 1) | (odd > 0.05) | (F.col("n_suspicious") >= 1)),
        }
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def diagnostics(lines: DataFrame, *keys: str) -> DataFrame:
    """The thirteen page measures by `keys`, from measures of lines: sums first, so that partial sums are shuffled.

    Repeated numbers aren't additive: `page_repeats` measures those of a whole page, here if lines carry it as `page_repeats`.
    """
    repeats = [F.max("page_repeats").cast("long").alias("repeated_number_sequence_count")] if "page_repeats" in lines.columns else []
    s = lambda c: F.sum(F.col(c).cast("long"))
    sums = lines.groupBy(*keys).agg(
        F.count("*").alias("line_count"),
        (F.sum(F.length("line")) + F.count("*") - 1).alias("char_count"),
        s("n_noise_digits").alias("_noise"),
        s("n_digits").alias("_digits"),
        s("is_garbage").alias("_garbage"),
        F.sum((F.col("noise_rate") >= 0.20).cast("long")).alias("_high"),
        s("n_abnormal").alias("abnormal_symbol_count"),
        s("n_visible").alias("_visible"),
        s("n_suspicious").alias("suspicious_digit_token_count"),
        s("n_capitals").alias("uppercase_garbage_token_count"),
        s("n_tokens").alias("_tokens"),
        s("is_hallucinated").alias("hallucinated_line_count"),
        *repeats,
    )
    c = F.col
    return sums.select(
        *keys,
        "line_count",
        "char_count",
        ratio(c("_noise"), c("_digits")).alias("digit_noise_rate"),
        ratio(c("_garbage"), c("line_count")).alias("garbage_text_ratio"),
        ratio(c("_high"), c("line_count")).alias("high_digit_noise_line_rate"),
        ratio(c("abnormal_symbol_count"), c("_visible")).alias("abnormal_symbol_rate"),
        "abnormal_symbol_count",
        "suspicious_digit_token_count",
        "uppercase_garbage_token_count",
        ratio(c("uppercase_garbage_token_count"), c("_tokens")).alias("uppercase_garbage_token_rate"),
        *(["repeated_number_sequence_count"] if repeats else []),
        "hallucinated_line_count",
        ratio(c("hallucinated_line_count"), c("line_count")).alias("hallucinated_line_rate"),
    )


def page_repeats(pages: DataFrame, text: str = "text") -> Column:
    return F.size(T.repeated_numbers(F.col(text)))


def worst_lines(lines: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n noisiest lines of each page: noise, one more if hallucinated, only those above 0."""
    score = F.round(F.col("noise_rate") + F.col("is_hallucinated").cast("int"), 4)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "line_index")
    ranked = lines.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)


def verdict(noise: Column, garbage: Column, hallucinated: Column) -> Column:
    """improved, worsened or no_change, from the changes (after less before) of three rates."""
    score = hallucinated + 0.5 * garbage + 0.5 * noise
    return F.when(score < -0.01, "improved").when(score > 0.01, "worsened").otherwise("no_change")


def run_score(cer: Column, wer: Column, noise: Column, line_error: Column) -> Column:
    """The weighted score of a run over the parts that aren't null; null if all are."""
    parts = ((0.5, cer), (0.3, wer), (0.1, noise), (0.1, line_error))
    total = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def character_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.select(F.explode(F.split(F.coalesce(text, F.lit("")), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def gates(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row: how many texts break each rule of clean labels."""
    c = F.coalesce(F.col(text), F.lit(""))
    bad = {
        "n_rows": F.lit(True),
        "n_control": c.rlike(r"[\p{Cc}\p{Cf}]"),
        "n_double_space": c.contains("  "),
        "n_untrimmed": c != F.trim(c),
        "n_empty": c == "",
        "n_combining": c.rlike(T.COMBINING),
    }
    return documents.agg(*(F.count_if(v).alias(k) for k, v in bad.items()))
