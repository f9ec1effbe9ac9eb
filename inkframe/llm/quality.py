"""Line-first quality rules, as Spark expressions only.

Every line is judged on its own (punctuation, navigation, boilerplate); failing lines go, and a document that loses
more than `max_loss` of its characters is rejected. A few whole-text rules (too few words, too much repetition) come first.

Defined results: a null text counts as empty; an empty text has no words, so it fails the base rules; repeated rows give
repeated results; other columns of the input are ignored, whatever their names; an empty table gives an empty result.
All work is within a row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!-/:-@\[-`{-~]"
#: Fixed phrases that mark legal or site boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "enable javascript",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are sorted with their positions, so equal ones are neighbours: n log n for any length of text.
    """

    def covered(at: Column) -> Column:
        after = F.concat(F.slice(at, 2, F.size(at)), F.array(F.element_at(at, -1) + 3))
        return F.aggregate(F.zip_with(at, after, lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda s, x: s + x)

    def positions(rows: Column) -> Column:
        def twin(row: Column, k: Column) -> Column:
            left, right = F.get(rows, k - 1)["g"], F.get(rows, k + 1)["g"]
            return F.coalesce(row["g"] == left, F.lit(False)) | F.coalesce(row["g"] == right, F.lit(False))

        return F.sort_array(F.transform(F.filter(rows, twin), lambda r: r["i"]))

    def windows(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))

    def hashes(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def inner(rows: Column) -> Column:
        return F.slice(rows, 1, F.size(rows) - 2)

    def ordered(grams: Column) -> Column:
        return F.sort_array(F.transform(inner(grams), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def count(w: Column) -> Column:
        return let(let(let(windows(w), ordered), positions), covered)

    def whole(w: Column) -> Column:
        # equal windows have equal hashes: where no hash repeats, nothing does, and the windows needn't be built
        repeats = let(hashes(w), lambda h: F.size(F.array_distinct(inner(h))) < F.size(h) - 2)
        return F.when(F.size(w) < 3, 0).when(repeats, count(w)).otherwise(0)

    # bound to a lambda variable: a filter pushed below must not put the splitting of the text inside the loops
    return let(ws, whole).cast("long")


def bad_line(line: Column) -> Column:
    """A line that fails: mostly punctuation, a navigation bar, or short boilerplate."""
    n = F.length(line)
    marks = F.regexp_count(line, F.lit(MARKS))
    bars = F.regexp_count(line, F.lit(r"[|>]"))

    def boilerplate(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | low.contains(p)
        return found

    return (
        F.when(marks * 6 > n, F.lit(True))
        .when(line.contains("|") | line.contains(">"), (bars >= 3) & (bars * 24 > n))
        .when(n <= 200, let(F.lower(line), boilerplate))
        .otherwise(F.lit(False))
    )


def rate_documents(
    docs: DataFrame, min_words: int = 50, max_repeat: tuple[int, int] = (50, 100), max_loss: tuple[int, int] = (1, 2)
) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, the characters lost with failing lines, and kept.

    `max_repeat` and `max_loss` are fractions (numerator, denominator): above them a document is rejected.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        "t",
        words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    lost = F.aggregate(
        "lines", F.lit(0).cast("long"), lambda s, x: s + F.when(bad_line(x), F.length(x)).otherwise(0).cast("long")
    )
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x).cast("long"))
    counted = parts.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        lost.alias("lost_chars"),
        total.alias("line_chars"),
    )
    failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * max_repeat[1] > F.col("n_words") * max_repeat[0]
    )
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("lost_chars") * max_loss[1] <= F.col("line_chars") * max_loss[0])
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents with their failing lines removed (`clean_text`), beside the text they came from."""
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~bad_line(x))
    return docs.select("doc_id", F.array_join(kept, "\n").alias("clean_text"))
