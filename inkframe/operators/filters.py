"""Filters with reasons, coercions, top lists and run summaries: row expressions and one aggregate each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crop_reason(width: Column, height: Column, least: tuple[float, float] = (80, 18), aspects: tuple[float, float] = (2, 35)) -> Column:
    """Why a crop is left out, first reason first: invalid_image, too_small, bad_aspect; null if it stays."""
    aspect = width / height
    return (
        F.when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), "invalid_image")
        .when((width < least[0]) | (height < least[1]), "too_small")
        .when((aspect < aspects[0]) | (aspect > aspects[1]), "bad_aspect")
    )


def split_by_reason(rows: DataFrame, reason: Column, name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows left out with their reason)."""
    told = rows.withColumn(name, reason)
    return told.where(F.col(name).isNull()).drop(name), told.where(F.col(name).isNotNull())


def quality_flags(width: Column, height: Column, thin: float = 18, widest: float = 55) -> Column:
    """Sorted distinct flags of a crop: too_thin, extreme_aspect."""
    flags = F.array(F.when(height < thin, "too_thin"), F.when(width / F.greatest(height, F.lit(1)) > widest, "extreme_aspect"))
    return F.array_sort(F.array_distinct(F.array_compact(flags)))


def floors(rows: DataFrame, by: str, **least: float) -> DataFrame:
    """By group: how many rows there are, how many each floor drops (in order), and how many stay."""
    kept, out = F.lit(True), []
    for name, floor in least.items():
        ok = F.coalesce(F.col(name) >= floor, F.lit(False))
        out.append(F.count_if(kept & ~ok).alias(f"dropped_{name}"))
        kept = kept & ok
    return rows.groupBy(by).agg(F.count("*").alias("n"), *out, F.count_if(kept).alias("kept"))


def parsed_int(column: Column, default: int = 0) -> Column:
    """Whole number of a text or number; the default where it has none."""
    return F.coalesce(column.try_cast("double").cast("long"), F.lit(default).cast("long"))


def parsed_float(column: Column, default: float = 0.0) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(default))


def line_count_error(predicted: Column, expected: Column) -> Column:
    """Absolute difference of line counts; null if either is."""
    return F.abs(predicted - expected)


def normalized_line_count_error(predicted: Column, expected: Column) -> Column:
    """The same over the expected count, one at least; null if either is (greatest() alone would pass over a null)."""
    return line_count_error(predicted, expected) / F.greatest(expected, F.lit(1))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order with ties settled by its last columns: partial tops, no full sort."""
    return rows.orderBy(*order).limit(n)


def nearest_to(rows: DataFrame, value: str, threshold: float, n: int, *ties: str) -> DataFrame:
    """The n rows whose value is nearest to a threshold."""
    return top(rows, n, F.abs(F.col(value) - threshold), *(F.col(t) for t in ties))


def with_results(requests: DataFrame, results: DataFrame, key: str, result: str, missing: object = "") -> DataFrame:
    """Requests with the result of their key, `missing` where there is none."""
    return requests.join(results.select(key, result), key, "left").withColumn(result, F.coalesce(result, F.lit(missing)))


def picked(*choices: Column) -> Column:
    """The first setting that is given."""
    return F.coalesce(*choices)


def smoothed(rows: DataFrame, key: str, order: str, value: str, width: int = 5) -> DataFrame:
    """Centred means of a fixed width by key; places beyond the ends count as zeros."""
    half = width // 2
    around = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    return rows.withColumn("smooth", F.sum(value).over(around) / width)


def cleaning_counters(documents: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """One row: how many texts cleaning changes, by rule, and how many are then too short."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(t, r"[\p{Cc}\p{Cf}&&[^\s]]", "")
    spaced = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return documents.agg(
        F.count("*").alias("n"),
        F.count_if(bare != t).alias("ctrl_removed"),
        F.count_if(spaced != bare).alias("ws_changed"),
        F.count_if(F.length(spaced) < least).alias("too_short"),
    )


def split_metadata(splits: DataFrame, split: str, source: str) -> DataFrame:
    """By split: rows, and the rows of each source as a JSON object with its keys in order."""
    counts = splits.groupBy(split, source).agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(source).alias("k"), F.col("n").alias("v"))))  # one entry a source
    return counts.groupBy(split).agg(F.sum("n").alias("n"), F.to_json(F.map_from_entries(pairs)).alias("sources"))


def run_metrics(rows: DataFrame, by: str, means: Mapping[str, str], error: Column) -> DataFrame:
    """By run: rows, failed rows, and means and sums over those that didn't fail."""
    fine = {k: F.when(~error, F.col(c)) for k, c in means.items()}
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(error).alias("error_count"),
        *(F.avg(c).alias(f"mean_{k}") for k, c in fine.items()),
        *(F.sum(c).alias(f"sum_{k}") for k, c in fine.items()),
    )


def before_after_summary(rows: DataFrame, applied: Column, verdict: Column, measures: list[str]) -> DataFrame:
    """One row: how often something was applied, verdict counts, and means before and after with their change."""
    means = {m: (F.avg(f"before_{m}"), F.avg(f"after_{m}")) for m in measures}
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(applied.cast("double")).alias("applied_rate"),
        *(F.count_if(verdict == v).alias(v) for v in ("improved", "worsened", "no_change")),
        *(x.alias(f"{side}_{m}") for m, two in means.items() for side, x in zip(("mean_before", "mean_after"), two, strict=True)),
        *(F.round(b - a, 6).alias(f"delta_{m}") for m, (a, b) in means.items()),
    )


def estimated_rows(boxes: DataFrame, page: str, page_height: float) -> DataFrame:
    """By page: boxes, median height, rows that would fit, and boxes as a share of them."""
    out = boxes.groupBy(page).agg(F.count("*").alias("n"), F.median(F.col("y2") - F.col("y1")).alias("median_height"))
    fit = F.lit(float(page_height)) / F.greatest(F.col("median_height"), F.lit(1.0))
    return out.withColumn("estimated_rows", fit).withColumn("coverage", F.col("n") / fit)


def trials(rows: DataFrame, by: str, score: str, lines: str, n: int = 5) -> DataFrame:
    """The best trials by mean score, then least line count, then mean line count."""
    out = rows.groupBy(by).agg(F.avg(score).alias("mean_score"), F.min(lines).alias("min_lines"), F.avg(lines).alias("mean_lines"))
    return top(out, n, F.desc("mean_score"), F.desc("min_lines"), F.desc("mean_lines"), F.col(by))
