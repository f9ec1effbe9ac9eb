"""Building data sets: splits, samples, chunks, set operations, statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_hash(column: Column) -> Column:
    """An integer hash that any SQL engine computes alike."""
    return F.pmod(column * F.lit(2654435761), F.lit(1000003))


def stratified_split(df: DataFrame, stratum: str, key: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """df with `split`: shares of each stratum in hash order; disjoint, complete and repeatable.

    One window a stratum: strata as coarse as a source hold many rows, so rows are ranked within (stratum, salt) and
    placed by counts of the salts before.
    """
    salts = 256
    salted = df.withColumn("_h", id_hash(F.col(key))).withColumn("_s", F.floor(F.col("_h") * salts / 1000003).cast("int"))
    counts = salted.groupBy(stratum, "_s").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(stratum).orderBy("_s")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_n", F.sum("_c").over(Window.partitionBy(stratum)))
    inside = Window.partitionBy(stratum, "_s").orderBy("_h", key)
    ranked = salted.withColumn("_r", F.row_number().over(inside)).join(counts, [stratum, "_s"])
    rank = F.col("_r") + F.col("_before")
    split = F.when(rank <= F.floor(F.col("_n") * train), "train").when(rank <= F.floor(F.col("_n") * (train + val)), "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_s", "_c", "_before", "_n", "_r")


def stratified_sample(df: DataFrame, stratum: str, key: str, rows: int) -> DataFrame:
    """About `rows` rows: of each stratum its share, rounded down, first in hash order."""
    shares = df.groupBy(stratum).agg(F.count("*").alias("_c"))
    shares = shares.withColumn("_take", F.floor(F.lit(rows) * F.col("_c") / F.sum("_c").over(Window.partitionBy())))
    order = Window.partitionBy(stratum).orderBy("_h", key)
    ranked = df.withColumn("_h", id_hash(F.col(key))).withColumn("_r", F.row_number().over(order))
    return ranked.join(F.broadcast(shares), stratum).where("_r <= _take").drop("_h", "_r", "_c", "_take")


def fixed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in hash order: the same ones every time."""
    return df.orderBy(id_hash(F.col(key)), key).limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't rerun, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return candidates.join(done, key, "left_anti")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between least and most; the last bin holds its right edge; empty bins are rows too."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    found = df.crossJoin(F.broadcast(edges)).where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def describe(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Count, least, most, mean, sample deviation and percentiles with linear interpolation."""
    return df.groupBy(*keys).agg(
        F.count(column).alias("n"),
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        *(F.percentile(column, F.lit(p / 100)).alias(f"p{p}") for p in (50, 75, 90, 95, 99)),
    )


def box_plot(df: DataFrame, column: str, key: str) -> DataFrame:
    """Quartiles, and the whiskers: the last values within 1.5 times the interquartile range."""
    q = df.groupBy(key).agg(*(F.percentile(column, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low = F.min(F.when(F.col(column) >= F.col("q1") - reach, F.col(column)))
    high = F.max(F.when(F.col(column) <= F.col("q3") + reach, F.col(column)))
    return df.join(F.broadcast(q), key).groupBy(key, "q1", "q2", "q3").agg(low.alias("whisker_low"), high.alias("whisker_high"))


def upper_median(column: str) -> Column:
    """The middle value, the upper one of two."""
    values = F.sort_array(F.collect_list(column))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def retention(df: DataFrame, score: str, steps: int = 100) -> DataFrame:
    """The share of rows at or above each of steps + 1 thresholds: rows are counted by threshold first, then summed.

    score is compared with k / steps, in doubles.
    """
    reached = F.floor(F.col(score) * steps + 1e-9)
    # one pass: scores cost more than all that is made of them here
    k = F.greatest(F.least(reached, F.lit(steps)), F.lit(-1)).cast("int")
    counts = df.where(F.col(score).isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("c"))
    whole = counts.agg(F.collect_list(F.struct("k", "c")).alias("cs"), F.sum("c").alias("n_all"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    above = F.filter("cs", lambda x: x["k"] >= F.col("step"))
    kept = grid.crossJoin(F.broadcast(whole)).withColumn("kept", F.aggregate(above, F.lit(0).cast("long"), lambda n, x: n + x["c"]))
    return kept.select("step", "kept", F.when(F.col("n_all") > 0, F.col("kept") / F.col("n_all")).otherwise(0.0).alias("share"))
