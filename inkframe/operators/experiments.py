"""Experiments: leaderboards, comparisons, reruns, training logs, and the search for better settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The settings a search steps through, in order.
PADDINGS = (0.0, 0.03, 0.05, 0.08, 0.12)
UPSCALES = (1.0, 1.5, 2.0)


def leaderboard(metrics: DataFrame, experiment: str, measures: list[str], error: str | None = None) -> DataFrame:
    """Means by experiment, four places, half to even; 0 where there is no value; rows with an error don't count."""
    ok = metrics if error is None else metrics.where(F.col(error).isNull())
    means = [F.bround(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in measures]
    return ok.groupBy(experiment).agg(F.count("*").alias("n_images"), *means)


def ranked(scores: DataFrame, score: str, *ties: str) -> DataFrame:
    """scores with rank: least first, nulls last, ties in the order given. (A leaderboard: a row an experiment.)"""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last(score), *ties)))


def compare(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Changes of measures by key; a key missing on one side counts 0 there."""
    a = before.select(key, *(F.col(m).alias(f"before_{m}") for m in measures))
    b = after.select(key, *(F.col(m).alias(f"after_{m}") for m in measures))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = a.join(b, key, "full")
    return both.select(
        key,
        *(zero(f"before_{m}").alias(f"before_{m}") for m in measures),
        *(zero(f"after_{m}").alias(f"after_{m}") for m in measures),
        *((zero(f"after_{m}") - zero(f"before_{m}")).alias(f"delta_{m}") for m in measures),
    )


def pivoted(metrics: DataFrame, row: str, column: str, names: list, value: str) -> DataFrame:
    return metrics.groupBy(row).pivot(column, names).agg(F.avg(value))


def training_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """(iteration, loss) of every match in log lines."""
    pattern = r"(?i)iter:\s*(\d+)\s*-\s*train loss:\s*([\d.]+)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("i"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("l"))
    found = lines.select(F.explode(both).alias("x"))
    return found.select(F.col("x.i").cast("long").alias("iteration"), F.expr("try_cast(x.l as double)").alias("loss")).na.drop()


def rolling_mean(log: DataFrame, order: str, value: str, width: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return log.withColumn("rolling", F.avg(value).over(w))


def best_so_far(log: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """The most before each row, and whether the row beats it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = log.withColumn("best_before", F.max(value).over(w))
    return out.withColumn("is_best", F.coalesce(F.col(value) > F.col("best_before"), F.lit(True)))


def next_of(values: tuple[float, ...], now: Column, start: int, step: Column | int = 1) -> Column:
    """The value `step` places on in a cycle; a value that isn't there counts as the one at `start`."""
    cycle = F.array(*(F.lit(v) for v in values))
    at = F.array_position(cycle, now)
    at = F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(start)
    return F.get(cycle, ((at + step) % len(values)).cast("int"))


def perturbed(configs: DataFrame, iteration: int, switches: list[str]) -> DataFrame:
    """The next settings to try: padding one on, upscale one on in even iterations, one switch turned."""
    key = switches[iteration % len(switches)]
    return configs.withColumns(
        {
            "crop_padding_ratio": next_of(PADDINGS, F.coalesce("crop_padding_ratio", F.lit(0.08)), 2),
            "upscale_factor": next_of(UPSCALES, F.coalesce("upscale_factor", F.lit(1.0)), 0, 1 if iteration % 2 == 0 else 0),
            key: ~F.coalesce(F.col(key), F.lit(False)),
        }
    )


def search(evaluate: Callable[[DataFrame], DataFrame], configs: DataFrame, switches: list[str], rounds: int) -> DataFrame:
    """Evaluate (adding `score`), perturb the best, and again; every round is one job on a few rows."""
    board = evaluate(configs)
    for i in range(rounds):
        best = board.orderBy(F.asc_nulls_last("score")).limit(1).drop("score")
        board = board.unionByName(evaluate(perturbed(best, i, switches)))
    return ranked(board, "score")


def grid(spark, **axes: list) -> DataFrame:  # noqa: ANN001
    """Every combination of the axes' values (a parameter grid: its size is the product of a few short lists)."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(axis)
    return out


def rectified(primary: str, secondary: str, least: float = 0.5) -> Column:
    """Which rectifier's page to use: the primary if applied and sure enough, else the secondary if applied, else none."""
    p = F.col(f"{primary}_applied") & (F.col(f"{primary}_confidence") >= least)
    return F.when(p, primary).when(F.col(f"{secondary}_applied"), secondary).otherwise("identity")


def decode_label(beam: Column, no_repeat: Column, lm: Column) -> Column:
    """beamK or greedy, with what else the decoder used."""
    return F.concat_ws(
        "+",
        F.when(beam > 1, F.concat(F.lit("beam"), beam.cast("string"))).otherwise("greedy"),
        F.when(no_repeat > 1, F.concat(F.lit("no_repeat_ngram_"), no_repeat.cast("string"))),
        F.when(lm, "kenlm"),
    )
