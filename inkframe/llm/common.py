"""Helpers shared by the corpus operators: table reading, bounded samples, graph components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.stages import release, shared_dir, staged  # noqa: F401

#: Rows in one Arrow batch handed to Python: a few MB of ordinary documents, and a bounded number of long ones.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark's own reader so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound Arrow batches by a row count; a smaller value set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def free_name(name: str, taken: list[str]) -> str:
    """`name`, or a longer one where a column has it, in whatever case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def bounded_sample(df: DataFrame, rows: int, *keys: str, seed: int = 17) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of the keys; all rows if there are fewer. Narrow: one count, then a filter."""
    n = df.count()
    if n <= rows:
        return df
    span = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(span)) < F.lit(int(span * rows / n)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id as text, so that null ids don't turn the others into floats in pandas, and text, empty where null."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as decimal text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TRIMMED: dict[str, object] = {}


def trim_worker() -> None:
    """Hand what earlier tasks of this Python worker have freed back to the system, once a task.

    Workers live on from stage to stage, and allocators keep freed memory: without this, a stage starts with the peak of
    those before it. Where the C library can't do it, nothing happens.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    now = context.taskAttemptId() if context else None
    if now is None or _TRIMMED.get("task") == now:
        return
    _TRIMMED["task"] = now
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def batches(frames: Iterator, limit: int = 2_000_000) -> Iterator:
    """Slices of pandas frames with a `text` column, each of about `limit` characters at most (one row at least)."""
    trim_worker()
    for frame in frames:
        sizes = frame["text"].str.len().fillna(0).to_numpy().astype(np.int64)
        if not len(sizes):
            continue
        cut = np.cumsum(sizes) // limit
        for _, part in frame.groupby(cut, sort=False):
            yield part.reset_index(drop=True)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (u, v) of longs: rows (node, comp), comp the smallest node reachable.

    Alternates large-star and small-star passes; each is a partial aggregate and an equi-join, so a hub with many
    neighbours is split like any skewed join. Edges are cut to the shared folder between passes, never collected.
    """
    spark = edges.sparkSession
    now = staged(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # done when no node is both an end and a root: every edge then leads to its component's smallest node
        twice = now.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("u")
        if now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u").union(twice).isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, now = now, staged(small, "edges")
        release(before)
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("comp"))
