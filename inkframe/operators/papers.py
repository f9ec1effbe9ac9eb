"""A catalogue of papers: merging records, choosing links, buckets of tags, partial summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import text as T


def record_key(doi: str, arxiv: str, title: str) -> Column:
    full = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    return F.coalesce(full(doi), full(arxiv), T.title_key(F.col(title)))


def merge_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: queries united and sorted, most citations, and the first abstract and link that aren't empty."""
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order)))
    return records.groupBy(key).agg(
        F.sort_array(F.collect_set("query")).alias("queries"),
        F.max("citation_count").alias("citation_count"),
        first("abstract").alias("abstract"),
        first("pdf_url").alias("pdf_url"),
    )


def best_link(*urls: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(u), F.lit("")) for u in urls))


def file_name(year: Column, title: Column, key: Column) -> Column:
    return F.concat(F.concat_ws("_", F.coalesce(year.cast("string"), F.lit("unknown")), T.slug(title, 70), key), F.lit(".pdf"))


def merge_lists(parts: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Items of partial lists in order, each once whatever its case."""
    items = parts.select(key, order, F.posexplode(column).alias("_i", "item")).where("trim(item) <> ''")
    w = Window.partitionBy(key, F.lower(F.trim("item"))).orderBy(order, "_i")
    kept = items.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    joined = F.sort_array(F.collect_list(F.struct(order, "_i", F.trim("item").alias("item"))))
    return kept.groupBy(key).agg(F.transform(joined, lambda x: x["item"]).alias(column))


def chunks(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Texts cut at the last blank line of each window, unless it lies in the window's first half: key, chunk_no, chunk."""
    from collections.abc import Iterator

    import pandas as pd

    def cut(t: str) -> list[str]:
        t = (t or "").strip()
        if len(t) <= most:
            return [t]
        out, start = [], 0
        while start < len(t):
            end = min(len(t), start + most)
            at = t.rfind("\n\n", start, end)
            at = end if at < start + most // 2 else at
            out.append(t[start:at].strip())
            start = at
        return [c for c in out if c]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f[key], f[text], strict=True) for i, c in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_no int, chunk string")
