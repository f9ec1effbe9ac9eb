"""Sinks: text and JSON exports of recognised documents, label files, leaderboards and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_texts(lines: DataFrame, document: str, page: str) -> DataFrame:
    """One text a document: a [Page n] head and its lines for each page, pages parted by a form feed."""
    per_page = lines.groupBy(document, page).agg(F.sort_array(F.collect_list(F.struct("line_index", "text"))).alias("_l"))
    body = F.concat_ws("\n", F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("]")), F.transform("_l", lambda x: x["text"]))
    pages = per_page.select(document, page, body.alias("_t")).groupBy(document).agg(F.sort_array(F.collect_list(F.struct(page, "_t"))).alias("_p"))
    return pages.select(document, F.array_join(F.transform("_p", lambda x: x["_t"]), "\f\n").alias("content"))


def page_json(lines: DataFrame, document: str, page: str) -> DataFrame:
    """One JSON text a document: pages with lines, confidences to four places and boxes to one, half to even."""
    box = F.struct(*(F.bround(c, 1).alias(c) for c in ("x1", "y1", "x2", "y2")))
    line = F.struct("line_index", "text", F.bround("confidence", 4).alias("confidence"), box.alias("bbox"))
    per_page = lines.groupBy(document, page).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    full = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    one = F.struct(F.col(page).alias("page_number"), F.size("lines").alias("line_count"), full.alias("full_text"), "lines")
    pages = per_page.groupBy(document).agg(F.sort_array(F.collect_list(one)).alias("pages"))
    total = F.aggregate("pages", F.lit(0), lambda s, p: s + p["line_count"])
    payload = F.struct(F.col(document).alias("filename"), F.size("pages").alias("total_pages"), total.alias("total_lines"), "pages")
    return pages.select(document, F.to_json(payload, {"pretty": "true"}).alias("content"))


def export_name(name: Column, kind: str) -> Column:
    """<stem>_ocr.<kind>"""
    return F.concat(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""), F.lit(f"_ocr.{kind}"))


def label_lines(df: DataFrame, path: str = "image_path", label: str = "transcription", prefix: str | None = None) -> DataFrame:
    """Rows as label-file lines; a prefix is put before paths that don't have it."""
    p = F.col(path)
    if prefix:
        p = F.when(p.startswith("/") | p.startswith(prefix), p).otherwise(F.concat(F.lit(prefix), p))
    return df.select(F.concat_ws("\t", p, F.coalesce(label, F.lit(""))).alias("value"))


def write_labels(df: DataFrame, folder: str, **options: str) -> None:
    label_lines(df, **options).write.mode("overwrite").text(folder)


def append_json(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_board(board: DataFrame, folder: str) -> None:
    """A leaderboard (a row an experiment) as JSON and CSV, with its ranks."""
    board.write.mode("overwrite").json(f"{folder}/json")
    board.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def replace_partitions(df: DataFrame, folder: str, key: str) -> None:
    """Overwrite only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def markdown(df: DataFrame, title: str) -> str:
    """A report of a small table (a leaderboard, a summary) as Markdown."""
    rows = df.collect()
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)]) + "\n"
