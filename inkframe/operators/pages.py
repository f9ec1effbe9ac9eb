"""Layout of boxes on pages: reading order, merged bands, neighbours, flags and detector measures.

Order-dependent rules are folds over a page's boxes, kept as higher-order functions; pages are the shuffle key.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def reading_order(boxes: DataFrame, page: str, tolerance: float = 0.5) -> DataFrame:
    """boxes (x1, y1, x2, y2 and others) with `row` and `line_index`, both from 0.

    From top to bottom by centre, a box joins the first row whose mean centre is within `tolerance` of the page's median
    height; rows go by their least y1, boxes in a row by x1, ties by order of arrival.
    """
    rest = [c for c in boxes.columns if c != page]
    item = F.struct(((F.col("y1") + F.col("y2")) / 2).cast("double").alias("cy"), F.struct(*rest).alias("b"))
    got = boxes.groupBy(page).agg(
        F.median(F.col("y2") - F.col("y1")).cast("double").alias("_m"), F.sort_array(F.collect_list(item)).alias("_items")
    )
    kinds = boxes.select(F.struct(*rest).alias("b")).schema["b"].dataType.simpleString()
    row = f"struct<s:double,n:int,y:double,b:array<{kinds}>>"
    near = f"abs(x.cy - r.s / r.n) <= {tolerance} * _m"
    fold = f"""aggregate(_items, cast(array() as array<{row}>), (rows, x) -> case
        when exists(rows, r -> {near}) then transform(rows, (r, i) -> if(
            i = array_position(transform(rows, r -> {near}), true) - 1,
            named_struct('s', r.s + x.cy, 'n', r.n + 1, 'y', least(r.y, cast(x.b.y1 as double)), 'b', array_append(r.b, x.b)), r))
        else array_append(rows, named_struct('s', x.cy, 'n', 1, 'y', cast(x.b.y1 as double), 'b', array(x.b))) end)"""
    rows = got.select(page, F.expr(fold).alias("_rows"))
    # rows by least y1, ties by when they were begun
    ordered = F.sort_array(F.expr("transform(_rows, (r, i) -> named_struct('y', r.y, 'i', i, 'b', r.b))"))
    flat = rows.select(page, F.posexplode(ordered).alias("row", "_r")).select(page, "row", F.posexplode("_r.b").alias("_k", "_b"))
    order = Window.partitionBy(page).orderBy("row", "_b.x1", "_k")
    return flat.withColumn("line_index", F.row_number().over(order) - 1).select(page, "row", "line_index", "_b.*")


def merge_bands(boxes: DataFrame, page: str) -> DataFrame:
    """Bands after near duplicates are merged, from top to bottom; no merge makes a band taller than 1.45 medians."""
    item = F.struct(
        ((F.col("y1") + F.col("y2")) / 2).cast("double").alias("cy"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))
    )
    got = boxes.groupBy(page).agg(F.median(F.col("y2") - F.col("y1")).cast("double").alias("_m"), F.sort_array(F.collect_list(item)).alias("_items"))
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    fold = f"""aggregate(_items, cast(array() as array<{box}>), (out, x) -> element_at(transform(array(element_at(out, -1)), p ->
        case when p is not null and greatest(p.y2, x.y2) - least(p.y1, x.y1) <= 1.45 * _m and (
            greatest(0D, least(p.y2, x.y2) - greatest(p.y1, x.y1)) / greatest(least(greatest(p.y2 - p.y1, 1D), greatest(x.y2 - x.y1, 1D)), 1D) >= 0.6
            or x.y1 - p.y2 < -0.15 * _m or (x.y1 - p.y2 >= 0 and x.y1 - p.y2 <= greatest(2D, 0.08 * _m)))
        then array_append(slice(out, 1, size(out) - 1), named_struct(
            'x1', least(p.x1, x.x1), 'y1', least(p.y1, x.y1), 'x2', greatest(p.x2, x.x2), 'y2', greatest(p.y2, x.y2)))
        else array_append(out, named_struct('x1', x.x1, 'y1', x.y1, 'x2', x.x2, 'y2', x.y2)) end), 1))"""
    fold = fold.replace("element_at(out, -1)", "get(out, size(out) - 1)")
    return got.select(page, F.posexplode(F.expr(fold)).alias("band", "_b")).select(page, "band", "_b.*")


def with_page_medians(boxes: DataFrame, page: str) -> DataFrame:
    w = Window.partitionBy(page)
    return boxes.withColumns(
        {
            "median_width": F.median(F.col("x2") - F.col("x1")).over(w),
            "median_height": F.median(F.col("y2") - F.col("y1")).over(w),
        }
    )


def neighbour_clamp(boxes: DataFrame, page: str, *ties: str) -> DataFrame:
    """Each box with its y range held off its neighbours in order of centres by a margin.

    A neighbour counts if it shares a quarter of the narrower width, or its centre is within one and a half median heights.
    Where less than 0.6 of a box would be left, it is rejected and keeps its own bounds.
    """
    center = (F.col("y1") + F.col("y2")) / 2.0
    b = with_page_medians(boxes.withColumn("_c", center), page)
    order = Window.partitionBy(page).orderBy("_c", *ties)
    median = F.greatest(F.col("median_height"), F.lit(1.0))
    margin = F.least(F.greatest(0.08 * median, F.lit(2.0)), F.lit(8.0))
    names = ("x1", "y1", "x2", "y2", "_c")
    b = b.withColumns({"_p": F.lag(F.struct(*names)).over(order), "_n": F.lead(F.struct(*names)).over(order), "_m": median, "_g": margin})

    def counts(o: Column) -> Column:
        shared = F.greatest(F.lit(0), F.least(F.col("x2"), o["x2"]) - F.greatest(F.col("x1"), o["x1"]))
        width = F.greatest(F.least(F.col("x2") - F.col("x1"), o["x2"] - o["x1"]), F.lit(1))
        return o.isNotNull() & ((shared / width >= 0.25) | (F.abs(F.col("_c") - o["_c"]) <= 1.5 * F.col("_m")))

    p, n = F.col("_p"), F.col("_n")
    top = F.when(counts(p), F.greatest(F.col("y1"), p["y2"] + F.col("_g"))).otherwise(F.col("y1"))
    bottom = F.when(counts(n), F.least(F.col("y2"), n["y1"] - F.col("_g"))).otherwise(F.col("y2"))
    b = b.withColumns({"_t": top.cast("double"), "_b": bottom.cast("double")})
    left = F.col("_b") - F.col("_t")
    b = b.withColumn("rejected", (left <= 0) | (left < 0.6 * F.greatest(F.col("y2") - F.col("y1"), F.lit(1))))
    kept = lambda c, own: F.when(F.col("rejected"), F.col(own).cast("double")).otherwise(F.col(c))
    b = b.withColumns({"clamped_y1": kept("_t", "y1"), "clamped_y2": kept("_b", "y2")})
    return b.drop("_c", "_p", "_n", "_m", "_g", "_t", "_b")


def image_flags(boxes: DataFrame, page: str, *ties: str, tiny_width: float = 0.35, merged: float = 1.8, share: float = 0.35, aspects: tuple[int, int] = (3, 55)) -> DataFrame:
    """Each box with flags relative to its page: tiny_box, merged_box (twice, if tall and overlapping), abnormal_crop."""
    order = Window.partitionBy(page).orderBy("y1", *ties)
    b = with_page_medians(boxes, page)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def overlaps(y1: Column, y2: Column) -> Column:
        shared = F.least(F.col("y2"), y2) - F.greatest(F.col("y1"), y1)
        least = F.least(h, y2 - y1)
        return F.coalesce((least > 0) & (shared / least >= share), F.lit(False))

    before = overlaps(F.lag("y1").over(order), F.lag("y2").over(order))
    after = overlaps(F.lead("y1").over(order), F.lead("y2").over(order))
    b = b.withColumns({"_before": before, "_after": after})
    aspect = w / F.greatest(h, F.lit(1))
    flags = F.array_compact(
        F.array(
            F.when(w < F.greatest(F.lit(1.0), F.col("median_width") * tiny_width), "tiny_box"),
            F.when((F.col("median_height") > 0) & (h > F.col("median_height") * merged), "merged_box"),
            F.when(F.col("_before") | F.col("_after"), "merged_box"),
            F.when((aspect < aspects[0]) | (aspect > aspects[1]), "abnormal_crop"),
        )
    )
    return b.withColumns({"aspect": aspect, "flags": flags}).drop("_before", "_after")


def geometry_summary(flagged: DataFrame, page: str) -> DataFrame:
    """Counts and rates of flags for each page, and over all pages (page null, is_total 1)."""
    has = lambda f: F.count_if(F.array_contains("flags", f))
    out = flagged.rollup(page).agg(
        F.grouping(page).cast("int").alias("is_total"),
        F.count("*").alias("line_count"),
        has("tiny_box").alias("tiny_box_count"),
        has("merged_box").alias("merged_box_count"),
        has("abnormal_crop").alias("abnormal_crop_count"),
        F.count_if(F.size("flags") == 0).alias("valid_line_count"),
        F.avg("aspect").alias("average_aspect"),
    )
    return out.withColumn("valid_line_ratio", F.col("valid_line_count") / F.col("line_count"))


def detector_metrics(boxes: DataFrame, page: str, page_width: int) -> DataFrame:
    """Per page: count, share of bands as wide as the page, mean aspect, distinct left edges (tens, half to even), median height."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.groupBy(page).agg(
        F.count("*").alias("detection_count"),
        F.avg((w >= 0.95 * page_width).cast("double")).alias("full_width_band_rate"),
        F.avg(w / F.greatest(h, F.lit(1))).alias("mean_aspect"),
        F.count_distinct(F.bround(F.col("x1") / 10, 0)).alias("distinct_x1"),
        F.median(h).alias("median_height"),
    )


def under_segmented(height: Column, boxes: Column, median: Column, coverage: Column) -> Column:
    """Too few, too tall or too sparse boxes for a page of some height."""
    return (height >= 700) & ((boxes <= 14) | (median > 0.045 * height) | (coverage < 0.72))


def duplicate_candidates(boxes: DataFrame, page: str, key: str, least: float = 0.65) -> DataFrame:
    """Pairs of boxes of a page (key a before key b) that overlap enough or stand on one line."""
    from inkframe.functions.boxes import iou, same_line

    names = ("x1", "y1", "x2", "y2")
    a = boxes.select(page, F.col(key).alias("a"), *(F.col(c).alias(f"a_{c}") for c in names))
    b = boxes.select(page, F.col(key).alias("b"), *(F.col(c).alias(f"b_{c}") for c in names))
    x, y = ({c: F.col(f"{k}_{c}") for c in names} for k in "ab")
    both = a.join(b, page).where("a < b").withColumns({"iou": iou(x, y), "same_line": same_line(x, y)})
    return both.where((F.col("iou") >= least) | F.col("same_line")).select(page, "a", "b", "iou", "same_line")


def _over_pages(boxes: DataFrame, page: str, order: list[Column], fold: Callable[[pa.Table, list[int]], pa.Table], schema: str | StructType) -> DataFrame:
    """`fold` over whole pages, many at a time: a table in order of pages, and where each page starts (and the last ends).

    A call and a frame for each page would cost more than its few boxes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            keys = t.column(page).to_pylist()
            if keys:
                yield from fold(t, [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]).to_batches()

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(page).to_pylist()
            if not keys:
                continue
            last = len(keys) - 1
            while last and keys[last - 1] == keys[-1]:
                last -= 1
            # the last page may go on in the next batch
            if kept and (last or kept[-1].column(page)[-1].as_py() != keys[0]):
                yield from folded([*kept, batch.slice(0, last)])
                kept = []
            elif last:
                yield from folded([batch.slice(0, last)])
            kept.append(batch.slice(last))
        if kept:
            yield from folded(kept)

    return boxes.repartition(page).sortWithinPartitions(page, *order).mapInArrow(run, schema)


def _numbers(t: pa.Table, *names: str) -> Iterator[list[float]]:
    for n in names:
        column = t.column(n)
        yield [math.nan if v is None else v for v in column.to_pylist()] if column.null_count else column.to_pylist()


def merge_duplicates(boxes: DataFrame, page: str) -> DataFrame:
    """Boxes (x1, y1, x2, y2, confidence, idx) in order: one like a kept box replaces it if surer and hardly taller, else goes."""

    def fold(t: pa.Table, starts: list[int]) -> pa.Table:
        rows = list(zip(*_numbers(t, "x1", "y1", "x2", "y2", "confidence"), range(len(t)), strict=True))
        out: list[int] = []
        for start, end in pairwise(starts):
            kept: list[tuple] = []
            for row in rows[start:end]:
                x1, y1, x2, y2, sure, _ = row
                for i, (kx1, ky1, kx2, ky2, ksure, _) in enumerate(kept):
                    high, khigh = y2 - y1, ky2 - ky1
                    close = abs((y1 + y2) - (ky1 + ky2)) / 2 <= 0.3 * min(high, khigh)
                    h = min(y2, ky2) - max(y1, ky1)
                    if not close and not h > 0:
                        continue
                    w = min(x2, kx2) - max(x1, kx1)
                    shared = max(w, 0) * max(h, 0)
                    areas = max((x2 - x1) * high, 1.0) + max((kx2 - kx1) * khigh, 1.0)
                    if shared / (areas - shared) >= 0.65 or close and max(w, 0) >= 0.65 * min(x2 - x1, kx2 - kx1):
                        if sure > ksure and high <= 1.12 * khigh:
                            kept[i] = row
                        break
                else:
                    kept.append(row)
            out.extend(k[-1] for k in kept)
        return t.take(pa.array(out, pa.int64()))

    return _over_pages(boxes, page, [F.col("idx").asc_nulls_last()], fold, boxes.schema)


def cluster_words(words: DataFrame, page: str, page_width: float, width_ratio: float = 1.0, height_ratio: float = 2.5) -> DataFrame:
    """Word boxes of a page as lines: each word joins the nearest line by its median centre, within half a median height.

    Lines wider or taller than the caps are dropped; a line's confidence grows with its words. Words come in order of
    centres, so a line's median is in its middle, and the nearest line is the last: a line is begun only above all medians.
    """

    def fold(t: pa.Table, starts: list[int]) -> pa.Table:
        rows = list(zip(*_numbers(t, "x1", "y1", "x2", "y2"), strict=True))
        at: list[int] = []
        out: list[tuple] = []
        for start, end in pairwise(starts):
            found = sorted(((y1 + y2) / 2, x1, y1, x2, y2) for x1, y1, x2, y2 in rows[start:end] if x2 - x1 >= 2 and y2 - y1 >= 2)
            if not found:
                continue
            median = float(statistics.median(w[4] - w[2] for w in found))
            first = 0
            for i in range(1, len(found) + 1):
                middle = (found[(first + i - 1) // 2][0] + found[(first + i) // 2][0]) / 2
                if i < len(found) and found[i][0] - middle <= 0.5 * median:
                    continue
                line = found[first:i]
                x1, y1, x2, y2 = min(w[1] for w in line), min(w[2] for w in line), max(w[3] for w in line), max(w[4] for w in line)
                if x2 - x1 <= width_ratio * page_width and y2 - y1 <= max(height_ratio * median, median + 4):
                    at.append(start)
                    out.append((float(x1), float(y1), float(x2), float(y2), len(line), min(1.0, len(line) / 8 + 0.2)))
                first = i
        kinds = [*[pa.float64()] * 4, pa.int32(), pa.float64()]
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        return pa.Table.from_arrays([t.column(page).take(pa.array(at, pa.int64())), *columns], [page, "x1", "y1", "x2", "y2", "words", "confidence"])

    kind = words.schema[page].dataType.simpleString()
    return _over_pages(words, page, [], fold, f"`{page}` {kind}, x1 double, y1 double, x2 double, y2 double, words int, confidence double")


def curvature(points: DataFrame, key: str) -> DataFrame:
    """Per shape (points x, y): the mean distance of its points from their straight line, over its height."""
    fit = points.groupBy(key).agg(F.regr_slope("y", "x").alias("_a"), F.regr_intercept("y", "x").alias("_b"), (F.max("y") - F.min("y")).alias("_h"))
    off = F.abs(F.col("y") - F.col("_a") * F.col("x") - F.col("_b"))
    joined = points.join(fit, key).groupBy(key).agg(F.avg(off).alias("_e"), F.first("_h").alias("_h"))
    return joined.select(key, F.when(F.col("_h") > 0, F.col("_e") / F.col("_h")).otherwise(0.0).alias("curvature"))


def islands(profile: DataFrame, key: str, position: str, active: str, gap: int = 0) -> DataFrame:
    """Runs of active positions, merged over gaps of at most `gap`: first, last and length of each."""
    on = profile.where(F.col(active))
    order = Window.partitionBy(key).orderBy(position)
    new = F.coalesce(F.col(position) - F.lag(position).over(order) > gap + 1, F.lit(True)).cast("int")
    grouped = on.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("active")).drop("_g")


