"""Known inputs and outputs of the functions and operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.functions import boxes as B
from inkframe.functions import edits as E
from inkframe.functions import text as T
from inkframe.operators import candidates, datasets, evaluation, experiments, pages, papers, quality, spelling
from inkframe.plans.plugins import Registry
from inkframe.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("v")).first()["v"]


def text(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


def test_error_rates(spark):
    rows = spark.createDataFrame([("xin chào", "xin chào"), ("xin cho", "xin chào"), ("", ""), ("a", ""), ("", "a")], "p string, r string")
    got = evaluation.pair_errors(rows, "p", "r").select("cer", "wer").collect()
    assert [tuple(x) for x in got] == [(0.0, 0.0), (1 / 8, 0.5), (0.0, 0.0), (1.0, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize(("value", "noisy"), [("Năm 1945, lớp 11.11 thi ngày 24/04/2026 ở phòng A2", False), ("Tôi yêu V1ệt N4m", True), ("", False), (None, False)])
def test_digit_noise(spark, value, noisy):
    assert (text(spark, T.digit_noise_rate, value) > 0) == noisy


def test_tokens(spark):
    assert text(spark, T.suspicious_tokens, "Tôi yêu V1ệt N4m") == ["V1ệt", "N4m"]
    assert text(spark, T.capital_tokens, "ND TP UBND đã ban hành quyết định") == ["ND", "TP", "UBND"]
    assert text(spark, T.is_hallucinated, "ND TP UBND đã ban hành quyết định")
    assert set(text(spark, T.repeated_numbers, "abc 010101 def 1111 ghi")) == {"010101", "1111"}
    assert text(spark, T.safe_lines, "  Năm  1945 \t lớp 11.11 ngày 24/04/2026  ") == "Năm 1945 lớp 11.11 ngày 24/04/2026"
    assert text(spark, T.nfc, "à") == "à"


def test_garbage(spark):
    lines = spark.createDataFrame([("",), ("ab",), ("một dòng chữ bình thường",), ("thêm một dòng chữ nữa",)], "t string")
    assert lines.select(F.avg(T.is_garbage(F.col("t")).cast("int"))).first()[0] == 0.5


def test_scores(spark):
    v = [F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]
    assert one(spark, quality.run_score(*v), a=1) == pytest.approx(0.18)
    none = F.lit(None).cast("double")
    assert one(spark, quality.run_score(none, none, none, none), a=1) is None
    assert one(spark, quality.verdict(F.lit(0.0), F.lit(0.0), F.lit(-0.2)), a=1) == "improved"
    assert one(spark, quality.verdict(F.lit(0.0), F.lit(0.0), F.lit(0.0)), a=1) == "no_change"


def test_assignment(spark):
    rng = np.random.default_rng(1)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in E.assign(c))
        wide = c if n <= m else c.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert got == pytest.approx(best)
    kind = "page string, line_no int, text string"
    p = spark.createDataFrame([("a", 0, "thế giới"), ("a", 1, "Xin chào"), ("b", 0, "x")], kind)
    r = spark.createDataFrame([("a", 0, "Xin chào"), ("a", 1, "thế giới"), ("c", 0, "y")], kind)
    got = {x["page"]: (x["matched"], x["line_cer"]) for x in evaluation.assign_lines(p, r, "page").collect()}
    assert got == {"a": (2, 0.0), "b": (0, 1.0), "c": (0, 1.0)}


def test_alignment():
    assert [x for x in E.steps("xin cho", "xin chào") if x[0] != "match"] == [("del", "à", "")]
    assert [o for o, _, _ in E.steps("", "ab")] == ["del", "del"]


def test_reading_order(spark):
    rows = [("r2-right", 200, 100), ("r1-left", 10, 12), ("r3-right", 205, 203), ("r1-right", 210, 10), ("r3-left", 8, 200), ("r2-left", 12, 104)]
    boxes = spark.createDataFrame([("p", x, y, x + 100, y + 40, n) for n, x, y in rows], "page string, x1 int, y1 int, x2 int, y2 int, name string")
    got = [r["name"] for r in pages.reading_order(boxes, "page").orderBy("line_index").collect()]
    assert got == ["r1-left", "r1-right", "r2-left", "r2-right", "r3-left", "r3-right"]


def test_bands(spark):
    kind = "page string, x1 double, y1 double, x2 double, y2 double"
    apart = [("a", 0.0, 145.0 + 28 * i, 100.0, 186.0 + 28 * i) for i in range(8)]
    same = [("b", 40.0, 100.0, 640.0, 140.0), ("b", 45.0, 102.0, 638.0, 142.0)]
    got = {r["page"]: r["n"] for r in pages.merge_bands(spark.createDataFrame(apart + same, kind), "page").groupBy("page").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 8, "b": 1}


def test_boxes(spark):
    poly = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 20), (300, 15), (305, 55), (5, 60))))
    assert tuple(one(spark, B.polygon_box(poly), a=1)) == (5, 15, 305, 60)
    first = one(spark, B.corner_order(poly), a=1)
    assert [tuple(p) for p in first] == [(10, 20), (300, 15), (305, 55), (5, 60)]
    identity = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    assert tuple(one(spark, B.mapped_box(identity, *(F.lit(float(v)) for v in (1, 2, 3, 4))), a=1)) == (1, 2, 3, 4)
    kind = "page string, x1 double, y1 double, x2 double, y2 double, confidence double, idx int"
    pair = spark.createDataFrame([("p", 20.0, 100.0, 220.0, 132.0, 0.72, 0), ("p", 18.0, 98.0, 222.0, 130.0, 0.85, 1)], kind)
    assert [r["confidence"] for r in pages.merge_duplicates(pair, "page").collect()] == [0.85]
    assert one(spark, pages.under_segmented(F.lit(1400), F.lit(8), F.lit(48), F.lit(0.28)), a=1)


def test_detector_metrics(spark):
    kind = "page string, x1 double, y1 double, x2 double, y2 double"
    rows = [("a", 0.0, 0.0, 100.0, 10.0), ("a", 0.0, 20.0, 200.0, 30.0), ("b", 10.0, 0.0, 610.0, 10.0), ("b", 10.0, 20.0, 110.0, 30.0), ("b", 80.0, 40.0, 180.0, 50.0)]
    got = {r["page"]: r for r in pages.detector_metrics(spark.createDataFrame(rows, kind), "page", 600).collect()}
    assert got["a"]["mean_aspect"] == 15.0
    assert got["b"]["distinct_x1"] == 2 and got["b"]["full_width_band_rate"] == pytest.approx(1 / 3)


def test_word_clusters(spark):
    kind = "page string, x1 double, y1 double, x2 double, y2 double"
    rows = [("p", 50.0 * i, 100.0, 50.0 * i + 40, 130.0) for i in range(3)] + [("p", 50.0 * i, 200.0, 50.0 * i + 40, 230.0) for i in range(2)]
    assert pages.cluster_words(spark.createDataFrame(rows, kind), "page", 1000.0).count() == 2
    near = [("q", 50.0 * i, 85.0 + 30 * k, 50.0 * i + 40, 115.0 + 30 * k) for k in range(3) for i in range(4)]
    assert pages.cluster_words(spark.createDataFrame(near, kind), "page", 1000.0).count() == 3


@pytest.mark.parametrize(("ids", "n", "banned"), [([], 3, []), ([1, 2], 3, []), ([0, 1, 0, 1], 3, [0]), ([78, 68, 78, 68, 78], 3, [68]), ([0, 1, 0, 1, 0, 1], 4, [0]), ([0, 1, 2, 3], 1, [])])
def test_banned(spark, ids, n, banned):
    row = spark.createDataFrame([(ids,)], "t array<int>").select(candidates.banned_next(F.col("t"), n).alias("v")).first()
    assert list(row["v"]) == banned


def test_rescoring(spark):
    kind = "line int, pos int, text string, acoustic_logprob double, lm_logprob double"
    rows = [(1, 0, "xin chau", -1.0, -10.0), (1, 1, "xin chào", -1.0, -2.0), (2, 0, "a", -1.0, -2.0), (2, 1, "b", -1.0, -2.0)]
    got = {r["line"]: (r["text"], r["source"]) for r in candidates.rescore(spark.createDataFrame(rows, kind), "line", 1.0, 0.0).collect()}
    assert got == {1: ("xin chào", "rescored"), 2: ("a", "top1")}
    off = candidates.rescore(spark.createDataFrame(rows, kind), "line", enabled=False).where("line = 1").first()
    assert (off["text"], off["source"]) == ("xin chau", "disabled")


def test_label_dialects(spark):
    lines = spark.createDataFrame([("a.png\txin chào",), ("b.png",), ("",), (" c.png \t x\ty ",), ("  ",)], "value string")
    n = {d: readers.parse_labels(lines, d).count() for d in readers.DIALECTS}
    assert n == {"eda": 4, "prep": 2, "train": 2, "compare": 1, "eval": 3, "experiment": 3, "stage2": 2, "lexicon": 2}
    assert readers.parse_labels(lines, "experiment").where("image_path = 'b.png'").first()["transcription"] is None
    assert readers.parse_labels(lines, "train").where("image_path = 'c.png'").first()["transcription"] == "x\ty"


def test_spelling(spark):
    terms = spark.createDataFrame([("chào", 5), ("cháo", 9), ("xin", 3)], "term string, freq long")
    lines = spark.createDataFrame([(1, "XIN Chao, zzz")], "k int, t string")
    assert spelling.correct_lines(lines, "k", "t", terms).first()["corrected"] == "XIN Cháo, zzz"


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("s"))
    out = datasets.stratified_split(df, "s", "id")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == pytest.approx({"train": 800, "val": 100, "test": 100}, abs=4)
    assert out.select("id").distinct().count() == 1000
    old = spark.createDataFrame([("E1", 1), ("E3", 2), ("E3", 3)], "e string, v int")
    assert datasets.upsert(old, old.where("e = 'E3' and v = 3"), "e").count() == 2


def test_logs_and_settings(spark):
    log = spark.createDataFrame([("iter: 000200 - train loss: 1.234 - lr: 1e-4",), ("noise",)], "value string")
    assert tuple(experiments.training_log(log).first()) == (200, 1.234)
    c = spark.createDataFrame([(0.08, 1.0, False)], "crop_padding_ratio double, upscale_factor double, deskew boolean")
    assert tuple(experiments.perturbed(c, 0, ["deskew"]).first()) == (0.12, 1.5, True)
    rank = experiments.ranked(spark.createDataFrame([("a", None), ("b", 0.2), ("c", 0.1)], "n string, s double"), "s", "n")
    assert [r["n"] for r in rank.orderBy("rank").collect()] == ["c", "b", "a"]


def test_papers(spark):
    assert one(spark, T.slug(F.lit("  A New--Thing! ")), a=1) == "a-new-thing"
    parts = spark.createDataFrame([("k", 1, ["B", "a"]), ("k", 2, ["A", "c", " "])], "k string, o int, items array<string>")
    assert papers.merge_lists(parts, "k", "o", "items").first()["items"] == ["B", "a", "c"]
    docs = spark.createDataFrame([(1, "a" * 70 + "\n\n" + "b" * 60), (2, None)], "id long, t string")
    assert [tuple(r) for r in papers.chunks(docs, "id", "t", 100).where("id = 1").collect()] == [(1, 0, "a" * 70), (1, 1, "b" * 60)]


def test_exports(spark):
    lines = spark.createDataFrame([("d", 1, 0, "x"), ("d", 1, 1, "y"), ("d", 2, 0, "z")], "f string, page int, line_index int, text string")
    assert writers.page_texts(lines, "f", "page").first()["content"] == "[Page 1]\nx\ny\f\n[Page 2]\nz"
    assert one(spark, writers.export_name(F.lit("a/b.pdf"), "txt"), a=1) == "b_ocr.txt"


def test_plugins(spark):
    r = Registry("detector", "n int")
    r.register("Fake", lambda: lambda f: f[["n"]] + 1)
    assert r.apply(spark.createDataFrame([(1,)], "n int"), "fake").first()["n"] == 2
    with pytest.raises(ValueError, match="unknown detector"):
        r.apply(spark.createDataFrame([(1,)], "n int"), "none")


def test_streaming(spark, tmp_path):
    from inkframe.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"page": "p", "text": "ND TP\\nmột dòng chữ"}\n')
    stream = ingest.measured(ingest.read_pages(spark, str(tmp_path / "in"), "page string, text string"))
    ingest.upsert_to(stream, str(tmp_path / "out"), "page", str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("line_index").select("is_hallucinated").collect()
    assert [r[0] for r in got] == [True, False]


def test_clamp_keeps_rejected_and_passes_over_far_neighbours(spark):
    rows = [(1, 0, 0, 100, 30), (1, 0, 10, 100, 40), (1, 300, 200, 400, 230), (2, 0, 0, 100, 30), (2, 0, 28, 100, 58)]
    got = {(r["page"], r["y1"]): (r["clamped_y1"], r["clamped_y2"], r["rejected"]) for r in pages.neighbour_clamp(spark.createDataFrame(rows, "page int, x1 int, y1 int, x2 int, y2 int"), "page").collect()}
    # too little is left between the two: both are rejected and keep their bounds
    assert got[1, 0] == (0.0, 30.0, True) and got[1, 10] == (10.0, 40.0, True)
    # no shared width, and centres too far apart: no neighbour
    assert got[1, 200] == (200.0, 230.0, False)
    assert got[2, 0] == (0.0, 25.6, False) and got[2, 28] == (32.4, 58.0, False)


def test_filters(spark):
    from inkframe.operators import filters

    crops = spark.createDataFrame([(1, 100, 20), (2, 40, 20), (3, 100, 90), (4, None, 5), (5, 4000, 20)], "id int, w int, h int")
    kept, gone = filters.split_by_reason(crops, filters.crop_reason(F.col("w"), F.col("h")))
    assert [r["id"] for r in kept.collect()] == [1]
    assert {r["id"]: r["reason"] for r in gone.collect()} == {2: "too_small", 3: "bad_aspect", 4: "invalid_image", 5: "bad_aspect"}
    assert one(spark, filters.parsed_int(F.col("t"), 7), t="x") == 7 and one(spark, filters.parsed_int(F.col("t")), t="12.9") == 12
    assert one(spark, filters.parsed_float(F.col("t"), 0.5), t="") == 0.5
    assert one(spark, filters.normalized_line_count_error(F.col("p"), F.col("e")), p=3, e=0) == 3
    assert one(spark, filters.picked(F.lit(None), F.col("t")), t="m") == "m"
