"""Queries without SQL work on whole texts: brute force on small tables."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.functions import edits as E
from inkframe.functions import text as T
from inkframe.operators import candidates, datasets, evaluation, pages, quality
from inkframe.plans import queries as q

HEAD = "the same first sixty characters stand at the head of this turn, "


def edits(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    t[:, 0], t[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return t


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("turns")
    rows = [(1, 0, "user", HEAD + "an apple"), (1, 1, "assistant", HEAD + "an ápple"), (2, 0, "user", HEAD + "one"), (2, 1, "assistant", HEAD + "ten"), (3, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def test_confusions_past_the_head(spark, turns):
    # an apple / an ápple: one substitution; one / ten: `one` to `ten` by sub o-t, sub n-e, sub e-n
    got = {(r["gt"], r["pred"]): r["n"] for r in q.char_confusion(spark, turns).collect()}
    assert got == {("a", "á"): 1, ("o", "t"): 1, ("n", "e"): 1, ("e", "n"): 1}
    assert edits(HEAD + "one", HEAD + "ten")[-1, -1] == 3


def test_diacritics_past_the_head(spark, turns):
    got = {r["has_diacritic"]: (r["total"], r["wrong"]) for r in q.diacritic_error(spark, turns).collect()}
    assert got == {False: (2 * len(HEAD) + len("an apple") + len("one"), 4)}


def test_line_assignment_past_the_head(spark, turns):
    got = {r["conv_id"]: (r["matched"], r["unmatched_references"], round(r["line_cer"], 9)) for r in q.line_assignment(spark, turns).collect()}
    n = len(HEAD)
    assert got == {1: (1, 0, round(1 / (n + 8), 9)), 2: (1, 0, round(3 / (n + 3), 9)), 3: (0, 1, 1.0)}


def brute_rescored(texts):
    marked = lambda t: ["<s>", *t.lower().split(), "</s>"]
    lines = [w for w in map(marked, texts.values()) if len(w) >= 3]
    n = {k: Counter(tuple(w[i : i + k]) for w in lines for i in range(len(w) - k + 1)) for k in (1, 2, 3)}
    total = sum(n[1].values())
    p = {g: math.log10(c / (n[k - 1][g[:-1]] if k > 1 else total)) for k in n for g, c in n[k].items()}

    def score(t):
        w, lm = marked(t), 0.0
        for i in range(2, len(w) + 1):
            most = min(3, i)
            k = next((k for k in range(most, 0, -1) if tuple(w[i - k : i]) in p), 0)
            lm += p[tuple(w[i - k : i])] + (most - k) * math.log10(0.4) if k else -7.0
        words = len(t.split())
        return -1.0 + 0.5 * lm / max(1, words) + 0.1 * words

    return {d: max((round(score(x), 9), -pos) for pos, x in enumerate((t[::-1], t))) for d, t in texts.items()}


def test_rescoring_reads_documents(spark, tmp_path):
    texts = {1: "the cat sat on the mat", 2: "the cat ran off", 3: "", 4: "one of the cats " * 50, 5: "Aba"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (round(r["score"], 9), -r["pos"]) for r in q.rescored_lines(spark, str(tmp_path)).collect()}
    want = brute_rescored(texts)
    assert set(got) == set(want) and all(got[d] == pytest.approx(want[d], abs=1e-8) for d in want)


def brute_merged(rows):
    kept = []
    for r in rows:
        for i, k in enumerate(kept):
            w, h = min(r[2], k[2]) - max(r[0], k[0]), min(r[3], k[3]) - max(r[1], k[1])
            shared = max(w, 0) * max(h, 0)
            areas = [max((b[2] - b[0]) * (b[3] - b[1]), 1.0) for b in (r, k)]
            close = abs((r[1] + r[3]) - (k[1] + k[3])) / 2 <= 0.3 * min(b[3] - b[1] for b in (r, k))
            if shared / (sum(areas) - shared) >= 0.65 or close and max(w, 0) >= 0.65 * min(b[2] - b[0] for b in (r, k)):
                if r[4] > k[4] and r[3] - r[1] <= 1.12 * (k[3] - k[1]):
                    kept[i] = r
                break
        else:
            kept.append(r)
    return kept


def brute_lines(rows):
    rows = sorted((r for r in rows if r[2] - r[0] >= 2 and r[3] - r[1] >= 2), key=lambda r: ((r[1] + r[3]) / 2, r[0]))
    m, lines = np.median([r[3] - r[1] for r in rows]) if rows else 0.0, []
    for r in rows:
        gaps = [abs((r[1] + r[3]) / 2 - np.median([(w[1] + w[3]) / 2 for w in line])) for line in lines]
        if gaps and min(gaps) <= 0.5 * m:
            lines[int(np.argmin(gaps))].append(r)
        else:
            lines.append([r])
    boxes = [(min(w[0] for w in x), min(w[1] for w in x), max(w[2] for w in x), max(w[3] for w in x), len(x)) for x in lines]
    return [b for b in boxes if b[2] - b[0] <= 1000 and b[3] - b[1] <= max(2.5 * m, m + 4)]


@pytest.fixture(scope="module")
def many_pages():
    # pages of all sizes, two longer than a batch, and boxes without width or height
    r = random.Random(1)
    sizes = [r.randrange(1, 9) for _ in range(20000)] + [700, 60]
    box = lambda: (x := r.randrange(200), y := r.randrange(60), x + r.randrange(-1, 300), y + r.randrange(-1, 40), r.randrange(9) / 9)
    return {p: [box() for _ in range(n)] for p, n in enumerate(sizes)}


def of_pages(spark, many_pages):
    rows = [(p, *map(float, b), i) for p, boxes in many_pages.items() for i, b in enumerate(boxes)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "page long, x1 double, y1 double, x2 double, y2 double, confidence double, idx int")
    return frame.repartition(8).cache()


def timed(spark, query):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    began = time.time()
    out = query.collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return out, time.time() - began


def test_merged_duplicates_of_many_pages(spark, many_pages):
    boxes = of_pages(spark, many_pages)
    boxes.count()
    got, seconds = timed(spark, pages.merge_duplicates(boxes, "page"))
    want = sorted((p, *b) for p, rows in many_pages.items() for b in brute_merged(rows))
    assert sorted((r["page"], r["x1"], r["y1"], r["x2"], r["y2"], r["confidence"]) for r in got) == want
    assert seconds < 15


def test_word_lines_of_many_pages(spark, many_pages):
    boxes = of_pages(spark, many_pages)
    boxes.count()
    got, seconds = timed(spark, pages.cluster_words(boxes.drop("confidence", "idx"), "page", 1000.0))
    some = {p: rows for p, rows in many_pages.items() if p % 10 == 0 or len(rows) > 9}
    want = sorted((p, *b) for p, rows in some.items() for b in brute_lines(rows))
    assert sorted((r["page"], r["x1"], r["y1"], r["x2"], r["y2"], r["words"]) for r in got if r["page"] in some) == want
    assert seconds < 15


def test_scores_by_groups_are_those_by_joins(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    words = ["a", "aba", "ab", "ba", "<s>", "</s>", "été", "no", "on", "level", "Straße", "x1", "İ"]
    texts = {i: " ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 40]))) for i in range(300)} | {-(1 << 40): " ab  ba\n", 1 << 50: "ab ba" * 900}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").cache()
    monkeypatch.setattr(candidates, "GROUP", 2000)
    got = {(r["doc_id"], r["pos"]): r["lm_logprob"] for r in candidates.corpus_scores(frame, "doc_id", "text").collect()}
    model = candidates.language_model(frame, "text").cache()
    for pos, side in ((0, frame.selectExpr("doc_id", "reverse(text) AS text")), (1, frame)):
        want = {r["doc_id"]: r["lm_logprob"] for r in candidates.score_texts(side, "doc_id", "text", model).collect()}
        assert set(want) == set(texts) and all(got[d, pos] == pytest.approx(v, abs=1e-6) for d, v in want.items())
    assert len(got) == 2 * len(texts)


def test_distances_of_many_pairs(monkeypatch):
    r = random.Random(4)
    text = lambda n, of: "".join(r.choices(of, k=n))
    sizes = [0, 1, 2, 63, 64, 65, 128, 129, 200, 330]
    pairs = [(text(r.choice(sizes), of), text(r.choice(sizes), of)) for of in ("ab", "abcdefgh ", "đ語🙂x") for _ in range(80)] + [("abc" * 50, "abc" * 50)]
    coded = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    for strip in (64, 2):
        monkeypatch.setattr(E, "_STRIP", strip)
        assert E.distances([coded(a) for a, _ in pairs], [coded(b) for _, b in pairs]).tolist() == [E.distance(a, b) for a, b in pairs]
    assert all(E.distance(a, b) == edits(a, b)[-1, -1] for a, b in pairs[:12])


def test_word_edits_of_long_texts(spark):
    # more than 8,192 different words, all but one of them in both
    words = [f"w{i}" for i in range(9000)]
    rows = [(" ".join(words), " ".join([*words[:8999], "other"])), ("a b", ""), ("", ""), (None, "a")]
    got = evaluation.pair_errors(spark.createDataFrame(rows, "p string, r string"), "p", "r").select("word_edits", "char_edits").collect()
    assert [(x["word_edits"], x["char_edits"]) for x in got] == [(1, 5), (2, 3), (0, 0), (1, 1)]


def test_long_pairs_in_time(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choices("abcdefgh ", k=8000)), "".join(r.choices("abcdefgh ", k=8000))) for i in range(48)]
    pairs = spark.createDataFrame(rows, "i int, p string, r string").repartition(4).cache()
    pairs.count()
    began = time.time()
    got = {x["i"]: x["d"] for x in pairs.select("i", E.char_distance(F.col("p"), F.col("r")).alias("d")).collect()}
    assert time.time() - began < 10
    assert all(got[i] == E.distance(a, b) for i, a, b in rows[:4])


def test_retention_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)
    scored = F.udf(lambda x: seen.add(1) or x / 100, "double")
    df = spark.range(-3, 104).select(scored("id").alias("s"))
    got = {x["step"]: (x["kept"], x["share"]) for x in datasets.retention(df, "s").collect()}
    assert seen.value <= 2 * 107 and got[0] == (104, 104 / 107) and got[100] == (4, 4 / 107)
    none = datasets.retention(df.where("s > 9"), "s").collect()
    assert len(none) == 101 and {(x["kept"], x["share"]) for x in none} == {(0, 0.0)}


def test_line_measures_of_odd_space(spark):
    odd = "".join(T.SPACES)
    r = random.Random(6)
    texts = ["", " ", odd, "a", " AB  CD ", "x​y", *("".join(r.choices(odd + "  abÀĐ1.🙂", k=r.randrange(30))) for _ in range(400))]
    lines = spark.createDataFrame([(t,) for t in texts], "line string")
    blank = set(odd)
    solid = lambda t: "".join(c for c in t if c not in blank)
    parts = lambda t: "".join(" " if c in blank else c for c in t).split(" ")
    measured = quality.line_measures(lines).withColumn("spaced", T.spaced(F.col("line"))).withColumn("old", T.visible_chars(F.col("line")))
    for row in measured.collect():
        words = [w for w in parts(row["line"]) if w]
        assert row["spaced"] == " ".join(words) and row["n_tokens"] == len(words) and row["n_visible"] == row["old"] == len(solid(row["line"]))


def test_letters_are_not_listed(spark):
    # an array of all letters of a line took most of the time of is_garbage
    lines = spark.createDataFrame([("abc",)], "line string")
    plan = lines.select(T.is_garbage(F.col("line")))._jdf.queryExecution().optimizedPlan().toString()
    assert r"\p{L}++" in plan and "extract_all" not in plan.split(r"\p{L}++")[0].split("lambda")[0]
    measured = quality.line_measures(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert r"\p{Lu}{2}" in measured and f"[{T.CAPITALS}]{{2}} " not in measured


def test_ngrams_are_packed(spark, monkeypatch):
    r = random.Random(7)
    texts = [" ".join(r.choices(["a", "B", "b", "été", "🙂", "x y", "c c"], k=r.randrange(0, 60))) for _ in range(400)] + ["", None, "one", "a " * 3000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    monkeypatch.setattr(candidates, "_AT_ONCE", 500)
    lines = [["<s>", *t.lower().split(), "</s>"] for t in texts if t]
    for order in (1, 2, 3, 4):
        want = Counter(" ".join(w[i : i + order]) for w in lines if len(w) >= order for i in range(len(w) - order + 1))
        got = candidates.ngrams(frame, "text", order)
        assert {x["gram"]: x["n"] for x in got.collect()} == want and got.count() == len(want)
    assert "packed" not in got.columns and "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
