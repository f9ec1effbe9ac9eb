"""The pipeline: each stage against brute force on its own input, with nulls, empty and long texts, repeats and clashing columns."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_near, brute_secrets, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)
rng = np.random.default_rng(3)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, found string, th long, _th long, hash long, score double"


@pytest.fixture(scope="module")
def docs(spark):
    german = "schen lich keit ung ver ge zu der".split()
    base, passage = " ".join(words(150)), " ".join(words(60))
    texts = [base, base, " ".join(w if i % 50 else "edit" for i, w in enumerate(base.split())), None, "", "1234 !!", "x", " ".join(words(40_000))]
    texts += [" ".join(words(30)) + " " + passage + " " + " ".join(words(20)) for _ in range(3)] + [" ".join(words(80, german)) for _ in range(20)]
    texts += [" ".join(words(25)) + f' token = "{"".join(rng.choice(list("0123456789abcdef"), 32))}" ' + " ".join(words(9)) for _ in range(6)]
    rows = [(i, t, "de" if 11 <= i < 31 else "en", "s", len(t or ""), "f", 1, 2, 3, 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[12], (14, base + " end", "en", "s", 9, "f", 1, 2, 3, 0.5), (None, " ".join(words(70)), "en", "s", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_language_id_keeps_what_has_a_language(spark, docs):
    out = STAGES["language_id"](spark, docs, "")
    assert out.columns == docs.columns
    lost = ids(docs) - ids(out)
    assert lost == Counter({3: 1, 4: 1, 5: 1})
    assert texts_of(out) <= texts_of(docs)


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    out = STAGES["near_duplicates"](spark, docs, "")
    assert out.columns == docs.columns
    # the row that shares id 14 with another text is a near copy of 0, so its id goes; repeated rows stay once
    _, root = brute_near([(r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()])
    same = {d for d, r in root.items() if d != r}
    got = ids(out)
    assert got[0] == 1 and got[12] == 1 and got[None] == 1 and not {1, 2} & set(got)
    assert set(got) >= set(root) - same - {14}


def test_suffix_dedup_leaves_no_repeat(spark, docs):
    some = docs.where("doc_id <> 7 or doc_id is null")
    out = STAGES["suffix_dedup"](spark, some, "")
    assert out.columns == docs.columns and ids(out) == ids(some)
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in some.collect()]
    seen = Counter(d[k : k + 200] for _, d in data for k in range(len(d) - 199))
    want = Counter()
    for doc, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want[doc, bytes(x for x, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")] += 1
    assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == want
    clash = {(r["found"], r["th"], r["_th"], r["hash"]) for r in out.where("doc_id is not null").collect()}
    assert clash == {("f", 1, 2, 3)}
    assert out.where("n_chars <> coalesce(length(text), 0)").count() == 0


def test_secret_scan_masks_all_base_finds(spark, docs):
    out = STAGES["secret_scan"](spark, docs, "")
    assert out.columns == docs.columns and ids(out) == ids(docs)
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for r in out.collect():
        assert not brute_secrets(re.sub(r"\[SECRET\]", " ", r["text"] or ""))
        if not any(brute_secrets(t) for d, t in before if d == r["doc_id"] and t):
            assert (r["doc_id"], r["text"]) in before


def test_pack_places_every_piece_once(spark, docs):
    got = STAGES["pack"](spark, docs, "").toPandas().sort_values(["sequence_id", "offset"])
    assert len(got[got["piece"] == 0]) == docs.count()
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_whole_run(spark, data):
    from inkframe.llm.common import staged

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, data), name)
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.select("doc_id").distinct().count() == before
