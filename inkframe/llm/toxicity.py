"""Toxicity by a logistic model whose scores must not move when identity terms are swapped.

Labelled texts that name a group get a counterfactual twin in which each term is replaced by another of its kind. The
squared change of the score between the two is part of the loss, so a group's name carries no weight of its own.
Features are the distinct words of a text; those that tell the labels apart (chi-square) enter the model.

The model is fitted on the driver from a bounded sample of labelled rows (`sample_rows`); scoring is narrow.

Defined results: a null or empty text has the score of a text without any feature; without labelled rows of both labels
every score is 0; rows whose label is null aren't learnt from; repeated rows give the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches, bounded_sample, crc_mod, keyed, small_batches, staged, unkeyed

SPACE = 1 << 22
STEM = 5
REMEMBERED = 500_000
#: Terms that name groups (fixed values), in the languages of the corpus; each is swapped for the next of its line.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("schwul", "lesbisch", "bisexuell"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"), ("behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("homosexuel", "lesbienne", "bisexuel"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"), ("handicapés", "aveugles", "sourds"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("homosexual", "lesbiana"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"), ("discapacitados", "ciegos", "sordos"),
)


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each term with the next of its line; a term of several lines is swapped as in the first."""
    out: dict[str, str] = {}
    for g in groups:
        for i, w in enumerate(g):
            out.setdefault(w, g[(i + 1) % len(g)])
    return out


def plain(word: str) -> str:
    """The word in lower case, without what isn't letters or digits at its ends."""
    if word.isalnum():
        return word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def feature(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % SPACE


def features(word: str) -> tuple[int, ...]:
    """The word's own feature, and for longer words one for their first letters: what is unseen may share a stem."""
    return (feature(word),) if len(word) <= STEM else (feature(word), feature(word[:STEM] + "*"))


def _document_features(text: str, swap: dict[str, str] | None = None) -> list[int] | None:
    """Distinct features of a text; of its twin, if terms are swapped, and None where no term is there to swap."""
    words = {x for w in set(text.split()) if (x := plain(w))}
    if swap is not None:
        if words.isdisjoint(swap):
            return None
        words = {swap.get(w, w) for w in words}
    return sorted({f for w in words for f in features(w)})


@dataclass
class Model:
    """The features' weights and the bias; bias None: nothing learnt."""

    features: np.ndarray
    weights: np.ndarray
    bias: float | None


def fit(labelled: DataFrame, sample_rows: int = 10_000, least_rows: int = 5, chi_square: float = 11.0, most: int = 512, ridge: float = 0.03, counterfactual: float = 50.0, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """Fit from rows with text and toxic (0 or 1); about `sample_rows` of them, chosen by hash, if there are more.

    `identity`: lines of terms that may stand for one another; `counterfactual`: the weight of a score's squared change.
    """
    swap = swaps(identity)
    small_batches(labelled.sparkSession)
    rows = bounded_sample(labelled.where("toxic is not null").select("toxic", F.coalesce("text", F.lit("")).alias("text")), sample_rows, "toxic", "text")

    def tally(frames: Iterator) -> Iterator:
        import pandas as pd

        for part in batches(frames):
            every: list[int] = []
            bad: list[int] = []
            for t, y in zip(part["text"], part["toxic"], strict=True):
                f = _document_features(t)
                every += f
                bad += f if y > 0 else []
            at, df = np.unique(np.array(every, np.int64), return_counts=True)
            tf = np.bincount(np.searchsorted(at, np.array(bad, np.int64)), minlength=len(at))
            yield pd.DataFrame({"feature": np.r_[at, -1], "df": np.r_[df, len(part)], "tf": np.r_[tf, int((part["toxic"] > 0).sum())]})

    counts = rows.mapInPandas(tally, "feature long, df long, tf long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    counts = staged(counts, "features")
    whole = counts.where("feature = -1").first()
    if whole is None or not 0 < whole["tf"] < whole["df"]:
        return Model(np.empty(0, np.int64), np.empty(0), None)
    n, pos = whole["df"], whole["tf"]
    want = F.col("df") * (pos / n)
    chi = (F.col("tf") - want) ** 2 / (want * (1 - pos / n) * (1 - F.col("df") / n))
    best = counts.where((F.col("feature") >= 0) & (F.col("df") >= least_rows) & (F.col("df") < n) & (F.col("tf") > want))
    best = best.withColumn("chi", chi).where(F.col("chi") >= chi_square).orderBy(F.desc("chi"), "feature").limit(most)
    chosen = np.array(sorted(r["feature"] for r in best.collect()), np.int64)
    twins = [f for w in swap if not {*features(w)}.isdisjoint(chosen.tolist()) for f in features(swap[w])]
    chosen = np.unique(np.r_[chosen, twins].astype(np.int64))
    place = {f: i for i, f in enumerate(chosen.tolist())}

    def extract(frames: Iterator) -> Iterator:
        import pandas as pd

        for part in batches(frames):
            has = [[place[f] for f in _document_features(t) if f in place] for t in part["text"]]
            twin = [None if (f := _document_features(t, swap)) is None else [place[x] for x in f if x in place] for t in part["text"]]
            yield pd.DataFrame({"toxic": part["toxic"].astype("int32"), "has": has, "twin": twin})

    got = rows.mapInPandas(extract, "toxic int, has array<int>, twin array<int>").toPandas()
    y = (got["toxic"].to_numpy() > 0).astype(float)

    def matrix(lists: list) -> np.ndarray:
        out = np.zeros((len(lists), len(chosen) + 1))
        out[:, -1] = 1
        for i, x in enumerate(lists):
            out[i, np.asarray(x, np.int64)] = 1
        return out

    x = matrix(list(got["has"]))
    pairs = [i for i, v in enumerate(got["twin"]) if v is not None]
    change = x[pairs] - matrix([got["twin"][i] for i in pairs])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    penalty += counterfactual * change.T @ change
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(chosen, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id and score, between 0 and 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `most` features and their twins
    memory: dict[str, tuple[int, ...]] = {}

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        m = shared.value
        place = {f: i for i, f in enumerate(m.features.tolist())}
        for part in batches(frames):
            if m.bias is None:
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": 0.0})
                continue
            if len(memory) > REMEMBERED:
                memory.clear()
            cut = [set(t.split()) for t in part["text"]]
            for w in set().union(*cut).difference(memory):
                memory[w] = tuple(place[f] for f in features(plain(w)) if f in place)
            found = [{i for w in ws for i in memory[w]} for ws in cut]
            raw = np.array([m.bias + sum(m.weights[i] for i in sorted(f)) for f in found])
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": 1 / (1 + np.exp(-np.clip(raw, -500, 500)))})

    return unkeyed(keyed(docs).mapInPandas(run, "doc_id string, score double"))


def label_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, folds: int = 5) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score every document."""
    seen = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = bounded_sample(seen, sample_rows, "doc_id")
    texts = docs.where(crc_mod("doc_id", folds) != 0).select("doc_id", "text")
    model = fit(texts.join(F.broadcast(seen), "doc_id"), sample_rows)
    return score(docs, model).select(
        "doc_id", (crc_mod("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
