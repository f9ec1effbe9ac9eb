"""Language of whole texts: scripts narrow the candidates, and a Viterbi pass over word scores labels spans.

A word's score in a language is a naive Bayes score of its letter n-grams (1 to 4, with word ends). Languages that don't
use the word's script are no candidates for it. Changing the language between two words costs `switch`. The path is
exact for texts of any length: chunks of words are solved for every entry state at once, then joined.

Training reads a bounded sample of labelled rows (`sample_rows`); counts are made by Spark, and at most
languages x buckets of them come to the driver.

Defined results: a null text, or one without letters, is `und` with score 0; without labelled rows all texts are; words
of an unknown script keep all languages as candidates; repeated rows give the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches, bounded_sample, mix64, small_batches

BUCKETS = 1 << 15
ORDERS = 4
CHUNK = 128
REMEMBERED = 300_000
#: First code points of script blocks (fixed values); a letter belongs to the last block that starts at or before it.
SCRIPTS = {
    "latin": (0x41, 0x1E00, 0x2C60, 0xA720, 0xFB00, 0xFF21),
    "greek": (0x370, 0x1F00),
    "cyrillic": (0x400, 0x1C80, 0x2DE0, 0xA640),
    "armenian": (0x530,),
    "hebrew": (0x590, 0xFB1D),
    "arabic": (0x600, 0x750, 0x8A0, 0xFB50, 0xFE70),
    "indic": (0x900,),
    "thai": (0xE00,),
    "georgian": (0x10A0,),
    "hangul": (0x1100, 0x3130, 0xAC00),
    "kana": (0x3040, 0x31F0, 0xFF66),
    "han": (0x2E80, 0x3400, 0xF900, 0x20000),
    "other": (0, 0x250 + 0x120 - 1, 0xF00, 0x1200, 0x2000, 0xD7B0, 0x10000),
}
_EDGES = np.array(sorted(x for v in SCRIPTS.values() for x in v), np.int64)
_NAMES = list(SCRIPTS)
_SCRIPT_AT = np.array([next(i for i, k in enumerate(_NAMES) if e in SCRIPTS[k]) for e in _EDGES.tolist()])


def letters_of(word: str) -> str:
    """The word's letters in lower case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter n-grams of words (letters only, none empty): the word's index and the bucket of each."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    out_w, out_b = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1_000_003) + codes[n - 1 :]
        same = owner[:m] == owner[n - 1 :]
        out_w.append(owner[:m][same])
        out_b.append((mix64(h[same] + np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out_w), np.concatenate(out_b)


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    return _SCRIPT_AT[np.searchsorted(_EDGES, first, "right") - 1]


@dataclass
class Model:
    """Log-probabilities by bucket and language, and the languages allowed for each script."""

    languages: list[str]
    logp: np.ndarray
    allowed: np.ndarray


def fit(labelled: DataFrame, sample_rows: int = 4000, smoothing: float = 0.5, used: float = 0.01) -> Model:
    """Fit from rows with text and lang; about `sample_rows` of them, chosen by hash, if there are more."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    rows = bounded_sample(rows, sample_rows, "lang", "text")

    def count(frames: Iterator) -> Iterator:
        total: dict[str, np.ndarray] = {}
        for part in batches(frames):
            for lang, texts in part.groupby("lang", sort=False)["text"]:
                words = [x for t in texts for w in t.split() if (x := letters_of(w))]
                if words:
                    _, b = grams(words)
                    c = np.bincount(b, minlength=BUCKETS + len(_NAMES))
                    c[BUCKETS:] += np.bincount(scripts(words), minlength=len(_NAMES))
                    total[lang] = total.get(lang, 0) + c
        for lang, c in total.items():
            at = np.nonzero(c)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    counts = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    c = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    c[counts["bucket"].to_numpy(), [languages.index(x) for x in counts["lang"]]] = counts["n"].to_numpy()
    n, by_script = c[:BUCKETS], c[BUCKETS:]
    logp = np.log((n + smoothing) / (n.sum(0) + smoothing * BUCKETS)) / ORDERS
    allowed = by_script >= used * np.maximum(by_script.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(languages, logp.astype(np.float32), allowed)


def best_paths(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word. scores: words x labels, texts one after the other, `sizes` words each."""
    labels = scores.shape[1]
    chunks = -(-sizes // CHUNK)
    text_of = np.repeat(np.arange(len(sizes)), chunks)
    first = np.cumsum(chunks) - chunks
    inner = np.arange(len(text_of)) - first[text_of]
    begin = (np.cumsum(sizes) - sizes)[text_of] + inner * CHUNK
    length = np.minimum(sizes[text_of] - inner * CHUNK, CHUNK)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    value = np.full((len(order), labels, labels), -1e9, np.float32)
    value[:, np.arange(labels), np.arange(labels)] = 0
    back = np.empty((len(scores), labels, labels), np.int8)
    keep = np.arange(labels, dtype=np.int8)
    deep = int(length.max(initial=0))
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(deep)]
    for t in range(deep):
        k = live[t]
        v, at = value[:k], begin[:k] + t
        best, arg = v.max(2) - switch, v.argmax(2).astype(np.int8)
        changed = v < best[:, :, None]
        back[at] = np.where(changed, arg[:, :, None], keep)
        value[:k] = np.where(changed, best[:, :, None], v) + scores[at][:, None, :]
    # join the chunks of each text
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_text = np.argsort(-chunks, kind="stable")
    by_text = by_text[chunks[by_text] > 0]
    many = chunks[by_text]
    total = np.zeros((len(by_text), labels), np.float32)
    entry = np.empty((len(order), labels), np.int8)
    for j in range(int(many.max(initial=0))):
        k = int(np.searchsorted(-many, -j, "left"))
        at = place[first[by_text[:k]] + j]
        through = total[:k, :, None] + value[at]
        entry[at] = through.argmax(1)
        total[:k] = through.max(1)
    leave, enter = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    state = total.argmax(1)
    for j in range(int(many.max(initial=0)) - 1, -1, -1):
        k = int(np.searchsorted(-many, -j, "left"))
        at = place[first[by_text[:k]] + j]
        leave[at] = state[:k]
        enter[at] = state[:k] = entry[at, state[:k]]
    out = np.empty(len(scores), np.int64)
    state = leave.copy()
    for t in range(deep - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        out[at] = state[:k]
        state[:k] = back[at, enter[:k], state[:k]]
    return out


class Scorer:
    """Word scores by a model, with a bounded memory of words already scored."""

    def __init__(self, model: Model):
        self.model = model
        self.start()

    def start(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        """The index of each word of all texts; new words are scored first."""
        if len(self.known) > REMEMBERED:
            self.start()
        fresh = list({w for ws in texts for w in ws}.difference(self.known))
        if fresh:
            base, need = len(self.known), len(self.known) + len(fresh)
            while need > len(self.letters):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            plain = [letters_of(w) for w in fresh]
            at = [i for i, w in enumerate(plain) if w]
            if at:
                words = [plain[i] for i in at]
                owner, bucket = grams(words)
                s = np.stack([np.bincount(owner, self.model.logp[bucket, j], len(words)) for j in range(len(self.model.languages))], 1)
                s -= s.max(1, keepdims=True)
                s[~self.model.allowed[scripts(words)]] = -50
                rows = base + np.array(at)
                self.scores[rows] = np.maximum(s, -50)
                self.letters[rows] = [len(w) for w in words]
            self.known.update(zip(fresh, range(base, need), strict=True))
        get = self.known.__getitem__
        return np.fromiter((i for ws in texts for i in map(get, ws)), np.int64, sum(map(len, texts)))


def labelled(docs: DataFrame, model: Model, column: str, switch: float = 6.0) -> DataFrame:
    """docs with one more column: a struct of lang_pred, score (the share of letters in spans of that language) and spans.

    spans: language, first word and end word (exclusive) of each run of one language, words split at white space.
    """
    small_batches(docs.sparkSession, 2048)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets
    scorers: list[Scorer] = []

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.array([*shared.value.languages, "und"], dtype=object)
        if not scorers:
            scorers.append(Scorer(shared.value))
        scorer, n = scorers[0], len(names) - 1
        texts = [t.split() for t in frame["text"]]
        sizes = np.array([len(t) for t in texts], np.int64)
        if n:
            at = scorer.look_up(texts)
            labels = best_paths(scorer.scores[at], sizes, switch)
            letters = scorer.letters[at]
        else:
            labels = letters = np.zeros(int(sizes.sum()), np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        wide = max(n, 1)
        share = np.bincount(owner * wide + labels, letters, len(texts) * wide).reshape(len(texts), wide)
        total = share.sum(1)
        pred = np.where(total > 0, share.argmax(1), n)
        score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
        turn = np.nonzero(np.r_[True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])])[0] if len(owner) else np.empty(0, np.int64)
        begin = np.cumsum(sizes) - sizes
        runs: list[list] = [[] for _ in texts]
        for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(owner)], strict=False):
            i = int(owner[a])
            if total[i] > 0:
                runs[i].append({"lang": names[labels[a]], "first": a - int(begin[i]), "end": b - int(begin[i])})
        return pd.DataFrame({"lang_pred": names[pred], "score": score, "spans": runs})

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            parts = [label(p) for p in batches([pd.DataFrame({"text": series.fillna("")})])]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "spans": []})

    kind = "lang_pred string, score double, spans array<struct<lang:string,first:int,end:int>>"
    # not deterministic for the optimiser only: a filter on the result must not run it twice
    return docs.withColumn(column, F.pandas_udf(run, kind).asNondeterministic()(F.col("text")))


def identify(docs: DataFrame, model: Model, switch: float = 6.0) -> DataFrame:
    """Per document: doc_id, lang_pred, score and spans."""
    return labelled(docs.select("doc_id", "text"), model, "_found", switch).select("doc_id", "_found.*")
