r"""Secrets in whole texts: base expressions, and a linear-chain conditional random field decoded by Viterbi.

The field tags tokens as secret begin (B), inside (I) or outside (O) from shape, neighbouring words and features of the
file. It learns from the base expressions' own finds in a bounded sample of documents (`sample_rows`), without being
told the expressions, and adds what looks and stands like them elsewhere.

Its finds must not be the only labels: a field that learnt from them as they are would know the words that the expressions
ask for and take all other secrets for none. So a first field learns without seeing any words, from shapes and marks only;
what it takes for a secret in the sample is one for the second field, which learns with words and, for windows with a
secret, once more without them. Values beside words that the expressions don't know are found that way.

Only tokens of 6 characters or more that mix letters with digits, or 12 or more that mix cases or marks, can be B or I; that
is a rule of the model, so lines without such a token are O throughout and are not decoded, and short secrets of plain letters
are never added. Decoding works on a window of `AROUND` characters on both sides of such tokens, overlapping windows
joined, cut at line ends; no text is skipped.

Offsets are in code points, end exclusive. Defined results: a null text counts as empty; empty texts have no spans; where
the sample holds no secret, the base spans are all; repeated rows give the same result each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches, bounded_sample, keyed, small_batches, unkeyed

#: The kinds, in the order in which they are listed; `secret` is what the field adds.
KINDS = ("assign", "access", "hex", "secret")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Equals signs belong to a token only at its end: in front of a value they are what it stands beside.
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+(?:=+(?![A-Za-z0-9+/_.=-]))?|[^\sA-Za-z0-9+/_.-]")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{6,}")
AROUND = 80
SPACE = 1 << 14
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), in the order in which they are listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                out.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


_DIGIT, _LOWER, _UPPER, _MARK = map(re.compile, ("[0-9]", "[a-z]", "[A-Z]", "[+/_=]"))


def may_be_secret(token: str) -> bool:
    low = _LOWER.search(token)
    if len(token) < 6 or not (low or _UPPER.search(token)):
        return False
    if _DIGIT.search(token):
        return True
    # capitals inside, not only in front
    return len(token) >= 12 and bool(_MARK.search(token) or low and _UPPER.search(token, low.end()))


def windows(text: str) -> list[tuple[int, int]]:
    """Where tokens that may be secrets stand, with what is around them on their line."""
    out: list[list[int]] = []
    for m in CANDIDATE.finditer(text):
        if not may_be_secret(m.group()):
            continue
        a = max(text.rfind("\n", 0, m.start()) + 1, m.start() - AROUND)
        b = text.find("\n", m.end())
        b = min(len(text) if b < 0 else b, m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shape(token: str) -> str:
    s = re.sub("[a-z]+", "a", token[:64])
    s = re.sub("[A-Z]+", "A", s)
    s = re.sub("[0-9]+", "9", s)
    return s if len(s) <= 6 else f"{''.join(sorted(set(s)))}*"


def token_features(tokens: list[str], file: list[str], blind: bool = False) -> list[list[int]]:
    """Hashed features of each token; `blind`: without the words themselves."""
    look = []
    for w in tokens:
        kind = "hex" if re.fullmatch("[0-9a-f]+", w) else "HEX" if re.fullmatch("[0-9A-F]+", w) else "mix" if re.search("[0-9]", w) else "word" if w.isalpha() else "mark"
        look.append((w.lower() if len(w) <= 12 and not (blind and kind != "mark") else "", shape(w), kind, f"{min(len(w) // 8, 8)}"))
    edge = ("", "<>", "", "")
    out = []
    for i, w in enumerate(tokens):
        me = look[i]
        names = [*file, "b", f"s{me[1]}", f"k{me[2]}", f"l{me[3]}", f"kl{me[2]}{me[3]}", f"w{me[0]}", f"v{min(len(set(w)) // 4, 6)}"]
        for d in (-3, -2, -1, 1, 2):
            him = look[i + d] if 0 <= i + d < len(tokens) else edge
            names += [f"{d}w{him[0]}", f"{d}s{him[1]}"]
        out.append([xxhash.xxh32_intdigest(x) % SPACE for x in names])
    return out


def file_features(text: str) -> list[str]:
    head = f"n{min(len(text) // 2000, 5)}"
    return [head, f"c{int(text.count('=') * 200 > len(text))}", f"q{int(text.count(chr(34)) * 200 > len(text))}"]


@dataclass
class Field:
    """Emission weights by feature and tag, and transition weights; None: nothing learnt."""

    emit: np.ndarray | None
    move: np.ndarray | None


def _pad(windows_: list[tuple[list[list[int]], list[bool]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide, deep = max(len(x[0]) for x in windows_), len(windows_[0][0][0])
    ids = np.zeros((len(windows_), wide, deep), np.int64)
    can, live = np.zeros((len(windows_), wide), bool), np.zeros((len(windows_), wide), bool)
    for i, (f, c) in enumerate(windows_):
        ids[i, : len(f)], can[i, : len(f)], live[i, : len(f)] = f, c, True
    return ids, can, live


def _scores(field: Field, ids: np.ndarray, can: np.ndarray) -> np.ndarray:
    s = field.emit[ids].sum(2)
    s[..., 1:] = np.where(can[..., None], s[..., 1:], -1e9)
    return s


#: I follows B or I only.
_LEGAL = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]], float)


def decode(field: Field, ids: np.ndarray, can: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The best tags of each window, by Viterbi."""
    s, move = _scores(field, ids, can), field.move + _LEGAL
    value = s[:, 0].copy()
    value[:, INSIDE] -= 1e9
    back = np.zeros(s.shape, np.int8)
    for t in range(1, s.shape[1]):
        through = value[:, :, None] + move
        back[:, t] = np.where(live[:, t, None], through.argmax(1), np.arange(3))
        value = np.where(live[:, t, None], through.max(1) + s[:, t], value)
    tags = np.zeros(s.shape[:2], np.int8)
    state = value.argmax(1)
    rows = np.arange(len(s))
    for t in range(s.shape[1] - 1, -1, -1):
        tags[:, t] = state
        state = back[rows, t, state] if t else state
    return np.where(live, tags, 0)


def _learn(data: list[tuple[list[list[int]], list[bool], list[int]]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-4, seen_in: int = 3) -> Field:
    """Maximum likelihood by gradient steps on batches: forward and backward sums over the whole batch at once.

    Features of fewer than `seen_in` windows get no weight: labels are the base expressions' finds, and what these miss
    must not be learnt by heart as no secret.
    """
    deep = len(data[0][0][0])
    field = Field(np.zeros((SPACE, 3)), np.zeros((3, 3)))
    seen = np.full((SPACE, 3), 1e-2)
    rng = np.random.default_rng(7)
    order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    often = np.zeros(SPACE, np.int64)
    for f, _, _ in data:
        often[np.unique(np.array(f))] += 1
    rare = often < seen_in
    parts = [order[k : k + 128] for k in range(0, len(order), 128)]
    parts = [(*_pad([data[i][:2] for i in p]), [data[i][2] for i in p]) for p in parts]
    for _ in range(rounds):
        for k in rng.permutation(len(parts)).tolist():
            ids, can, live, tags = parts[k]
            n, wide = live.shape
            s, move = _scores(field, ids, can), field.move + _LEGAL
            gold = np.zeros((n, wide), np.int64)
            for i, t in enumerate(tags):
                gold[i, : len(t)] = t
            a = np.zeros((n, wide, 3))
            a[:, 0] = s[:, 0]
            a[:, 0, INSIDE] -= 1e9
            for t in range(1, wide):
                x = np.logaddexp.reduce(a[:, t - 1, :, None] + move, axis=1) + s[:, t]
                a[:, t] = np.where(live[:, t, None], x, a[:, t - 1])
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            b = np.zeros((n, wide, 3))
            d_move = np.zeros((3, 3))
            for t in range(wide - 1, 0, -1):
                on = live[:, t, None, None]
                step = move + (s[:, t] + b[:, t])[:, None, :]
                b[:, t - 1] = np.where(live[:, t, None], np.logaddexp.reduce(step, axis=2), b[:, t])
                both = np.exp(np.minimum(a[:, t - 1, :, None] + step - z[:, None, None], 0)) * on
                d_move -= both.sum(0)
                np.add.at(d_move, (gold[:, t - 1][live[:, t]], gold[:, t][live[:, t]]), 1)
            p = np.exp(np.minimum(a + b - z[:, None, None], 0))
            diff = (np.eye(3)[gold] - p)[live]
            flat = ids[live].ravel()
            grad = np.stack([np.bincount(flat, np.repeat(diff[:, j], deep), SPACE) for j in range(3)], 1) / n
            grad[rare] = 0
            grad -= decay * field.emit
            seen += grad * grad
            field.emit += rate * grad / np.sqrt(seen)
            field.move += 0.02 * np.clip(d_move / n, -5, 5)
    return field


def fit(docs: DataFrame, sample_rows: int = 20_000, most_windows: int = 4000) -> Field:
    """Fit on windows of about `sample_rows` documents, chosen by hash; `most_windows` of them are learnt from."""
    small_batches(docs.sparkSession)
    rows = keyed(bounded_sample(docs.select("doc_id", "text"), sample_rows, "doc_id", "text"))

    def label(frames: Iterator) -> Iterator:
        for part in batches(frames):
            out = []
            for text in part["text"]:
                spots = windows(text)
                if not spots:
                    continue
                found, file = base_spans(text), file_features(text)
                for a, b in spots:
                    marks = [(m.start() + a, m.end() + a) for m in TOKEN.finditer(text[a:b])]
                    tokens = [text[x:y] for x, y in marks]
                    tags, last = [], None
                    for x, y in marks:
                        owner = next(((s, k) for s, k, e, v in found if v < y and x < e), None)
                        can = may_be_secret(text[x:y])
                        tags.append(OUTSIDE if owner is None or not can else INSIDE if owner == last else BEGIN)
                        last = owner if can else None
                    can = [may_be_secret(w) for w in tokens]
                    both = ([z for y in token_features(tokens, file, blind) for z in y] for blind in (False, True))
                    out.append((*both, tags, can))
            yield pd.DataFrame(out, columns=["ids", "blind", "tags", "can"])

    got = rows.mapInPandas(label, "ids array<int>, blind array<int>, tags array<int>, can array<boolean>")
    got = bounded_sample(got, most_windows, "ids").toPandas()
    data = []
    for ids, blind, tags, can in zip(got["ids"], got["blind"], got["tags"], got["can"], strict=True):
        ids, blind = (np.asarray(x).reshape(len(tags), -1) for x in (ids, blind))
        # long lines are cut for learning only
        data += [(ids[k : k + 60].tolist(), blind[k : k + 60].tolist(), list(can[k : k + 60]), list(tags[k : k + 60])) for k in range(0, len(tags), 60)]
    return learn(data)


def learn(data: list[tuple[list, list, list[bool], list[int]]]) -> Field:
    """The field of windows with features, blind features, what may be secret, and tags of the base finds."""
    if not any(any(x[3]) for x in data):
        return Field(None, None)
    first = _learn([(blind, can, tags) for _, blind, can, tags in data])
    for k in range(0, len(data), 256):
        part = data[k : k + 256]
        for (_, _, _, tags), found in zip(part, decode(first, *_pad([x[1:3] for x in part])).tolist(), strict=True):
            tags[:] = [t or f for t, f in zip(tags, found, strict=False)]
    return _learn([(ids, can, tags) for ids, _, can, tags in data] + [(blind, can, tags) for _, blind, can, tags in data if any(tags)])


def field_spans(field: Field, text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans that the field adds beside the base ones."""
    spots = windows(text)
    if not spots or field.emit is None:
        return []
    file, marks, padded = file_features(text), [], []
    for a, b in spots:
        at = [(m.start() + a, m.end() + a) for m in TOKEN.finditer(text[a:b])]
        tokens = [text[x:y] for x, y in at]
        marks.append(at)
        padded.append((token_features(tokens, file), [may_be_secret(w) for w in tokens]))
    out = []
    for k in range(0, len(padded), 64):
        tags = decode(field, *_pad(padded[k : k + 64]))
        for at, row in zip(marks[k : k + 64], tags.tolist(), strict=True):
            last = None
            for (x, y), tag in zip(at, row, strict=False):
                if tag == BEGIN or tag == INSIDE and last is None:
                    last = [x, y]
                    out.append(last)
                elif tag == INSIDE:
                    last[1] = y
                else:
                    last = None
    return [(x, 3, y, x) for x, y in out if not any(s < y and x < e for s, _, e, _ in taken)]


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Per document: doc_id and spans (kind, start, end), by start, then kind."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # SPACE x 3 weights

    def run(frames: Iterator) -> Iterator:
        for part in batches(frames):
            rows = []
            for text in part["text"]:
                base = base_spans(text)
                both = sorted(base + field_spans(shared.value, text, base))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in both])
            yield pd.DataFrame({"doc_id": part["doc_id"], "spans": rows})

    return unkeyed(keyed(docs).mapInPandas(run, "doc_id string, spans array<struct<kind:string,start:int,end:int>>"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans, per document."""
    def listed(spans) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] != "secret")
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, field: Field, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by `mask`; other columns stay. Null texts stay null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def masked(text: str) -> str:
        base = base_spans(text)
        both = sorted((v, e) for _, _, e, v in base + field_spans(shared.value, text, base))
        out, at = [], 0
        for a, b in both:
            if b > at:
                out += [text[at : max(a, at)], mask if a >= at else ""]
                at = b
        return "".join([*out, text[at:]])

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t) if t else t)

    return docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text")))
