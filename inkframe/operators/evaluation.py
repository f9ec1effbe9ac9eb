"""Predictions against references: error rates by pair and group, line assignment, confusions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.functions import edits as E
from inkframe.functions.text import spaced


def pair_errors(pairs: DataFrame, predicted: str, reference: str) -> DataFrame:
    """pairs with distances, lengths and both rates."""
    p, r = spaced(F.col(predicted)), spaced(F.col(reference))
    out = pairs.withColumns({"_p": p, "_r": r, "_pw": E.words_of(F.col(predicted)), "_rw": E.words_of(F.col(reference))})
    out = out.withColumns(
        {
            "char_edits": E.char_distance(F.col("_p"), F.col("_r")),
            "ref_chars": F.length("_r"),
            "word_edits": E.word_distance(F.col("_pw"), F.col("_rw")),
            "ref_words": F.size("_rw"),
        }
    )
    rate = lambda d, n, o: F.when(F.col(n) > 0, F.col(d) / F.col(n)).when(o > 0, 1.0).otherwise(0.0)
    out = out.withColumns(
        {
            "cer": rate("char_edits", "ref_chars", F.length("_p")),
            "wer": rate("word_edits", "ref_words", F.size("_pw")),
            "exact": F.col("_p") == F.col("_r"),
        }
    )
    return out.drop("_p", "_r", "_pw", "_rw")


def error_summary(errors: DataFrame, *keys: str) -> DataFrame:
    """Macro rates (means), micro rates (sums over sums) and exact matches."""
    micro = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    return errors.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("cer").alias("macro_cer"),
        F.avg("wer").alias("macro_wer"),
        micro("char_edits", "ref_chars").alias("micro_cer"),
        micro("word_edits", "ref_words").alias("micro_wer"),
        F.count_if("exact").alias("exact_matches"),
    )


def assign_lines(predictions: DataFrame, references: DataFrame, page: str) -> DataFrame:
    """Per page: predicted and reference lines (line_no, text) paired one to one at the least total cer.

    line_cer and line_wer are means in which every line without a partner counts 1; a page with one side empty has 1.
    """

    def rate(d: int, n: int, m: int) -> float:
        return d / n if n else float(m > 0)

    def fold(key: tuple, preds: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        # a side without lines may come without columns
        p, r = ([" ".join((t or "").split()) for t in side.sort_values("line_no")["text"]] if len(side) else [] for side in (preds, refs))
        costs = np.array([[rate(E.distance(a, b), len(b), len(a)) for b in r] for a in p]).reshape(len(p), len(r))
        pairs = E.assign(costs)
        alone = len(p) + len(r) - 2 * len(pairs)
        words = 0.0
        for i, j in pairs:
            known = {w: chr(0x4E00 + k) for k, w in enumerate(dict.fromkeys(p[i].split() + r[j].split()))}
            a, b = ("".join(map(known.__getitem__, t.split())) for t in (p[i], r[j]))
            words += rate(E.distance(a, b), len(b), len(a))
        total = max(1, len(pairs) + alone)
        none = not p or not r
        return pd.DataFrame(
            [(key[0], len(pairs), len(p) - len(pairs), len(r) - len(pairs), 1.0 if none else (sum(costs[i, j] for i, j in pairs) + alone) / total, 1.0 if none else (words + alone) / total)],
            columns=[page, "matched", "unmatched_predictions", "unmatched_references", "line_cer", "line_wer"],
        )

    kind = predictions.schema[page].dataType.simpleString()
    schema = f"`{page}` {kind}, matched int, unmatched_predictions int, unmatched_references int, line_cer double, line_wer double"
    # new columns: where both sides come from one table, a count would drop those of one side that look the same
    references = references.select(*(F.col(c).alias(c, metadata={"side": "reference"}) for c in (page, "line_no", "text")))
    return predictions.groupBy(page).cogroup(references.groupBy(page)).applyInPandas(fold, schema)


def _operations(pairs: DataFrame, predicted: str, reference: str) -> DataFrame:
    """How often each step is in the alignments of all pairs: op, ref, pred, n. Counted where they are made, as whole texts have many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter = Counter()
            for p, r in zip(frame["p"], frame["r"], strict=True):
                seen.update(E.steps(p, r))
            yield pd.DataFrame([(*x, n) for x, n in seen.items()], columns=["op", "ref", "pred", "n"])

    texts = pairs.select(F.coalesce(F.col(predicted), F.lit("")).alias("p"), F.coalesce(F.col(reference), F.lit("")).alias("r"))
    return texts.mapInPandas(run, "op string, ref string, pred string, n long")


def confusions(pairs: DataFrame, predicted: str, reference: str) -> DataFrame:
    """How often each reference character was read as another: gt, pred, n."""
    ops = _operations(pairs, predicted, reference)
    return ops.where("op = 'sub'").groupBy(F.col("ref").alias("gt"), "pred").agg(F.sum("n").alias("n"))


def diacritic_errors(pairs: DataFrame, predicted: str, reference: str) -> DataFrame:
    """Error rates of reference characters with and without diacritics: has_diacritic, total, wrong, rate."""
    ops = _operations(pairs, predicted, reference).where("ref <> ''")
    marked = F.col("ref").rlike("^[À-ỹ]$") & F.col("ref").rlike(r"^\p{L}$")
    total, wrong = F.sum("n"), F.sum(F.when(F.col("op") != "match", F.col("n")).otherwise(0))
    return ops.groupBy(marked.alias("has_diacritic")).agg(total.alias("total"), wrong.alias("wrong"), (wrong / total).alias("rate"))


def confusion_matrix(counts: DataFrame, top: int) -> DataFrame:
    """The most frequent confusions as a matrix, zeros where there is none."""
    best = counts.orderBy(F.desc("n"), "gt", "pred").limit(top)
    return best.groupBy("gt").pivot("pred").sum("n").na.fill(0)
