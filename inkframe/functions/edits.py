"""Edit distances and error rates as expressions, and alignment of two texts where a path is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkframe.functions.text import spaced

#: Blocks of 64 in a strip of the table, blocks of all pairs and characters of their longer sides met at once.
_STRIP, _BLOCKS, _CHARS = 64, 8192, 1 << 22


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Edit distances of many pairs of texts (arrays of whole numbers) at once.

    Columns of the table are bits of 64-bit blocks, as in `distance`. At one step, block k of a pair is at character t - k
    of its longer text, so that all blocks of all pairs are one operation. Work is the product of the lengths over 64.
    """
    out = np.zeros(len(a), np.int64)
    sides = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    todo = []
    for i, (x, y) in enumerate(sides):
        if not len(x):
            out[i] = len(y)
        elif len(x) != len(y) or not np.array_equal(x, y):
            todo.append(i)
    blocks = lambda i: -(-len(sides[i][0]) // 64)
    todo.sort(key=lambda i: (blocks(i), len(sides[i][1])))
    start = 0
    while start < len(todo):
        w, end = blocks(todo[start]), start + 1
        while end < len(todo) and blocks(todo[end]) == w and (end - start) * min(w, _STRIP) < _BLOCKS and (end - start + 1) * len(sides[todo[end]][1]) <= _CHARS:
            end += 1
        group = todo[start:end]
        out[group] = _alike([sides[i][0] for i in group], [sides[i][1] for i in group], w)
        start = end
    return out


def _alike(short: list[np.ndarray], long: list[np.ndarray], blocks: int) -> np.ndarray:
    """Distances of pairs whose shorter sides have as many blocks: strip by strip, with what goes down between strips kept."""
    n, one, high = len(short), np.uint64(1), np.uint64(63)
    size, length = np.array([len(x) for x in short]), np.array([len(x) for x in long])
    top = int(length.max())
    within = lambda sizes: (np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    # a character of one pair is another than that of the next
    (pair, at), (lpair, lat) = within(size), within(length)
    chars, lchars = (np.concatenate(x).astype(np.int64) | k << 32 for x, k in ((short, pair), (long, lpair)))
    up, down = np.ones((top, n), np.uint64), np.zeros((top, n), np.uint64)
    score, last = size.astype(np.int64), ((size - 1) & 63).astype(np.uint64)
    for first in range(0, blocks, _STRIP):
        w = min(_STRIP, blocks - first)
        here = (at >= first * 64) & (at < (first + w) * 64)
        known, code = np.unique(chars[here], return_inverse=True)
        spots = np.zeros((w, len(known) + 1), np.uint64)
        np.bitwise_or.at(spots, ((at[here] >> 6) - first, code), one << (at[here] & 63).astype(np.uint64))
        found = np.minimum(np.searchsorted(known, lchars), len(known) - 1)
        seq = np.full((top, n), len(known), np.int64)
        seq[lat, lpair] = np.where(known[found] == lchars, found, len(known))
        more, less = np.full((w, n), ~np.uint64(0)), np.zeros((w, n), np.uint64)
        ups, downs = np.zeros((w, n), np.uint64), np.zeros((w, n), np.uint64)
        for t in range(top + w - 1):
            low, end = max(0, t - top + 1), min(w, t + 1)
            k = np.arange(low, end)
            if low == 0:
                ups[0], downs[0] = up[t], down[t]
            eq = spots[k[:, None], seq[t - k]]
            v, m, p, q = more[low:end], less[low:end], ups[low:end], downs[low:end]
            x = eq | m
            eq = eq | q
            same = (((eq & v) + v) ^ v) | eq
            rise, fall = m | ~(same | v), v & same
            if end == w:
                j = t - w + 1
                if first + w == blocks:
                    step = ((rise[-1] >> last) & one).astype(np.int64) - ((fall[-1] >> last) & one).astype(np.int64)
                    score += np.where(length > j, step, 0)
                else:
                    up[j], down[j] = rise[-1] >> high, fall[-1] >> high
            out_up, out_down = rise >> high, fall >> high
            rise, fall = (rise << one) | p, (fall << one) | q
            more[low:end], less[low:end] = fall | ~(x | rise), rise & x
            to = min(end + 1, w)
            ups[low + 1 : to], downs[low + 1 : to] = out_up[: to - low - 1], out_down[: to - low - 1]
    return score


def _edits(coded: Callable[[pd.Series], list[np.ndarray]]) -> Callable[[Column, Column], Column]:
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            out = pd.Series(pd.NA, index=a.index, dtype="Int32")
            there = a.notna() & b.notna()
            both = coded(pd.concat([a[there], b[there]]))
            n = int(there.sum())
            out[there] = distances(both[:n], both[n:])
            yield out

    # so that a filter on what is made of it doesn't have it made twice
    return F.pandas_udf(run, "int").asNondeterministic()


def char_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts, by Arrow batches."""
    return _edits(lambda s: [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in s])(a, b)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words."""

    def coded(s: pd.Series) -> list[np.ndarray]:
        known: dict[str, int] = {}
        return [np.array([known.setdefault(w, len(known)) for w in words], np.uint32) for words in s]

    return _edits(coded)(a, b)


def _rate(distance: Column, reference: Column, other: Column) -> Column:
    return F.when(reference > 0, distance / reference).when(other > 0, 1.0).otherwise(0.0)


def cer(predicted: Column, reference: Column) -> Column:
    """Character error rate: it may exceed 1; with an empty reference it is 0 or 1."""
    p, r = spaced(predicted), spaced(reference)
    return _rate(char_distance(p, r), F.length(r), F.length(p))


def words_of(column: Column) -> Column:
    return F.array_remove(F.split(spaced(column), " "), "")


def wer(predicted: Column, reference: Column) -> Column:
    p, r = words_of(predicted), words_of(reference)
    return _rate(word_distance(p, r), F.size(r), F.size(p))


def soft_match(a: Column, b: Column) -> Column:
    """1 minus the distance over the longer length; two empty texts match."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n > 0, 1 - char_distance(a, b) / n).otherwise(1.0)


def distance(a: str, b: str) -> int:
    """The edit distance of two texts, a row of the table as bits of whole numbers."""
    if not a or not b:
        return len(a) + len(b)
    at, total = 1 << len(a) - 1, len(a)
    for _, up in _bit_rows(a, b):
        total += up[0] & at > 0
        total -= up[1] & at > 0
    return total


def _bit_rows(predicted: str, reference: str) -> Iterator[tuple[int, tuple[int, int]]]:
    """Rows of the table by characters of the reference, a bit for each character of the prediction.

    Where a row is equal to the one before it on the diagonal, and where it is more and less than the one above.
    """
    full = (1 << len(predicted)) - 1
    spots: dict[str, int] = {}
    for j, c in enumerate(predicted):
        spots[c] = spots.get(c, 0) | 1 << j
    more, less = full, 0
    for c in reference:
        x = spots.get(c, 0) | less
        same = ((more + (x & more)) ^ more | x) & full
        up, down = (less | ~(more | same)) & full, more & same
        yield same, (up, down)
        x = (up << 1 | 1) & full
        more, less = ((down << 1) | ~(x | same)) & full, x & same


def steps(predicted: str, reference: str) -> list[tuple[str, str, str]]:
    """The alignment of two texts, back from their ends: (match, sub, del or ins; reference; predicted character).

    Of equal costs a substitution comes before a deletion, and that before an insertion.
    """
    n, m = len(reference), len(predicted)
    rows = list(_bit_rows(predicted, reference))
    out, i, j = [], n, m
    while i or j:
        same, (up, _) = rows[i - 1] if i else (0, (0, 0))
        if i and j and reference[i - 1] == predicted[j - 1]:
            out.append(("match", reference[i - 1], predicted[j - 1]))
            i, j = i - 1, j - 1
        elif i and j and not same >> j - 1 & 1:
            out.append(("sub", reference[i - 1], predicted[j - 1]))
            i, j = i - 1, j - 1
        elif i and (not j or up >> j - 1 & 1):
            out.append(("del", reference[i - 1], ""))
            i -= 1
        else:
            out.append(("ins", "", predicted[j - 1]))
            j -= 1
    return out[::-1]


def aligned(predicted: Column, reference: Column) -> Column:
    """The alignment of each pair, as an array of (op, reference, predicted)."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in parts:
            yield pd.Series([[{"op": o, "ref": x, "pred": y} for o, x, y in steps(a or "", b or "")] for a, b in zip(p, r, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<struct<op:string,ref:string,pred:string>>")(predicted, reference)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns paired one to one at the least total cost (shortest augmenting paths with potentials)."""
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            row = owner[at]
            slack = c[row - 1] - u[row] - v[1:]
            free = ~used[1:]
            better = free & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            pick = np.where(free, least[1:], np.inf)
            to = int(pick.argmin()) + 1
            step = pick[to - 1]
            u[owner[used]] += step
            v[used] -= step
            least[1:][free] -= step
            at = to
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)
