"""Removal of long repeated byte strings, with a run-length index over what the corpus shares.

Every string of `LENGTH` bytes contains windows of `GRAM` bytes; the least hash among them is its anchor, and depends on
nothing else. So two equal strings have the same anchor at the same place, and a document falls into blocks: runs of start
positions with one anchor, 60 to 90 bytes on average. The corpus is dealt by anchors:

1. an anchor seen once has no repeated string; one whose blocks all have the same bytes is repeated throughout. Both are
   settled by counts that are summed before they are shuffled, and so are equal blocks among different ones;
2. blocks left alone beside others of their anchor go, with one copy of each of the others, into small run-length
   indexes: a run-compressed Burrows-Wheeler transform whose run ends are sampled with the length they share with their
   neighbours. Matching statistics are streamed from the samples: between two of them, each length is one less than the
   one before. Starts whose match has `LENGTH` bytes are marked;
3. blocks of anchors with more than `CROWD` kinds are cut finer, into pieces keyed by the bytes that all their strings share,
   until no more than `CROWD` kinds have a key; these go into the same indexes.

Texts are dealt twice, to hand out the bytes of open blocks and to meet the marks, and are not written between jobs. Defined
results: a null text counts as empty; texts under `LENGTH` bytes keep everything; rows that repeat are documents too, so long
enough ones lose everything; doc_id may be null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches, free_name, mix64, release, small_batches, staged

LENGTH, GRAM = 200, 32
CROWD = 64
#: Starts of one piece of a crowded block, cut after cut.
PIECES = (16, 4, 1)
#: Bytes of one index, about.
INDEXED = 300_000
_POSITION = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Blocks of all texts: text index, first start, number of starts, anchor hash, hash of the block's bytes.

    Positions are packed beside hashes, so more bytes than the field holds are taken in slices. Slices of a long text share
    `LENGTH` - 1 bytes and no start; an anchor depends on its string only, so a slice's end may part a block, no more.
    """
    most = int(_POSITION) + 1
    if sum(map(len, texts)) <= most:
        return _packed_blocks(texts)
    step = most - LENGTH + 1
    cuts = [(i, k, t[k : k + most]) for i, t in enumerate(texts) for k in range(0, max(1, len(t) - LENGTH + 1), step)]
    group = [0]
    for _, _, piece in cuts:
        group.append(group[-1] + len(piece))
    out, a = [], 0
    while a < len(cuts):
        b = a + 1
        while b < len(cuts) and group[b + 1] - group[a] <= most:
            b += 1
        who, begin, *rest = _packed_blocks([x for _, _, x in cuts[a:b]])
        out.append((np.array([i for i, _, _ in cuts[a:b]], np.int64)[who], begin + np.array([k for _, k, _ in cuts[a:b]], np.int64)[who], *rest))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packed_blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Blocks of texts of no more bytes than positions fit in their field."""
    data = b"".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return empty
    h, step, n = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), _ODD, 1
    while n < GRAM:
        h = h[:-n] * step + h[n:]
        step, n = np.uint64(int(step) ** 2 % (1 << 64)), n * 2
    h = mix64(h)
    low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    span, wide = 1, LENGTH - GRAM + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    count = np.maximum(size - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    if not len(owner):
        return empty
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (low[start + (end - size)[owner]] & _POSITION).astype(np.int64)
    first = np.nonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])[0]
    starts = np.diff(np.r_[first, len(owner)])
    who, begin = owner[first], start[first]
    a = (begin + (end - size)[who]).tolist()
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[x : x + n + LENGTH - 1]) for x, n in zip(a, starts.tolist(), strict=True)), np.uint64, len(first))
    return who, begin, starts, h[at[first]].view(np.int64), content.view(np.int64)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of keys, from 0."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    return rank


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context: whether the string of `length` bytes at each start is found at any other start of any context."""
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    stop = np.cumsum(sizes)
    n, kinds = int(stop[-1]), len(contexts)
    symbol = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + kinds
    symbol[stop - 1] = np.arange(kinds)
    wide = np.zeros(n + 4, np.int64)
    wide[:n] = symbol + 1
    base = kinds + 258
    key = wide[:n]
    for k in range(1, 4):
        key = key * base + wide[k : n + k]
    rank = _ranks(key)
    levels, span = [(4, rank)], 4
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        rank = _ranks(rank * (n + 1) + after)
        span *= 2
        levels.append((span, rank))
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    # the transform, compressed to its runs, with the suffixes at the ends of runs as samples
    turned = symbol[suffix - 1]
    head = np.nonzero(turned[1:] != turned[:-1])[0] + 1
    above, below = suffix[head - 1], suffix[head]
    shared = np.zeros(len(head), np.int64)
    for span, r in reversed(levels):
        x, y = above + shared, below + shared
        ok = (x < n) & (y < n)
        same = np.zeros(len(head), bool)
        same[ok] = r[x[ok]] == r[y[ok]]
        shared += np.where(same, span, 0)
    for _ in range(3):
        x, y = above + shared, below + shared
        ok = (x < n) & (y < n)
        same = np.zeros(len(head), bool)
        same[ok] = symbol[x[ok]] == symbol[y[ok]]
        shared += same

    def streamed(where: np.ndarray, value: np.ndarray, edge: int) -> np.ndarray:
        sample = np.full(n, -1, np.int64)
        sample[where], sample[edge] = value, 0
        last = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
        return sample[last] - (np.arange(n) - last)

    match = np.maximum(streamed(below, shared, int(suffix[0])), streamed(above, shared, int(suffix[-1])))
    found = match >= length
    return [found[a : a + max(0, b - length)] for a, b in zip((stop - sizes).tolist(), sizes.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags: first, count."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return list(zip(a.tolist(), (b - a).tolist(), strict=True))


def _pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A run of starts in one long: a block never has more starts than fit in 8 bits."""
    return start * 256 + n


def cover(size: int, marks: np.ndarray) -> np.ndarray:
    """Which bytes the strings at marked runs of starts cover."""
    edge = np.zeros(size + 1, np.int64)
    start = marks // 256
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + marks % 256 + LENGTH - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _finished(data: bytes, marks: np.ndarray) -> tuple[int, int, int, str, bytes]:
    gone = cover(len(data), marks)
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return len(data), len(data) - len(kept), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), kept


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _occurrences(docs: DataFrame, whole: bool) -> DataFrame:
    def run(frames: Iterator) -> Iterator:
        for part in batches(frames, 1_000_000):
            who, begin, n, anchor, content = blocks([t.encode() for t in part["text"]])
            out = {"anchor": anchor, "content": content}
            if whole:
                out |= {"doc_id": part["doc_id"].to_numpy()[who], "th": part["th"].to_numpy()[who], "at": _pack(begin, n)}
            yield pd.DataFrame(out)

    schema = "anchor long, content long" + ", doc_id string, th long, at long" * whole
    out = _rows(docs).mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")) if whole else out


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The blocks asked for, with their bytes. Only these leave the texts: no text is written here."""

    def run(frames: Iterator) -> Iterator:
        for part in batches(frames, 1_000_000):
            rows = []
            for doc, th, text, asks in zip(part["doc_id"], part["th"], part["text"], part["asks"], strict=True):
                data = text.encode()
                for x in asks:
                    a, n = divmod(x["at"], 256)
                    rows.append((doc, th, x["anchor"], x["at"], x["single"], x["crowd"], data[a : a + n + LENGTH - 1]))
            yield pd.DataFrame(rows, columns=["doc_id", "th", "anchor", "at", "single", "crowd", "bytes"])

    asks = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "anchor", "single", "crowd")).alias("asks"))
    a, b = _rows(docs).withColumn("doc_id", F.col("doc_id").cast("long")).alias("a"), asks.alias("b")
    met = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.th = b.th")).select(F.col("a.doc_id").cast("string").alias("doc_id"), "a.th", "a.text", "b.asks")
    out = met.mapInPandas(run, "doc_id string, th long, anchor long, at long, single boolean, crowd int, bytes binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _indexed(contexts: DataFrame) -> DataFrame:
    """Runs of repeated starts of the single blocks, from indexes over whole anchors."""

    def run(frames: Iterator) -> Iterator:
        def settle(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            found = repeated_starts(frame["bytes"].tolist())
            for doc, th, at, single, flags in zip(frame["doc_id"], frame["th"], frame["at"], frame["single"], found, strict=True):
                if single:
                    out += [(doc, th, (at // 256 + a) * 256 + n) for a, n in _runs(flags)]
            return pd.DataFrame(out, columns=["doc_id", "th", "at"])

        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            if not len(frame):
                continue
            cuts = np.nonzero(np.r_[True, frame["anchor"].to_numpy()[1:] != frame["anchor"].to_numpy()[:-1]])[0]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(frame)], strict=True):
                group = frame.iloc[a:b]
                if size >= INDEXED and held[-1]["anchor"].iat[-1] != group["anchor"].iat[0]:
                    yield settle(pd.concat(held, ignore_index=True))
                    held, size = [], 0
                held.append(group)
                size += int(group["bytes"].str.len().sum())
        if held:
            yield settle(pd.concat(held, ignore_index=True))

    ready = contexts.select(F.col("doc_id").cast("string").alias("doc_id"), "th", "anchor", "at", "single", "bytes")
    out = ready.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(run, "doc_id string, th long, at long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _anchor_at(data: bytes, anchor: int) -> int:
    """Where the window whose hash is the anchor stands first."""
    h, step, n = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), _ODD, 1
    while n < GRAM:
        h = h[:-n] * step + h[n:]
        step, n = np.uint64(int(step) ** 2 % (1 << 64)), n * 2
    return int(np.argmax(mix64(h).view(np.int64) == anchor))


def _cut(contexts: DataFrame, size: int) -> DataFrame:
    """Contexts cut into pieces of at most `size` starts, at places counted from the anchor, with a key of what they share.

    All strings that begin in one place of `size` starts contain the same `LENGTH` - `size` + 1 bytes, the piece's core. Equal
    strings stand at equal distances from their anchor, so their pieces have equal cores: the core's hash is the new key.
    """

    def run(frames: Iterator) -> Iterator:
        for whole in frames:
            for k in range(0, len(whole), 1024):
                frame, rows = whole.iloc[k : k + 1024], []
                for doc, th, anchor, at, single, phase, data in zip(*(frame[c] for c in ("doc_id", "th", "anchor", "at", "single", "phase", "bytes")), strict=True):
                    start, n = divmod(at, 256)
                    if phase < 0:
                        phase = -_anchor_at(data, anchor) % PIECES[0]
                    for x in sorted({0, *range(-phase % size, n, size)}):
                        place = x - (phase + x) % size
                        y = min(n, place + size)
                        piece = data[x : y + LENGTH - 1]
                        key = xxhash.xxh3_64_intdigest(data[place + size - 1 : place + LENGTH], seed=anchor % (1 << 64))
                        ga, gb = np.frombuffer(xxhash.xxh3_128_digest(piece), np.int64).tolist()
                        rows.append((doc, th, key - (key >> 63 << 64), (start + x) * 256 + y - x, single, (phase + x) % PIECES[0], ga, gb, piece))
                yield pd.DataFrame(rows, columns=["doc_id", "th", "anchor", "at", "single", "phase", "ga", "gb", "bytes"])

    made = contexts.select(F.col("doc_id").cast("string").alias("doc_id"), "th", "anchor", "at", "single", "phase", "bytes").mapInPandas(
        run, "doc_id string, th long, anchor long, at long, single boolean, phase int, ga long, gb long, bytes binary"
    )
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _uncrowded(contexts: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Contexts of crowded anchors, cut finer and finer until those that can match fit an index: (marks found by counts, contexts,
    the tables that both read).

    Equal pieces are one kind, and kinds seen twice are repeated throughout. Pieces of one start with one key are of one kind,
    so no crowd is left after the last cut.
    """
    marks, ready, written = [], [], []
    kind = ["anchor", "ga", "gb"]
    contexts = contexts.withColumn("phase", F.lit(-1))
    for size in PIECES:
        pieces = staged(_cut(contexts, size), "pieces")
        facts = [F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "at", "single", "phase")).alias("ref"), F.min("bytes").alias("bytes")]
        kinds = pieces.groupBy(*kind).agg(*facts)
        kinds = staged(kinds.select(*kind, "c", "ref.doc_id", "ref.th", "ref.at", (F.col("ref.single") & (F.col("c") == 1)).alias("single"), "ref.phase", "bytes"), "kinds")
        twice = pieces.where("single").join(kinds.where("c > 1").select(*kind), kind)
        marks.append(staged(twice.select("doc_id", "th", "at"), "marks"))
        groups = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.max("single").alias("open")).where("n > 1 and open")
        # written first, so that Spark can split the joins below
        groups = staged(groups.select("anchor", "n"), "groups")
        here = staged(kinds.join(groups, "anchor").drop("c", "ga", "gb"), "contexts")
        release(pieces, kinds, groups)
        written += [marks[-1], here]
        ready.append(here.where(F.col("n") <= CROWD))
        contexts = here.where(F.col("n") > CROWD)
        if contexts.isEmpty():
            break
    columns = ["doc_id", "th", "anchor", "at", "single", "bytes"]
    return reduce(DataFrame.unionByName, marks), reduce(DataFrame.unionByName, (x.select(columns) for x in ready)), written


def find_repeats(docs: DataFrame) -> DataFrame:
    """Per document with repeated strings: doc_id, th (a hash of its text) and marks, its runs of repeated starts. Written."""
    small_batches(docs.sparkSession)
    anchors = _occurrences(docs, False).groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"))
    # written first, so that Spark can split the join below at very common anchors
    anchors = staged(anchors.where("n > 1").select("anchor", F.expr("a <> b").alias("mixed")), "anchors")
    seen = staged(_occurrences(docs, True).join(anchors, "anchor"), "blocks")
    release(anchors)
    mixed = seen.where("mixed")
    kinds = staged(mixed.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct("at", "doc_id", "th")).alias("ref")), "kinds")
    crowds = kinds.groupBy("anchor").agg(F.count("*").cast("int").alias("crowd"), F.min("c").alias("least")).where("least = 1").select("anchor", "crowd")
    crowds = staged(crowds, "crowds")
    asked = kinds.join(crowds, "anchor").select("ref.doc_id", "ref.th", "ref.at", "anchor", (F.col("c") == 1).alias("single"), "crowd")
    settled = seen.where("not mixed").select("doc_id", "th", "at").unionByName(
        mixed.join(kinds.where("c > 1").select("anchor", "content"), ["anchor", "content"]).select("doc_id", "th", "at")
    )
    # small tables first: the texts are dealt when as little else as can be lies on disk
    asked, settled = staged(asked, "asked"), staged(settled, "settled")
    release(seen, kinds, crowds)
    contexts = staged(_contexts(docs, asked), "contexts")
    release(asked)
    marks, finer, written = _uncrowded(contexts.where(F.col("crowd") > CROWD).drop("crowd"))
    plain = contexts.where(F.col("crowd") <= CROWD).select(finer.columns)
    found = staged(_indexed(plain.unionByName(finer)), "marks")
    release(contexts)
    every = settled.unionByName(found).unionByName(marks)
    out = staged(every.groupBy("doc_id", "th").agg(F.collect_set("at").alias("marks")), "repeats")
    release(settled, found, *written)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    marks = find_repeats(docs)

    def run(frames: Iterator) -> Iterator:
        for part in batches(frames):
            rows = []
            for doc, text, found in zip(part["doc_id"], part["text"], part["marks"], strict=True):
                rows.append((doc, *_finished(text.encode(), np.asarray([] if found is None else found, np.int64))[:4]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    a, b = _rows(docs).withColumn("doc_id", F.col("doc_id").cast("long")).alias("a"), marks.alias("b")
    joined = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.th = b.th"), "left")
    late = joined.select(F.col("a.doc_id").cast("string").alias("doc_id"), "a.text", "b.marks")
    late = late.mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = staged(late.withColumn("doc_id", F.col("doc_id").cast("long")), "removed")
    release(marks)
    return out


def trim_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes removed; what is left of a character cut in two goes too. Null texts stay null, and all
    other columns stay, whatever their names."""
    marks = find_repeats(docs)
    own = free_name("th", docs.columns)
    a, b = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).alias("a"), marks.alias("b")
    joined = a.join(b, F.expr(f"a.doc_id <=> b.doc_id and a.`{own}` = b.th"), "left")

    def run(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = [
            _finished(text.encode(), np.asarray(m, np.int64))[4].decode("utf-8", "ignore") if text and m is not None else text
            for text, m in zip(texts, marks, strict=True)
        ]
        return pd.Series(out, dtype=object)

    trimmed = F.pandas_udf(run, "string")(F.col("a.text"), F.col("b.marks"))
    return joined.select(*(trimmed.alias("text") if c == "text" else F.col(f"a.`{c}`") for c in docs.columns))
