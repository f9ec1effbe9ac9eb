"""Packing token sequences: documents are cut into pieces, pieces are packed into sequences of a fixed capacity.

Only lengths matter to the plan, and there are no more lengths than the capacity: the plan is made on the driver from a
histogram of at most `capacity` counts, however many pieces there are. It is a list of patterns (lengths that share a
sequence) with how often each is used. Sums of single lengths, pairs and triples are indexed (`Sums`); gaps are closed exactly by
what the index has for them, as many at once as the counts allow; what can't be closed is packed best fit.

Pieces then find their places by rank within their length. Ranks come from counts by (length, salt), so one very common
length is dealt over many tasks.

Defined results: a null text counts as empty; a document has at least its closing id; repeated rows are packed each;
an empty table gives no pieces; ids may be null or repeat; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.common import batches, keyed, small_batches, staged, unkeyed

CAPACITY = 2048
#: Words kept in a worker's memory; beyond it the memory starts anew. Capitals and marks after a word aren't kept, as they cost little.
REMEMBERED = 700_000
#: The same for words kept in arrays, and their ids.
LISTED, LISTED_IDS = 2_000_000, 16_000_000
#: Bytes of texts that are cut into words at once, about.
SLICE = 2_000_000
#: Pieces of one length that are ranked in one task, about.
RANKED = 200_000


def _latin_kinds() -> bytes:
    """What each Latin-1 character is to the tokenizer: 0 white space, 1 a letter, 2 a number, 3 anything else."""
    space = {*range(9, 14), 0x20, 0x85, 0xA0}
    return bytes(0 if i in space else {"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 3) for i in range(256))


LATIN_KINDS = _latin_kinds()
#: Lower case of Latin-1 characters, each one character of Latin-1 again.
LATIN_LOWER = bytes(ord(chr(i).lower()) for i in range(256))
GAP = re.compile(rb"[ \n]")
#: Masks for the first n bytes of a little-endian number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def latin_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words in lower-case Latin-1 text: runs of letters or marks, single numbers, 's, 're and so on."""
    text, kind = np.frombuffer(blob, np.uint8), np.frombuffer(blob.translate(LATIN_KINDS), np.uint8)
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    start, end = np.flatnonzero(edge[:-1] & (kind > 0)), np.flatnonzero(edge[1:] & (kind > 0)) + 1
    # a single apostrophe before letters takes one or two of them with it
    lone = np.flatnonzero((text[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1) & (start[1:] == end[:-1]))
    lone = lone[kind[start[lone + 1]] == 1]
    if len(lone):
        first = text[end[lone]]
        second = np.where(end[lone + 1] - end[lone] > 1, text[np.minimum(end[lone] + 1, len(text) - 1)], 0)
        two = np.isin(first.astype(np.int64) << 8 | second, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        takes = np.where(np.isin(first, list(b"stmd")), 1, 2 * two)
        end[lone] += takes
        start[lone + 1] += takes
        some = start < end
        start, end = start[some], end[some]
    return start, end


class Listed:
    """Token ids of lower-case Latin-1 words, in arrays: words of up to 15 bytes are two numbers, found by open addressing."""

    def __init__(self) -> None:
        self.size = self.used = 0
        self.low, self.high = np.empty(1024, np.uint64), np.empty(1024, np.uint64)
        self.first, self.count = np.empty(1024, np.int64), np.empty(1024, np.int32)
        self.ids = np.empty(4096, np.uint32)
        self.slots = np.full(1 << 12, -1, np.int32)
        self.long: dict[bytes, int] = {}

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it isn't listed."""
        slot = self._slot(low, high)
        out = self.slots[slot]
        at = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & (len(self.slots) - 1)
            out[at] = found = self.slots[slot]
            go = (found >= 0) & ((self.low[found] != low[at]) | (self.high[found] != high[at]))
            at, slot = at[go], slot[go]
        return out

    def _enter(self, number: np.ndarray) -> None:
        slot = self._slot(self.low[number], self.high[number])
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            go = self.slots[slot] != number
            number, slot = number[go], (slot[go] + 1) & (len(self.slots) - 1)

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Lists words, none of them twice, with their ids one after another; words of no bytes aren't entered. Returns their numbers."""
        old, new = self.size, self.size + len(low)
        for name in ("low", "high", "first", "count"):
            values = getattr(self, name)
            if new > len(values):
                setattr(self, name, np.resize(values, new * 3 // 2))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, (self.used + len(ids)) * 3 // 2)
        self.low[old:new], self.high[old:new], self.count[old:new] = low, high, count
        self.first[old:new] = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(ids)] = ids
        self.size, self.used = new, self.used + len(ids)
        number = np.arange(old, new, dtype=np.int32)
        if 2 * new > len(self.slots):
            self.slots = np.full(1 << (2 * new).bit_length(), -1, np.int32)
            self._enter(np.flatnonzero(self.high[:new]).astype(np.int32))
        else:
            self._enter(number[high > 0])
        return number


class Words:
    """Token ids of texts by a tokenizer file whose words never cross a space or a line end; words are remembered.

    Texts in Latin-1 are cut and looked up as arrays, many at a time. Others, and those with a special token, go word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.listed = Listed()
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, fresh: list[str]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for k in range(0, len(fresh), 10_000):
            part = fresh[k : k + 10_000]
            self.known.update(zip(part, [array("I", e.ids).tobytes() for e in encode(part, add_special_tokens=False)], strict=True))

    def _ids(self, words: list[bytes], together: int = 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin-1 words one after another, and how many each has; some words share a call, as each ends with a closing token."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        text = [w.decode("latin-1") for w in words]
        calls = [" ".join(text[k : k + together]) for k in range(0, len(text), together)]
        found = [e.ids for k in range(0, len(calls), 1000) for e in encode(calls[k : k + 1000], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        end = np.flatnonzero(self.closes[ids]) + 1
        if len(end) != len(words) or len(end) and end[-1] != len(ids):
            if together == 1:
                return ids, np.array([len(x) for x in found], np.int64)
            return self._ids(words, 1)
        return ids, np.diff(end, prepend=0)

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-case Latin-1 texts without special tokens."""
        if self.listed.size > LISTED or self.listed.used > LISTED_IDS:
            self.listed = Listed()
        known = self.listed
        blob = b"\n".join(texts) + b" " * 16
        start, end = latin_words(blob)
        size = end - start
        wide = np.ndarray((len(blob) - 7,), "<u8", blob, 0, (1,))  # the 8 bytes from each place on
        low = wide[start] & FIRST[np.minimum(size, 8)]
        high = wide[np.minimum(start + 8, len(wide) - 1)] & FIRST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(size > 15)
        high[long] = 0
        number = known.find(low, high)
        fresh = np.flatnonzero((number < 0) & (high > 0))
        fresh = fresh[np.lexsort((low[fresh], high[fresh]))]
        a, b = low[fresh], high[fresh]
        head = np.ones(len(fresh), bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        one = fresh[head]
        names = [blob[x:y] for x, y in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        rest = [blob[x:y] for x, y in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        new = list(set(rest).difference(known.long))
        added = known.add(
            np.concatenate([low[one], np.zeros(len(new), np.uint64)]),
            np.concatenate([high[one], np.zeros(len(new), np.uint64)]),
            *self._ids(names + new),
        )
        known.long.update(zip(new, added[len(one) :].tolist(), strict=True))
        number[fresh] = added[np.cumsum(head) - 1]
        number[long] = [known.long[w] for w in rest]
        count = known.count[number]
        stop = np.concatenate([[0], np.cumsum(count)])
        ids = known.ids[np.repeat(known.first[number] - stop[:-1], count) + np.arange(stop[-1])]
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = stop[np.searchsorted(start, begin)].tolist()
        return [ids[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 4 bytes little-endian each."""
        out: list[list[bytes]] = [[] for _ in texts]
        part: list[tuple[int, bytes]] = []
        held, others = 0, []

        def settle() -> None:
            for (k, _), ids in zip(part, self._plain([t for _, t in part]), strict=True):
                out[k].append(ids)
            part.clear()

        for k, text in enumerate(texts):
            try:
                data = text.encode("latin-1").translate(LATIN_LOWER)
            except UnicodeEncodeError:
                data = None
            if data is None or any(s in data for s in self.special):
                others.append(k)
                continue
            at = 0
            while at < len(data):
                # a long text is cut at a space or line end
                gap = GAP.search(data, at + SLICE) if len(data) - at > SLICE else None
                part.append((k, data[at : gap.start() if gap else len(data)]))
                held += len(part[-1][1])
                at += len(part[-1][1])
                if held >= SLICE:
                    settle()
                    held = 0
        if part:
            settle()
        for k, ids in zip(others, self._any([texts[k] for k in others]) if others else (), strict=True):
            out[k] = [ids]
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _any(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in any characters."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        fresh = set().union(*cut).difference(self.known)
        # plain letters have their lower case's ids, and a full stop or comma after letters is a word of its own
        simple, rest = [], []
        for w in fresh:
            if w.isascii() and w.isalpha():
                simple.append((w, w.lower(), ""))
            elif w[-1:] in (".", ",") and w.isascii() and w[:-1].isalpha():
                simple.append((w, w[:-1].lower(), w[-1]))
            else:
                rest.append(w)
        stems = {s for _, s, _ in simple}.union({m for _, _, m in simple}, rest)
        self._learn(list(stems.difference(self.known)))
        known = self.known
        cheap = {w: known[s] + known[m] for w, s, m in simple if w != s}
        known.update(cheap)
        out = [b"".join(map(known.__getitem__, ws)) for ws in cut]
        for w in cheap:
            del known[w]
        return out


_WORDS: dict[str, Words] = {}


def words(path: str) -> Words:
    """One tokenizer for each file and worker."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A document's ids end with `end_id`."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator) -> Iterator:
        import os

        import pandas as pd

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        w, last, wide = words(path), np.uint32(end_id).tobytes(), 4 * capacity
        for part in batches(frames):
            rows = []
            for doc, ids in zip(part["doc_id"], w.encode(part["text"].tolist()), strict=True):
                ids += last
                for k in range(0, len(ids), wide):
                    piece = ids[k : k + wide]
                    rows.append((doc, k // wide, k // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return unkeyed(keyed(docs).mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long"))


class Sums:
    """Which lengths, pairs and triples of lengths have a sum, under counts that only fall.

    Pairs are listed by sum once; triples by sum as a length and a sum of pairs. What has run out is dropped from the front
    of a list for good, so all look-ups together walk each list once.
    """

    def __init__(self, avail: np.ndarray):
        self.avail, self.held = avail, 0
        have = avail > 0
        self.pairs: list[list[int]] = [[] for _ in avail]  # the smaller length, the smallest last
        for total in range(2, len(avail)):
            low = np.arange(1, total // 2 + 1)
            self.pairs[total] = low[have[low] & have[total - low]][::-1].tolist()
        some = np.array([bool(x) for x in self.pairs])
        self.triples: list[list[int]] = [[] for _ in avail]  # one of the three, the largest last
        for total in range(3, len(avail)):
            one = np.arange(1, total - 1)
            self.triples[total] = one[have[one] & some[total - one]].tolist()

    def _enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.avail[x] >= lengths.count(x) for x in lengths)

    def _live_pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Pairs with that sum, those that have run out dropped."""
        found = self.pairs[total]
        left = lambda x: self.avail[x] + (x == self.held) > 0  # noqa: E731  without the piece in use
        while found and not (left(found[-1]) and left(total - found[-1])):
            found.pop()
        return ((total - b, b) for b in reversed(found))

    def fill(self, gap: int, held: int) -> tuple[int, ...] | None:
        """Lengths that close the gap exactly, beside one piece of length `held` that is in use already."""
        self.held = held
        self.avail[held] -= 1
        try:
            if self.avail[gap] > 0:
                return (gap,)
            for pair in self._live_pairs(gap):
                if self._enough(pair):
                    return pair
            ones = self.triples[gap]
            # the held length may look run out for this gap only, so nothing but true ends are dropped
            while ones and self.avail[ones[-1]] + (ones[-1] == held) <= 0:
                ones.pop()
            for c in reversed(ones):
                if self.avail[c] > 0:
                    for pair in self._live_pairs(gap - c):
                        if self._enough((c, *pair)):
                            return (c, *pair)
            return None
        finally:
            self.avail[held] += 1


def _uses(avail: np.ndarray, lengths: tuple[int, ...]) -> int:
    return min(int(avail[x]) // lengths.count(x) for x in set(lengths))


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that share a sequence, with how many sequences use each. histogram[n]: pieces of length n."""
    avail = np.zeros(capacity + 1, np.int64)
    avail[: len(histogram)] = histogram[: capacity + 1]
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        n = _uses(avail, lengths)
        for x in lengths:
            avail[x] -= n
        out.append((lengths, n))

    if avail[capacity]:
        use((capacity,))
    open_lengths = []
    sums = Sums(avail)
    for length in range(capacity - 1, 0, -1):
        while avail[length] > 0:
            found = sums.fill(capacity - length, length)
            if found is None:
                open_lengths.append((length, int(avail[length])))
                avail[length] = 0
                break
            use((length, *found))
    # best fit, longest first: open sequences by what they hold, with how many hold it
    bins: dict[tuple[int, ...], int] = {}
    for length, n in open_lengths:
        while n:
            fits = [b for b in bins if sum(b) + length <= capacity]
            if fits:
                b = max(fits, key=sum)
                k = min(n, bins[b])
                bins[b] -= k
                if not bins[b]:
                    del bins[b]
                bins[(*b, length)] = bins.get((*b, length), 0) + k
                n -= k
            else:
                each = capacity // length
                if n >= each:
                    bins[(length,) * each] = bins.get((length,) * each, 0) + n // each
                if n % each:
                    rest = (length,) * (n % each)
                    bins[rest] = bins.get(rest, 0) + 1
                n = 0
    return out + list(bins.items())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run of ranks, the sequence of that rank, and the offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return {x: tuple(np.array(v, np.int64) for v in zip(*rows, strict=True)) for x, rows in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (any columns, `length` among them) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row[0]] = row[1]
    where = places(plan(histogram, capacity))
    salts = max(64, int(histogram.max()) // RANKED)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(inside))
        .join(counts, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
        .drop("_before", "_salt")
    )
    shared = spark.sparkContext.broadcast(where)  # a few runs for each length
    names = pieces.columns

    def run(frames: Iterator) -> Iterator:
        for part in frames:
            length, rank = part["length"].to_numpy(), part["_rank"].to_numpy()
            sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for x in np.unique(length).tolist():
                first, start, at = shared.value[x]
                rows = np.nonzero(length == x)[0]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = start[k] + rank[rows] - first[k], at[k]
            yield part[names].assign(sequence_id=sequence, offset=offset)

    kinds = [(f.name, "string" if f.name == "doc_id" else f.dataType.simpleString()) for f in pieces.schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds) + ", sequence_id long, offset long"
    return unkeyed(ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack; the pieces, without their ids, are written once between the two."""
    return pack(staged(cut_pieces(docs, path, capacity), "pieces"), capacity)
