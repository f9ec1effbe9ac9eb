"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, only failing words are merged.

A proposal is right exactly if every two neighbouring tokens are compatible, i.e. merging their bytes gives the two
tokens again. Undoing the later of two formations, step by step, lists the pairs that met at the boundary and when; the
proposal fails where one of them has a rule that would have fired in that time. All steps work on arrays of words.

Defined results: a null text counts as empty; an empty text has no tokens; a special token's string in a text is that
token, as in the tokenizers library; lone marks, any white space and very long words follow the general rule.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from inkframe.llm.common import batches, keyed, small_batches, unkeyed

#: The pattern that cuts a text into words, a fixed part of the byte-level format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1 << 40)
#: Words kept in a worker's memory; beyond it the memory starts anew.
REMEMBERED = 800_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tables:
    """Vocabulary and merge rules as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, letters = data["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                self.bytes[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in rules], np.int64)
        right = np.array([vocab[b] for _, b in rules], np.int64)
        made = np.array([vocab[a + b] for a, b in rules], np.int64)
        self.size, key = size, left * size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        # how a token is formed: its rule's rank and halves; bytes are there from the start
        self.formed = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for rank in range(len(rules) - 1, -1, -1):
            self.formed[made[rank]], self.left[made[rank]], self.right[made[rank]] = rank, left[rank], right[rank]
        self.decimal = [b"%d," % i for i in range(size)]
        self._trie({i for i in vocab.values() if i not in set(self.special.values())})

    def _trie(self, ids: set[int]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in sorted(ids):
            at = 0
            for b in self.bytes[i]:
                step = nodes.get((at, b))
                if step is None:
                    step = nodes[at, b] = len(ends)
                    ends.append(-1)
                at = step
            ends[at] = i
        key = np.array([a * 256 + b for a, b in nodes], np.int64)
        order = np.argsort(key)
        self.step_keys, self.step_to = key[order], np.array([*nodes.values()], np.int64)[order]
        self.ends = np.array(ends, np.int64)

    def rule(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the rule for each pair; NEVER where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.made[at]


def compatible(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of tokens: whether no rule fires across their boundary."""
    good = np.ones(len(a), bool)
    at = np.arange(len(a))
    x, y = a.copy(), b.copy()
    x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
    while len(at):
        rank, _ = t.rule(x, y)
        # of two equal rules the left one fires first: it takes x away from the boundary, but y only after the boundary
        fires = (rank < NEVER) & (rank < x_until) & (rank <= y_until)
        good[at[fires]] = False
        fx, fy = t.formed[x], t.formed[y]
        go = ~fires & ((fx >= 0) | (fy >= 0))
        at, x, y, x_until, y_until, fx, fy = (v[go] for v in (at, x, y, x_until, y_until, fx, fy))
        undo = fx > fy
        x_until, y_until = np.where(undo, fx, x_until), np.where(undo, y_until, fy)
        x, y = np.where(undo, t.right[x], x), np.where(undo, y, t.left[y])
    return good


def merge_long(t: Tables, word: bytes) -> list[int]:
    """Exact merging of one long word with a heap: n log n."""
    ids = t.byte_id[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def rule(i: int, j: int) -> tuple[int, int]:
        pair = ids[i], ids[j]
        if pair not in known:
            r, m = t.rule(np.array([pair[0]]), np.array([pair[1]]))
            known[pair] = int(r[0]), int(m[0])
        return known[pair]

    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rule(i, i + 1)[0]) < NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = rule(i, j)[1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rule(i, after[i])[0]) < NEVER:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
        if before[i] >= 0 and (r := rule(before[i], i)[0]) < NEVER:
            heapq.heappush(heap, (r, before[i], ids[before[i]], ids[i]))
    return [i for i in ids if i >= 0]


def merge_words(t: Tables, words: list[bytes], longest: int = 48, rows: int = 4096) -> list[np.ndarray]:
    """Exact merging of many words at once: in each round every word's first best pair is merged."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = [i for i in order if len(words[i]) <= longest]
    for i in order[len(short) :]:
        out[i] = np.array(merge_long(t, words[i]), np.int64)
    for k in range(0, len(short), rows):
        part = short[k : k + rows]
        size = np.array([len(words[i]) for i in part])
        wide = int(size[-1])
        flat = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in part), np.uint8).reshape(len(part), wide)
        ids = np.where(np.arange(wide) < size[:, None], t.byte_id[flat], -1)
        rank = np.full((len(part), wide), NEVER)
        if wide > 1:
            pair, _ = t.rule(ids[:, :-1].ravel(), ids[:, 1:].ravel())
            rank[:, :-1] = np.where(ids[:, 1:].ravel() >= 0, pair, NEVER).reshape(len(part), wide - 1)
        live = np.arange(len(part))
        while len(live):
            best = rank[live].argmin(1)
            some = rank[live, best] < NEVER
            live, best = live[some], best[some]
            if not len(live):
                break
            _, made = t.rule(ids[live, best], ids[live, best + 1])
            take = np.minimum(np.arange(wide) + (np.arange(wide) > best[:, None]), wide - 1)
            moved, ranks = np.take_along_axis(ids[live], take, 1), np.take_along_axis(rank[live], take, 1)
            moved[:, -1], ranks[:, -1] = -1, NEVER
            row = np.arange(len(live))
            moved[row, best] = made
            for at in (best - 1, best):
                ok = (at >= 0) & (at + 1 < wide)
                a, b = moved[row, np.maximum(at, 0)], moved[row, np.minimum(at + 1, wide - 1)]
                r, _ = t.rule(a, b)
                ranks[row[ok], at[ok]] = np.where((b >= 0) & (a >= 0), r, NEVER)[ok]
            ids[live], rank[live] = moved, ranks
        for r, i in enumerate(part):
            out[i] = ids[r][ids[r] >= 0]
    return out


def propose(t: Tables, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Greedy longest matches of all words: token ids, and how many belong to each word."""
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    limit = np.repeat(end, size)
    token, step = np.full(len(flat), -1, np.int64), np.ones(len(flat), np.int64)
    at, node, depth = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
    while len(at):
        go = at + depth < limit[at]
        at, node = at[go], node[go]
        key = node * 256 + flat[at + depth]
        to = np.minimum(np.searchsorted(t.step_keys, key), len(t.step_keys) - 1)
        hit = t.step_keys[to] == key
        at, node, depth = at[hit], t.step_to[to[hit]], depth + 1
        whole = t.ends[node] >= 0
        token[at[whole]], step[at[whole]] = t.ends[node[whole]], depth
    word, now = np.arange(len(words)), end - size
    owners, found = [], []
    go = now < end
    word, now = word[go], now[go]
    while len(word):
        owners.append(word)
        found.append(token[now])
        now = now + step[now]
        go = now < end[word]
        word, now = word[go], now[go]
    if not owners:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=len(words))


class Codec:
    """Encoding and decoding, with a bounded memory of words already encoded."""

    def __init__(self, path: str):
        self.tables = Tables(path)
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.tables.special)) + ")") if self.tables.special else None
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, 4 bytes little-endian each."""
        t = self.tables
        ids, n = propose(t, words)
        stop = np.cumsum(n)
        flat, ends = ids.astype("<u4").tobytes(), (stop * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(ids) < 2:
            return out
        inner = np.ones(len(ids) - 1, bool)
        inner[stop[(stop > 0) & (stop < len(ids))] - 1] = False
        pair = (ids[:-1] * t.size + ids[1:])[inner]
        distinct, at = np.unique(pair, return_inverse=True)
        good = compatible(t, distinct // t.size, distinct % t.size)
        owner = np.repeat(np.arange(len(words)), n)[:-1][inner]
        failed = np.unique(owner[~good[at]]).tolist()
        for i, exact in zip(failed, merge_words(t, [words[i] for i in failed]), strict=True):
            out[i] = exact.astype("<u4").tobytes()
        return out

    def _cut(self, piece: str, lead: str) -> list[str]:
        if piece.isalpha():
            return [lead + piece]
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return [lead + piece[:-1], piece[-1]]
        return self.words.findall(lead + piece)

    def _learn(self, memory: dict[str, bytes], pieces: set[str], lead: str) -> None:
        fresh = list(pieces.difference(memory))
        if not fresh:
            return
        cut = [self._cut(p, lead) for p in fresh]
        words = list({w for ws in cut for w in ws})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        get = ids.__getitem__
        memory.update(zip(fresh, [get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for ws in cut], strict=True))

    @staticmethod
    def _simple(part: str) -> bool:
        """Whether all white space in a text is single spaces and line ends between other characters."""
        return not (
            part[0] in " \n"
            or part[-1] in " \n"
            or "  " in part
            or " \n" in part
            or "\n " in part
            or "\n\n" in part
            or not part.replace("\n", "").isprintable()
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as uint32 arrays."""
        if len(self.plain) + len(self.spaced) > REMEMBERED:
            self.plain.clear()
            self.spaced.clear()
        plans: list[list] = []
        plain: set[str] = set()
        spaced: set[str] = set()
        for text in texts:
            plan: list = []
            parts = self.special.split(text) if self.special and any(s in text for s in self.tables.special) else [text]
            for part in parts:
                if part in self.tables.special:
                    plan.append(self.tables.special[part])
                elif part and not self._simple(part):
                    plan.append((None, ws := self.words.findall(part)))
                    plain.update(ws)
                elif part:
                    # single spaces and line ends between other characters always end a word
                    lines = [line.split(" ") for line in part.split("\n")]
                    plan.append((True, lines))
                    for line in lines:
                        spaced.update(line)
                        plain.add(line[0])
            plain.add("\n")
            plans.append(plan)
        self._learn(self.plain, plain, "")
        self._learn(self.spaced, spaced, " ")
        get, after, line_end = self.plain.__getitem__, self.spaced.__getitem__, self.plain["\n"] if texts else b""
        out = []
        for plan in plans:
            parts = []
            for step in plan:
                if isinstance(step, int):
                    parts.append(np.uint32(step).tobytes())
                elif step[0] is None:
                    parts.extend(map(get, step[1]))
                else:
                    for k, line in enumerate(step[1]):
                        if k:
                            parts.append(line_end)
                        parts.append(get(line[0]))
                        parts.extend(map(after, line[1:]))
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.tables.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id and ids, its tokens."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        c = codec(path)
        for part in batches(frames):
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [x.astype(np.int32) for x in c.encode(part["text"].tolist())]})

    return unkeyed(keyed(docs).mapInPandas(run, "doc_id string, ids array<int>"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: the number of tokens, a hash of their decimal list, and a hash of the text decoded from them."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        c = codec(path)
        decimal = c.tables.decimal
        for part in batches(frames):
            n, listed, decoded = [], [], []
            for ids in c.encode(part["text"].tolist()):
                n.append(len(ids))
                listed.append(hashlib.sha256(b"".join(map(decimal.__getitem__, ids.tolist()))[:-1]).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": n, "ids_sha256": listed, "decoded_sha256": decoded})

    return unkeyed(keyed(docs).mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))
