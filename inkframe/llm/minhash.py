"""Near duplicates by circulant MinHash, banding, and exact verification on full shingle sets.

Words are runs of other than white space, A-Z lower-cased; a document's set holds its distinct 5-word shingles (the whole
sequence, if it has fewer words). Documents whose sets are equal form a class, and only classes are compared.

Signature: one permutation scatters shingles over a circle of `CIRCLE` places, the second orders the places; coordinate k
is the least place seen when the second is turned by k. All coordinates of a shingle are thus one slice of one array.
`BANDS` bands of `ROWS` coordinates make buckets: a pair with similarity 0.75 shares none with a probability of 3e-7.

Candidates are never all pairs of a bucket at once. Each bucket links its members to one leader; links are verified on the
full sets and joined to components. The leader has then met everyone and goes, and only members that may still be linked
with a member of another component stay, so buckets of two and buckets of copies end there. What is left of crowded buckets is
dealt anew by rare shingles, in an exact way (see `_refined`), and then the rest goes on with 16, 256 ... leaders, until no
bucket is left. "May be linked" is exact too: sizes, and shingles that others have, must allow the similarity. No pair is
dropped by an estimate, and there is no cap.

Shingles are compared as 64-bit hashes: two different ones of a pair of documents agree by chance once in 1e13 pairs or so.

Defined results: null or empty texts, or texts without words, have n_shingles 0, link with nothing and stand for
themselves; rows with a null doc_id take no part and get a null component; rows that repeat an id share its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.common import batches, components, keyed, mix64, release, small_batches, staged

WORDS = 5
BANDS, ROWS = 40, 4
CIRCLE = 1 << 16
#: From so many members on, what is left of a bucket is dealt anew by rare shingles.
CROWDED = 8
#: Each pass has so many times the leaders of the one before.
MORE = 16
#: Words of more bytes have a hash of their own: polynomials over a power of two can be made to collide from 1,024 bytes on.
LONG_WORD = 256
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _circle(turns: int) -> np.ndarray:
    """The second permutation, reversed and continued, so that a shingle's coordinates are a slice of `turns` places."""
    order = np.random.default_rng(20_240_607).permutation(CIRCLE).astype(np.uint16)
    return np.concatenate([order, order[: turns - 1]])


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and how many each text has."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    flat = _LOWER[flat]
    gap = _SPACES[flat]
    start = np.nonzero(~gap & np.r_[True, gap[:-1]])[0]
    end = np.nonzero(~gap & np.r_[gap[1:], True])[0] + 1
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    up, down = _powers(len(flat))
    total = np.r_[np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up)]
    word = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.nonzero(end - start > LONG_WORD)[0].tolist():
        word[i] = xxhash.xxh3_64_intdigest(flat[start[i] : end[i]].tobytes())
    owner = np.searchsorted(np.cumsum(size), start, "right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    h = word.copy()
    for k in range(1, WORDS):
        step = np.uint64(0xA24BAED4963EE407 + 2 * k)
        h[:-k] = h[:-k] * step + word[k:] if k < len(word) else h[:-k]
    whole = np.nonzero((count > 0) & (count < WORDS))[0]
    at = np.nonzero(np.arange(len(word)) + WORDS <= (first + count)[owner])[0]
    h, who = h[at], owner[at]
    if len(whole):
        few = []
        for i in whole.tolist():
            x = np.uint64(count[i])
            for w in word[first[i] : first[i] + count[i]]:
                x = np.uint64((int(x) * 0xFF51AFD7ED558CCD + int(w)) & 0xFFFFFFFFFFFFFFFF)
            few.append(x)
        h, who = np.r_[h, np.array(few, np.uint64)], np.r_[who, whole]
    h = mix64(h)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1])]
    h, who = h[new], who[new]
    return h, np.bincount(who, minlength=len(texts))


def signatures(h: np.ndarray, n: np.ndarray, circle: np.ndarray, turns: int, rows: int = 8192) -> np.ndarray:
    """Signatures of sets that aren't empty: sets x turns."""
    place = (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(CIRCLE)).astype(np.int64)
    slices = np.lib.stride_tricks.sliding_window_view(circle, turns)
    out = np.full((len(n), turns), np.iinfo(np.uint16).max, np.uint16)
    owner = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(h), rows):
        who = owner[a : a + rows]
        cut = np.nonzero(np.r_[True, who[1:] != who[:-1]])[0]
        low = np.minimum.reduceat(slices[place[a : a + rows]], cut, axis=0)
        out[who[cut]] = np.minimum(out[who[cut]], low)
    return out


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, (fa, fb) a fingerprint of the set, and its bucket keys."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        circle = _circle(bands * rows)
        for part in batches(frames, 2_000_000):
            h, n = shingles([t.encode() for t in part["text"]])
            some = n > 0
            sig = signatures(h, n[some], circle, bands * rows).astype(np.uint64).reshape(-1, bands, rows)
            key = np.arange(bands, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
            for r in range(rows):
                key = mix64(key + sig[:, :, r] + np.uint64(1))
            stop = np.cumsum(n)
            fa, fb = np.r_[np.uint64(0), np.cumsum(mix64(h))], np.r_[np.uint64(0), np.cumsum(mix64(h ^ np.uint64(0x94D049BB133111EB)))]
            keys = np.empty(len(part), object)
            for at, row in zip(np.nonzero(some)[0].tolist(), key.view(np.int64), strict=True):
                keys[at] = row
            for at in np.nonzero(~some)[0].tolist():
                keys[at] = np.empty(0, np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": n, "fa": (fa[stop] - fa[stop - n]).view(np.int64), "fb": (fb[stop] - fb[stop - n]).view(np.int64), "buckets": keys})

    made = keyed(docs).mapInPandas(run, "doc_id string, n_shingles long, fa long, fb long, buckets array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def verified(pairs: DataFrame, sets: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("a")), "u").join(
        sets.select(F.col("doc_id").alias("v"), F.col("set").alias("b")), "v"
    )
    both = both.withColumn("n", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("n") * parts[1] >= (F.size("a") + F.size("b") - F.col("n")) * parts[0]).select("u", "v")


def link(docs: DataFrame, similarity: tuple[int, int] = (75, 100)) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n_shingles and the representative of each row's class; components of representatives, None without any)."""
    made = staged(sketch(docs), "sketch")
    own = ["fa", "fb", "n_shingles"]
    heads = made.where("doc_id is not null and n_shingles > 0").groupBy(*own).agg(F.min("doc_id").alias("rep"))
    classed = staged(made.select("doc_id", *own).join(heads, own, "left").select("doc_id", "n_shingles", "rep"), "classes")
    firsts = made.join(heads, own).where("doc_id = rep")
    buckets = firsts.select(F.explode("buckets").alias("key"), F.col("rep").alias("id"), F.col("n_shingles").alias("n"))
    # written first, so that Spark can split the join below at very common keys
    shared = staged(buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"), "shared")
    members = staged(buckets.join(shared, "key").distinct().withColumn("most", F.col("n")), "buckets")
    release(shared)
    release(made)
    sets = comps = None
    leaders, step = 1, 0
    while not members.isEmpty():
        lead = _leaders(members, leaders)
        pairs = _pairs(members, lead, comps, similarity)
        rest = members.join(lead.select("key", F.col("v").alias("id")), ["key", "id"], "left_anti")
        if sets is None:
            # full sets, once, of the classes that are compared now or may be later
            later = rest.join(rest.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key"), "key").select("id")
            pairs = staged(pairs, "pairs")
            asked = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).union(later).distinct()
            sets = staged(_sets_of_classes(docs, asked, classed), "sets")
        comps, spent = _settle(pairs, comps, sets, similarity), (comps, members, pairs)
        members = staged(_mixed(rest, comps, similarity), "buckets")
        release(*spent)
        if not step:
            members = _refined(members, sets, comps, similarity)
        step, leaders = step + 1, leaders * MORE
    release(members, sets)
    return classed, comps


def _sets_of_classes(docs: DataFrame, asked: DataFrame, classed: DataFrame) -> DataFrame:
    """Per class asked for: doc_id and set, its distinct shingle hashes. Texts are dealt once, sets aren't dealt here."""
    small_batches(docs.sparkSession)
    classes = classed.where("doc_id = rep").select("doc_id", "n_shingles").distinct().join(asked.withColumnRenamed("id", "doc_id"), "doc_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(classes, "doc_id")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for part in batches(frames, 2_000_000):
            h, n = shingles([t.encode() for t in part["text"]])
            out = pd.DataFrame({"doc_id": part["doc_id"], "set": np.split(h.view(np.int64), np.cumsum(n)[:-1])})
            # of texts that share an id, those of the class
            yield out[n == part["n_shingles"].to_numpy()]

    return texts.mapInPandas(run, "doc_id long, set array<long>")


def _leaders(members: DataFrame, count: int) -> DataFrame:
    """The `count` members of each bucket with the largest share of shingles that any other has; ties to the smaller id."""
    order = Window.partitionBy("key").orderBy(F.desc(F.col("most") / F.col("n")), "id")
    best = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count)
    return best.select("key", F.col("id").alias("v"), F.col("n").alias("vn"), F.col("most").alias("vmost"))


def _possible(a: Column, b: Column, n: Column, m: Column, parts: tuple[int, int]) -> Column:
    """Whether sets of n and m shingles, of which at most a and b can be shared, can be similar enough."""
    return F.least(a, b) * (parts[0] + parts[1]) >= (n + m) * parts[0]


def _pairs(members: DataFrame, lead: DataFrame, comps: DataFrame | None, similarity: tuple[int, int]) -> DataFrame:
    """Distinct pairs of a member and a leader of its bucket that may be similar and aren't in one component yet."""
    apart = F.col("id") != F.col("v")
    if comps is not None:
        members, lead = _with_components(members, comps, "id", "cu"), _with_components(lead, comps, "v", "cv")
        apart = apart & (F.col("cu") != F.col("cv"))
    a, b = members.alias("a"), lead.alias("b")
    can = _possible(F.col("most"), F.col("vmost"), F.col("n"), F.col("vn"), similarity)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & can)
    return pairs.select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()


def _settle(pairs: DataFrame, comps: DataFrame | None, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Verify pairs and join what they link to the components so far."""
    good = verified(pairs, sets, similarity)
    if comps is None:
        return staged(components(good), "components")
    # the new links are few, and between components: only these are joined anew
    between = _with_components(_with_components(good, comps, "u", "cu"), comps, "v", "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    new = staged(components(between), "components")
    moved = comps.select("node", F.col("comp").alias("_c")).join(new.select(F.col("node").alias("_c"), F.col("comp").alias("_to")), "_c", "left")
    moved = moved.select("node", F.coalesce("_to", "_c").alias("comp"))
    fresh = new.join(comps.select("node"), "node", "left_anti")
    out = staged(moved.unionByName(fresh), "components")
    release(new)
    return out


def _with_components(df: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
    c = comps.select(F.col("node").alias(column), F.col("comp").alias(name))
    return df.join(c, column, "left").withColumn(name, F.coalesce(name, column))


def _mixed(members: DataFrame, comps: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Members that may still be linked with a member of their bucket in another component."""
    side = _with_components(members, comps, "id", "c")
    facts = side.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least"), F.max("most").alias("top"), F.count("*").alias("size"))
    facts = facts.where("lo <> hi").drop("lo", "hi")
    can = _possible(F.col("most"), F.col("top"), F.col("n"), F.col("least"), similarity)
    return members.select("key", "id", "n", "most").join(facts, "key").where(can).select("key", "id", "n", "most", "size", "least")


def _refined(members: DataFrame, sets: DataFrame, comps: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Members with crowded buckets replaced by buckets of rare shingles, which hold all their pairs that can be linked.

    Of a set's n shingles a similar one has at least `need`, so with shingles in one order for all, rarest first, two similar
    sets share one of their first n - need + 1. Shingles that no other member of a crowded bucket has can't be shared and
    use up places. A copy edited too much to be linked has nothing left but rare shingles or nothing at all, so it meets
    the few that share its edits, and not every copy of its text.
    """
    crowd = members.where(F.col("size") >= CROWDED).groupBy(F.col("id").alias("doc_id"), "n").agg(F.min("least").alias("least"))
    grams = sets.join(crowd, "doc_id").select(F.col("doc_id").alias("id"), "n", "least", F.explode("set").alias("gram"))
    # written first, so that Spark can split the join
    often = staged(grams.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1"), "grams")
    held = grams.join(often, "gram").groupBy("id", "n", "least").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("held"))
    need = F.ceil((F.col("n") + F.col("least")) * similarity[0] / (similarity[0] + similarity[1]))
    first = F.slice("held", 1, F.greatest(F.size("held") - need + 1, F.lit(0)).cast("int"))
    # from a pair's first common shingle on, no more than what is left in either order can be shared
    rare = held.select(F.posexplode(first).alias("at", "x"), "id", "n", F.size("held").cast("long").alias("size"))
    rare = rare.select(F.col("x.gram").alias("key"), "id", "n", (F.col("size") - F.col("at")).alias("most"))
    rest = members.where(F.col("size") < CROWDED).select("key", "id", "n", "most")
    out = staged(_mixed(rest.unionByName(rare), comps, similarity), "buckets")
    release(members, often)
    return out


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (75, 100)) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable) and kept (the id is the component's)."""
    classed, comps = link(docs, similarity)
    c = comps.select(F.col("node").alias("rep"), "comp") if comps is not None else classed.select("rep", F.col("rep").alias("comp")).limit(0)
    return classed.join(c, "rep", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("comp", "rep", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("comp", "rep", "doc_id"), F.lit(True)).alias("kept"),
    )
