"""Nearest neighbours by largest inner product: a forest of random-projection trees under one shared priority queue.

Vectors are lifted by one coordinate so that all have the same norm; the largest inner product is then the smallest
angle, which planes through the origin split well. Planes are fitted on a bounded sample (`sample_rows`): each splits the
sample between two of its points, until the leaves would hold about `leaf` of all rows. Every row is then routed to one
leaf of each tree, and every query opens leaves of all trees from one queue, least margin first, until these hold
`search` rows. Candidates are reranked by the exact product in double precision, leaf by leaf in blocks of bounded size,
and each block sends on no more than `k` a query: no pair list is made, and no leaf, however full, is read by one task.

Rows are told apart by a number of their own, given when they are first written, so rows that share a vec_id are all candidates
and all queries: a repeated id may come more than once in a result, and a repeated query gives its rows each time.

Defined results: vectors that are null, zero, or hold null or non-finite parts take no part, nor do null ids or other
lengths than the most common one of the sample; ties go to the smaller id; with few rows all candidates are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.common import bounded_sample, release, small_batches, staged

BLOCK = 1024


@dataclass
class Tree:
    """Planes (one a node), children (negative: leaf -1 - child), and the number of leaves."""

    planes: np.ndarray
    children: np.ndarray
    leaves: int


def _matrix(values: list, width: int) -> np.ndarray:
    return np.asarray(values, np.float64).reshape(-1, width)


def grow(sample: np.ndarray, stop: int, seed: int) -> Tree:
    """One tree over a sample: planes between two of a node's points, halves split at their middle where one side is empty."""
    rng = np.random.default_rng(seed)
    planes: list[np.ndarray] = []
    children: list[list[int]] = []
    leaves = 0

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    todo = [(np.arange(len(sample)), -1, 0)]
    root = None
    while todo:
        rows, parent, side = todo.pop()
        me = None
        if len(rows) > stop:
            x = sample[rows]
            for _ in range(4):
                a, b = x[rng.integers(len(x), size=2)]
                near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
                if near.all() or not near.any():
                    continue
                plane = x[near].mean(0) - x[~near].mean(0)
                plane = np.r_[plane, -0.5 * plane @ (x[near].mean(0) + x[~near].mean(0))]
                right = x @ plane[:-1] + plane[-1] > 0
                if 0.03 < right.mean() < 0.97:
                    me = len(planes)
                    planes.append(plane)
                    children.append([0, 0])
                    todo += [(rows[~right], me, 0), (rows[right], me, 1)]
                    break
        at = leaf() if me is None else me
        if parent < 0:
            root = at
        else:
            children[parent][side] = at
    if root is None or root < 0:
        return Tree(np.zeros((0, sample.shape[1] + 1)), np.zeros((0, 2), np.int64), 1)
    return Tree(np.array(planes), np.array(children, np.int64), leaves)


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    if not len(tree.planes):
        return np.zeros(len(x), np.int64)
    node = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        p = tree.planes[node[live]]
        right = (x[live] * p[:, :-1]).sum(1) + p[:, -1] > 0
        node[live] = tree.children[node[live], right.astype(int)]
        live = live[node[live] >= 0]
    return -1 - node


def open_leaves(trees: list[Tree], counts: list[np.ndarray], q: np.ndarray, search: int) -> list[tuple[int, int]]:
    """Leaves of all trees in the order of one queue, until they hold `search` rows."""
    margins = [t.planes[:, :-1] @ q + t.planes[:, -1] for t in trees]
    queue = [(-np.inf, i, 0 if len(t.planes) else -1) for i, t in enumerate(trees)]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < search:
        worst, i, node = heapq.heappop(queue)
        while node >= 0:
            m = margins[i][node]
            a, b = trees[i].children[node]
            near, far = (b, a) if m > 0 else (a, b)
            heapq.heappush(queue, (max(worst, abs(float(m))), i, int(far)))
            node = int(near)
        out.append((i, -1 - node))
        held += int(counts[i][-1 - node])
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    return rows.where(~bad & F.exists("embedding", lambda x: x != 0))


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 10, leaf: int = 256, share: float = 0.7, least: int = 8000, sample_rows: int = 20_000
) -> DataFrame:
    """For each row whose vec_id `every` divides: query_id, rank, vec_id, score of its `k` nearest found.

    A query opens leaves until they hold `share` of the number of rows (over all trees, so rows may count more than once),
    `least` at any rate. What it finds in the sample bounds its k-th product from below, so blocks send on no less than that;
    the sample's own best are candidates too, so a query gets `k` rows wherever there are as many others.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = staged(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    sample = bounded_sample(rows, sample_rows, "vec_id", "embedding", "row").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    sizes = [len(r["embedding"]) for r in sample]
    width = max(set(sizes), key=sizes.count)
    rows = rows.where(F.size("embedding") == width)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(squares)).first()[0]
    sample = [r for r in sample if len(r["embedding"]) == width]
    picked = _matrix([r["embedding"] for r in sample], width)
    names = np.array([(r["vec_id"], r["row"]) for r in sample], np.int64)

    def lift(x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]

    forest = [grow(lift(picked), max(2, int(leaf / max(total / len(sample), 1))), seed) for seed in range(trees)]
    shared = spark.sparkContext.broadcast((forest, picked, names))  # the sample, and at most trees x sample_rows planes

    def place(frames: Iterator) -> Iterator:
        for frame in frames:
            x = lift(_matrix(frame["embedding"].tolist(), width))
            at = np.stack([route(t, x) for t in shared.value[0]], 1)
            yield frame.assign(leaves=list(at.astype(np.int32)))

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = staged(rows.mapInPandas(place, f"vec_id long, embedding {kind}, row long, leaves array<int>"), "leaves")
    held = [np.zeros(t.leaves, np.int64) for t in forest]
    leaves = placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    for r in leaves.collect():  # one row for each leaf of the forest
        held[r[0]][r[1]] = r[2]
    counts = spark.sparkContext.broadcast(held)
    wanted = max(least, int(share * total))

    def sampled(part, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Products with the sample, the query itself left out, and the k-th of them."""
        _, known, known_ids = shared.value
        near = np.where(known_ids[:, 1] == part["row"].to_numpy()[:, None], -np.inf, x @ known.T)
        return near, np.partition(near, -k, axis=1)[:, -k] if len(known) >= k else np.full(len(x), -np.inf)

    def first(frames: Iterator) -> Iterator:
        import pandas as pd

        known_ids = shared.value[2]
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = frame.iloc[a : a + 256]
                near, bound = sampled(part, _matrix(part["embedding"].tolist(), width))
                for query, s, b in zip(part["row"].tolist(), near, bound, strict=True):
                    at = np.nonzero((s >= b) & np.isfinite(s))[0]
                    at = at[np.lexsort((known_ids[at, 1], known_ids[at, 0], -s[at]))][:k]
                    yield pd.DataFrame({"query": np.full(len(at), query), "vec_id": known_ids[at, 0], "row": known_ids[at, 1], "score": s[at]})

    def probe(frames: Iterator) -> Iterator:
        import pandas as pd

        trees_ = shared.value[0]
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = frame.iloc[a : a + 256]
                x = _matrix(part["embedding"].tolist(), width)
                _, bound = sampled(part, x)
                found = [open_leaves(trees_, counts.value, np.r_[v, 0.0], wanted) for v in x]
                yield pd.DataFrame(
                    {
                        "query": part["row"].to_numpy(),
                        "embedding": part["embedding"].to_numpy(),
                        "bound": bound - 1e-9 * np.maximum(1, np.abs(bound)),
                        "tree": [[i for i, _ in f] for f in found],
                        "leaf": [[j for _, j in f] for f in found],
                    }
                )

    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding", "row")
    probes = queries.mapInPandas(probe, f"query long, embedding {kind}, bound double, tree array<int>, leaf array<int>")
    probes = probes.select("query", "embedding", "bound", F.explode(F.arrays_zip("tree", "leaf")).alias("x")).select("query", "embedding", "bound", "x.*")
    # a leaf's rows are dealt over blocks by their ids; its queries visit each block
    sizes_of = [(i, j, -(-int(n) // BLOCK)) for i, c in enumerate(held) for j, n in enumerate(c.tolist()) if n]
    blocks = spark.createDataFrame(sizes_of, "tree int, leaf int, blocks int")
    member = placed.select("vec_id", "embedding", "row", F.posexplode("leaves").alias("tree", "leaf")).join(F.broadcast(blocks), ["tree", "leaf"])
    member = member.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asker = probes.join(F.broadcast(blocks), ["tree", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def rerank(askers, members):  # noqa: ANN001, ANN202
        import pandas as pd

        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        m = _matrix(members["embedding"].tolist(), width)
        ids, own = members["vec_id"].to_numpy(), members["row"].to_numpy()
        for a in range(0, len(askers) if len(m) else 0, 512):
            part = askers.iloc[a : a + 512]
            q, bound = part["query"].to_numpy(), part["bound"].to_numpy()
            p = _matrix(part["embedding"].tolist(), width) @ m.T
            hit = (p >= bound[:, None]) & (own != q[:, None])
            for i in np.nonzero(hit.sum(1) > k)[0].tolist():
                at = np.nonzero(hit[i])[0]
                hit[i, at[np.lexsort((own[at], ids[at], -p[i, at]))][k:]] = False
            i, j = np.nonzero(hit)
            out.append((q[i], ids[j], own[j], p[i, j]))
        q, v, r, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query": q, "vec_id": v, "row": r, "score": s})

    by = ["tree", "leaf", "block"]
    asker, member = asker.select(*by, "query", "embedding", "bound"), member.select(*by, "vec_id", "embedding", "row")
    near = asker.groupBy(*by).cogroup(member.groupBy(*by)).applyInPandas(rerank, "query long, vec_id long, row long, score double")
    near = near.unionByName(queries.mapInPandas(first, "query long, vec_id long, row long, score double"))
    best = near.groupBy("query", "vec_id", "row").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "vec_id", "row")
    # the measure itself, added up in one order whatever block a pair was met in
    a = rows.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"))
    exact = best.join(a, "query").join(rows.select("row", F.col("embedding").alias("b")), "row")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("query", "query_id", "vec_id", "row", dot.alias("score"))
    found = staged(exact.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score"), "nearest")
    release(rows, placed)
    return found
