"""Approximate nearest neighbours: stable projections, kd-trees, and a chi-square stopping test.

Vectors are projected onto ``dims`` Gaussian directions. The squared projected distance of two
vectors over their squared distance follows a chi-square law with ``dims`` degrees of freedom. So
once the neighbours still to come, taken in the order of their projected distance r, would be
nearer than the k-th found, d, only with a probability below 1 - ``stop`` (chi-square(r^2/d^2) is
``stop`` or more), the search ends: each true neighbour is missed with at most that probability.

A kd-tree over at most ``sample`` sampled projections deals the space into at most MAX_CELLS
cells; every vector is put in its cell. A cell of more than ``block_rows`` rows is salted into
blocks, so copies of one vector make many blocks, none large. Each block has its own kd-tree. A
query walks it from the nearest box on, and its rows come out in the order of their projected
distance: a row is verified as soon as no box or row nearer to the query is left, until the next
one passes the test. A query first searches one block of its own cell, which bounds d; then it
goes only to the blocks of cells that pass the test with that bound. Each vector is sent to its
block once; the queries follow it in the same partition and are read as a stream.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

DIMS, STOP, SAMPLE, BLOCK_ROWS, LEAF, VERIFY, MAX_CELLS, SEED = 8, 0.95, 20_000, 5_000, 256, 256, 4096, 7


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    tail = sum(half**i / math.factorial(i) for i in range(dims // 2))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(half < 700, 1 - np.exp(-np.minimum(half, 700)) * tail, 1.0)


def reach(dims: int = DIMS, stop: float = STOP) -> float:
    """The ratio r/d from which the test holds."""
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid * mid), dims) < stop else (low, mid)
    return high


def directions(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


def tree(points: np.ndarray, leaf: int) -> tuple[list[tuple[int, float, int, int]], list[np.ndarray]]:
    """Nodes (axis, cut, left, right), children below 0 being leaf -1 - child; and the rows of each leaf. Median cuts along the widest axis."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            part = points[rows]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            cut = float(np.median(part[:, axis]))
            left = part[:, axis] < cut
            if not left.any():
                left = part[:, axis] <= cut
            if left.any() and not left.all():
                at = len(nodes)
                nodes.append((axis, float(part[~left, axis].min()), 0, 0))
                nodes[at] = (axis, nodes[at][1], grow(rows[left]), grow(rows[~left]))
                return at
        leaves.append(rows)
        return -len(leaves)

    grow(np.arange(len(points)))
    return nodes, leaves


def descend(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int32)
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -1 - at
        else:
            axis, cut, a, b = nodes[at]
            low = points[rows, axis] < cut
            todo += [(a, rows[low]), (b, rows[~low])]
    return out


class Block:
    """A block's vectors behind a kd-tree of their projections."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, g: np.ndarray):
        low_dim = vectors @ g
        self.nodes, leaves = tree(low_dim, LEAF)
        order = np.concatenate(leaves)
        self.rids, self.ids, self.vectors, self.low_dim = rids[order], ids[order], vectors[order], low_dim[order]
        self.ends = np.cumsum([len(x) for x in leaves]).tolist()
        self.starts = [e - len(x) for e, x in zip(self.ends, leaves, strict=True)]

    def nearest(self, own: int, q: np.ndarray, p: np.ndarray, bound: float, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the ``k`` nearest rows found within ``bound``, the row ``own`` apart, and how many rows were verified."""
        point, d, seen = p.tolist(), bound, 0
        best_d, best_i = np.empty(0), np.empty(0, np.int64)
        boxes: list[tuple[float, int, tuple[float, ...]]] = [(0.0, 0 if self.nodes else -1, (0.0,) * len(point))]
        wait_r, wait_i = np.empty(0), np.empty(0, np.int64)  # rows whose projected distance is known, not yet their turn
        while boxes or len(wait_r):
            if boxes and boxes[0][0] <= (ratio * d) ** 2:
                r, at, off = heapq.heappop(boxes)
                while at >= 0:
                    axis, cut, low, high = self.nodes[at]
                    gap = point[axis] - cut
                    near, far = (low, high) if gap < 0 else (high, low)
                    beyond = r - off[axis] ** 2 + gap * gap
                    if beyond <= (ratio * d) ** 2:
                        heapq.heappush(boxes, (beyond, far, (*off[:axis], abs(gap), *off[axis + 1 :])))
                    at = near
                a, b = self.starts[-1 - at], self.ends[-1 - at]
                gaps = self.low_dim[a:b] - p
                rows = np.einsum("ij,ij->i", gaps, gaps)
                wait_r, wait_i = np.concatenate([wait_r, rows]), np.concatenate([wait_i, np.arange(a, b)])
            else:
                boxes = []
            while len(wait_r):
                most = min(boxes[0][0] if boxes else np.inf, (ratio * d) ** 2)
                turn = np.flatnonzero(wait_r <= most)
                if not len(turn):
                    break
                if len(turn) > VERIFY:
                    turn = turn[np.argpartition(wait_r[turn], VERIFY)[:VERIFY]]
                rows = wait_i[turn]
                wait_r, wait_i = np.delete(wait_r, turn), np.delete(wait_i, turn)
                seen += len(rows)
                diff = self.vectors[rows] - q
                dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                good = (dist <= d) & (self.rids[rows] != own)
                best_d, best_i = np.concatenate([best_d, dist[good]]), np.concatenate([best_i, self.ids[rows[good]]])
                if len(best_d) >= k:
                    top = np.lexsort((best_i, best_d))[:k]
                    best_d, best_i = best_d[top], best_i[top]
                    d = min(d, float(best_d[-1]))
            if not boxes:
                break
        top = np.lexsort((best_i, best_d))[:k]
        return best_i[top], best_d[top], seen


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, dims: int = DIMS, stop: float = STOP, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
    with_work: bool = False,
) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` where ``is_query`` holds: query_id, rank, vec_id, score (and ``verified``, how many rows the query compared, on request).

    score is the Euclidean distance of the vectors in double precision; ties go to the smaller id.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    with a null id or of another length than most vectors. Only the query's own row is no candidate: rows that repeat
    its id are, and are answered each on its own. Fewer candidates than ``k`` are all returned.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double" + ", verified long" * with_work
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    widths = slim.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], result)
    width, total = widths[0]["width"], widths[0]["n"]
    slim = slim.where(F.size("v") == width)
    g, ratio = directions(width, dims), reach(dims, stop)
    cells = min(MAX_CELLS, math.ceil(total / block_rows))
    nodes: list = []
    if cells > 1:
        seen = slim.select("v").sample(fraction=min(1.0, sample / total), seed=SEED).limit(2 * sample).toPandas()
        if len(seen):
            nodes, _ = tree(_matrix(seen["v"]) @ g, max(1, len(seen) // cells))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = _matrix(b["v"]) @ g
                yield b.assign(p=list(p), cell=descend(nodes, p))

    rows = slim.withColumn("rid", F.monotonically_increasing_id())
    placed = stage(rows.mapInPandas(place, "vec_id long, v array<double>, asks boolean, rid long, p array<double>, cell int"), "placed")
    sides = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sides).toPandas().sort_values("cell")  # MAX_CELLS rows or so at most
    numbers = boxes["cell"].to_numpy()
    lows, highs = (boxes[[f"{n}{i}" for i in range(dims)]].to_numpy(float) for n in ("low", "high"))
    salts = np.maximum(1, np.ceil(boxes["n"].to_numpy() / block_rows)).astype(int)
    first = np.cumsum(salts) - salts
    names = ["block", "asks", "rid", "vec_id", "v", "bound"]
    sent = "block int, asks boolean, rid long, vec_id long, v array<double>, bound double"

    def block_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = np.searchsorted(numbers, b["cell"].to_numpy())
                yield pd.DataFrame({"block": first[at] + b["h"].to_numpy() % salts[at], "asks": False, "rid": b["rid"], "vec_id": b["vec_id"], "v": b["v"], "bound": np.inf})

    blocks = placed.select("rid", "vec_id", "v", "cell", F.shiftrightunsigned(F.xxhash64("rid"), 1).alias("h")).mapInPandas(block_of, sent)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query's blocks: one of its own cell without a bound, else all of the cells that pass the test."""
        for b in batches:
            made: list[tuple] = []
            for rid, vec_id, v, p, cell, bound in zip(b["rid"], b["vec_id"], b["v"], b["p"], b["cell"], b["bound"], strict=True):
                if pd.isna(bound):
                    at, bound = int(np.searchsorted(numbers, cell)), np.inf
                    to = [first[at] + rid % salts[at]]
                else:
                    off = np.maximum(np.maximum(lows - p, p - highs), 0)
                    ok = np.sqrt((off * off).sum(1)) <= ratio * bound
                    to = np.concatenate([np.arange(first[at], first[at] + salts[at]) for at in np.flatnonzero(ok)])
                made += [(int(x), True, rid, vec_id, v, bound) for x in to]
                while len(made) >= 5000:
                    yield pd.DataFrame(made[:5000], columns=names)
                    made = made[5000:]
            if made:
                yield pd.DataFrame(made, columns=names)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's rows, then its queries, in a partition sorted so."""
        now, held, built = None, [], None
        for b in batches:
            block, asks = b["block"].to_numpy(), b["asks"].to_numpy(bool)
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(b)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if block[a] != now:
                    now, held, built = block[a], [], None
                run = b.iloc[a:z]
                if not asks[a]:
                    held.append(run)
                    continue
                if built is None:
                    if not held:
                        continue
                    rows = pd.concat(held)
                    built, held = Block(rows["rid"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(rows["v"]), g), [run.iloc[:0]]
                q = _matrix(run["v"])
                out = [built.nearest(own, x, p, bound, k, ratio) for own, x, p, bound in zip(run["rid"].tolist(), q, q @ g, run["bound"].tolist(), strict=True)]
                sizes = [len(i) for i, _, _ in out]
                work = [n if j == 0 else 0 for size, (_, _, n) in zip(sizes, out, strict=True) for j in range(size)]
                yield pd.DataFrame({"rid": run["rid"].repeat(sizes), "query_id": run["vec_id"].repeat(sizes), "vec_id": np.concatenate([i for i, _, _ in out]), "score": np.concatenate([d for _, d, _ in out]), "verified": np.array(work, np.int64)})

    def ask(who: DataFrame) -> DataFrame:
        dealt = blocks.unionByName(who.mapInPandas(visits, sent)).repartition("block").sortWithinPartitions("block", "asks")
        return dealt.mapInPandas(meet, "rid long, query_id long, vec_id long, score double, verified long")

    asked = placed.where("asks").select("rid", "vec_id", "v", "p", "cell")
    start = ask(asked.withColumn("bound", F.lit(None).cast("double")))
    bound = start.groupBy("rid").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    # bound: no query without one, for a query whose own block holds no other row goes everywhere
    bounded = stage(asked.join(bound, "rid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounds")
    mine = Window.partitionBy("rid")
    found = ask(bounded)
    if with_work:
        found = found.withColumn("verified", F.sum("verified").over(mine))
    ranked = found.withColumn("rank", F.row_number().over(mine.orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *["verified"] * with_work)
