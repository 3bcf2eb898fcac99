"""Exact similarity of sets of distinct shingles, and links by it. The candidates are found by simhash.

Documents with equal sets of distinct shingles are one class from the start. Every link is verified on the
whole shingle sets. What other links leave apart in a large bucket is compared block with block inside a
task, which returns only links, so a large group of near copies makes no row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SEED = 42
#: Sets, and bytes of sets, in a block of a bucket; hashes that are compared at once.
MEMBERS, SET_BYTES, COLUMNS = 256, 16_000_000, 8192


def jaccard(x: bytes, y: bytes) -> float:
    """The share of common hashes of two sets, each the bytes of sorted distinct 64-bit hashes."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / max(1, len(p) + len(q) - both)


def classes(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", prints: int = 0) -> DataFrame:
    """(doc_id, th, node, n, prints): the text's hash, the digest and size of its set of distinct shingles, and that many fingerprints of the set."""
    from .simhash import set_prints, shingle_hashes

    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t if isinstance(t, str) else "", words)) for t in b["text"]]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield b[["doc_id", "th"]].assign(node=node, n=[len(s) for s in sets], prints=[set_prints(s, prints).tobytes() for s in sets])

    return slim.mapInPandas(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, th long, node long, n long, prints binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, hashes) of wanted (node, k0, k1), k0 and k1 being the id and the text's hash of one of its documents."""
    from .simhash import shingle_hashes

    slim = docs.select(F.col(id_col).alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    texts = slim.join(wanted, F.col("k").eqNullSafe(F.col("k0")) & (F.col("th") == F.col("k1"))).select("node", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["node"]].assign(hashes=[np.unique(shingle_hashes(t if isinstance(t, str) else "", words)).tobytes() for t in b["text"]])

    # A row that is there twice gives its set twice.
    return texts.mapInPandas(run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that share in common, a stored table."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stage(shingle_sets(docs, stage(nodes.select("node", "k.*").join(ends, "node"), "wanted"), words, id_col, text_col), "sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return stage(both.where(share("x", "y") >= similarity).select("a", "b"), "links")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the left sets has in common with each of the right ones."""
    sizes = np.array([len(x) for x in [*left, *right]])
    ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    out = np.zeros((len(left), len(right)))
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        a, b = np.searchsorted(ids, [at, at + COLUMNS])
        held = np.zeros((len(sizes), COLUMNS), np.float32)
        held[row[a:b], ids[a:b] - at] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _joined(left: pd.DataFrame, right: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes (node, root, hashes) of that similarity, as many as join the roots that such pairs join."""
    sets = [[np.frombuffer(x, np.uint64) for x in side["hashes"]] for side in (left, right)]
    both = _common(*sets)
    sizes = [np.array([len(x) for x in side]) for side in sets]
    share = both / np.maximum(1, sizes[0][:, None] + sizes[1][None, :] - both)
    near = (share >= similarity) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :])
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True):
        p, q = sorted((top(int(left["root"].iloc[i])), top(int(right["root"].iloc[j]))))
        if p != q:
            above[q] = p
            out.append((int(left["node"].iloc[i]), int(right["node"].iloc[j])))
    return out


def apart_links(docs: DataFrame, nodes: DataFrame, shared: DataFrame, roots: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Links (a, b) between members of a bucket that the roots (node, root) leave apart; a stored table, or None if no bucket is left apart.

    At least one end of such a link lies outside the bucket's most frequent root. Those outside and those
    within it are dealt into blocks of about MEMBERS sets or SET_BYTES; a task compares one block with
    another, so a bucket of g members makes about g * g / MEMBERS rows, and no row for a pair that is no link.
    """
    # With two members the representative's pair is the only one.
    found = shared.where("members > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = found.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / MEMBERS, s * (8 / SET_BYTES))).cast("int")
    sums = parts.groupBy("key").agg(F.max(F.struct("c", "root", "s")).alias("x"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("parts > 1")
    main = sums.select("key", F.col("x.root").alias("main"), blocks(F.col("x.c"), F.col("x.s")).alias("within"), blocks(F.col("c") - F.col("x.c"), F.col("s") - F.col("x.s")).alias("outside"))
    split = stage(found.join(main, "key").select("key", "node", "root", "within", "outside", (F.col("root") != F.col("main")).alias("out")), "split")
    if split.isEmpty():
        return None
    sets = stage(shingle_sets(docs, stage(nodes.select("node", "k.*").join(split.select("node").distinct(), "node"), "wanted"), words, id_col, text_col), "sets")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outside")).otherwise(F.col("within"))).cast("int")
    meets = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inner = F.transform(meets("outside"), lambda j: F.struct(F.lit(False).alias("alike"), F.col("mine").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    outer = F.transform(meets("within"), lambda i: F.struct(F.lit(False).alias("alike"), i.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side")))
    alike = F.transform(meets("outside"), lambda j: F.struct(F.lit(True).alias("alike"), F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"), F.when(F.col("mine") <= j, 0).otherwise(1).alias("side")))
    dealt = split.withColumn("mine", mine).select("key", "node", "root", F.explode(F.when(F.col("out"), F.concat(outer, alike)).otherwise(inner)).alias("x")).select("key", "node", "root", "x.*")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if rows["alike"].iloc[0] and rows["i"].iloc[0] == rows["j"].iloc[0]:
            right = left
        return pd.DataFrame(_joined(left, right, similarity) if len(left) and len(right) else [], columns=["a", "b"], dtype=np.int64)

    return stage(dealt.join(sets, "node").groupBy("key", "alike", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "links")
