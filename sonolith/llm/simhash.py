"""SimHash near-dedup with multi-index hashing.

Equal fingerprints are one class from the start. Two fingerprints that differ in at most d of 64
bits differ in at most d // m bits in one of m segments: each fingerprint stands in one table a
segment, and looks up the small Hamming ball around each of its segments. What the tables return
is verified on all 64 bits within the join. Components need no link twice: a look-up first meets one entry
of its bucket, and then only what that leaves apart. m is chosen by the number of fingerprints: more rows look up longer segments
with larger balls, so that a table's entries stay short. Any m finds every link.

Links by similarity take as candidates what several independent SimHash fingerprints of BITS bits
bring together: a table a segment of each fingerprint, entries that agree in it verified on all its bits
(NEAR), the matches of all fingerprints united to clusters. In a cluster each member is verified with the first, and what
that leaves apart is compared in place, all on the whole shingle sets (see minhash), so matches make no row a pair. The
number of fingerprints follows the similarity: a pair at it is missed with probability MISS.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import release, stage
from .graph import components

WORDS, MAX_BITS, SEED, SKETCH = 4, 4, 42, 128
#: Fingerprints for similarity: their bits, how many may differ, and the chance that all miss a pair.
BITS, NEAR, MISS = 128, 34, 1e-7
#: Entries of a table in one task; members and near pairs a member from which a bucket is dense; members of a cluster that are compared in place.
ENTRIES, LARGE, PAIRS, CLUSTER = 1 << 19, 1024, 8, 1 << 14
_ENTRY = np.dtype([("node", "<i8"), ("n", "<u4"), ("x", "<u8", 2)])
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, 2048, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ONES = np.uint64(0x0101010101010101)
_PLACES = 1 << (np.arange(8)[:, None] + 8 * np.arange(8)[None, :]).astype(np.uint64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; fewer words are one shingle, none give none."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash: the bits set in over half of the hashes; 0 without any."""
    total = len(hashes)
    if total <= 1:
        return int(hashes[0]) if total else 0
    hashes = np.concatenate([hashes, np.zeros(-total % 255, np.uint64)])
    counts = np.empty((8, 8), np.int64)  # by bit of a byte, then byte; a byte lane holds up to 255
    for i in range(8):
        counts[i] = ((hashes >> np.uint64(i)) & _ONES).reshape(-1, 255).sum(axis=1, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(_PLACES[2 * counts > total].sum(dtype=np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """One-permutation minima of the distinct hashes in SKETCH bins, 16 bits each; empty bins are 65535."""
    out = np.full(SKETCH, 65535, np.uint16)
    if len(hashes):
        ordered = np.sort(hashes)
        bins = (ordered >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out[bins[first]] = np.minimum((ordered[first] >> np.uint64(41)) & np.uint64(0xFFFF), np.uint64(65534)).astype(np.uint16)
    return out.tobytes()


def fingerprints(docs: DataFrame, words: int = WORDS, sketches: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp[, sketch]): the fingerprint as a signed 64-bit integer. A null text counts as empty. th is the text's hash."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, more = np.empty(len(b), np.uint64), []
            for i, t in enumerate(b["text"]):
                h = shingle_hashes(t if isinstance(t, str) else "", words)
                fp[i] = fingerprint(h)
                if sketches:
                    more.append(sketch(h))
            made = b[["doc_id", "th"]].assign(fp=fp.view(np.int64))
            yield made.assign(sketch=more) if sketches else made

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(run, f"doc_id {kind}, th long, fp long" + ", sketch binary" * sketches)


def _segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of m segments of 64 bits."""
    cut = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def best_segments(n: int, max_bits: int) -> int:
    """The number of segments with the least work for n fingerprints; a look-up's row costs about fifty comparisons."""

    def work(m: int) -> float:
        return sum(sum(comb(bits, k) for k in range(max_bits // m + 1)) * (50 + n / 2**bits) for _, bits in _segments(m))

    return min(range(2, max_bits + 2), key=work)


def _piece(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _tables(fps: DataFrame, max_bits: int, segments: int | None) -> tuple[DataFrame, DataFrame]:
    """Of distinct fingerprints (fp): the segments' tables (b, s, v), and what each fingerprint looks up in them (a, s, v)."""
    m = segments or best_segments(fps.count(), max_bits)
    cut, radius = _segments(m), max_bits // m
    balls = [[sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)] for _, bits in cut]
    fp = F.col("fp")
    tables = F.array(*[F.struct(F.lit(s).alias("s"), _piece(fp, *cut[s]).alias("v")) for s in range(m)])
    held = fps.select(fp.alias("b"), F.explode(tables).alias("k")).select("b", "k.s", "k.v")
    asked = None
    for s in range(m):
        ball = F.explode(F.array(*[F.lit(x).cast("long") for x in balls[s]]))
        part = fps.select(fp.alias("a"), F.lit(s).alias("s"), ball.alias("x"), _piece(fp, *cut[s]).alias("v")).select("a", "s", F.col("v").bitwiseXOR(F.col("x")).alias("v"))
        asked = part if asked is None else asked.unionByName(part)
    return held, asked


def _near(max_bits: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits


def linked(fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """Of distinct fingerprints (fp): (node, root) for those that a link of at most ``max_bits`` bits joins to others, the root being the smallest reachable.

    First each fingerprint meets one entry of each table bucket that it looks up, its smallest: a link for each
    look-up at most. Then only what these links leave apart meets, so a dense ball of fingerprints
    makes a star instead of all its pairs. Every link between different components is found.
    """
    held, asked = _tables(fps, max_bits, segments)
    held, asked = stage(held, "tables"), stage(asked, "lookups")
    least = held.groupBy("s", "v").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
    least = stage(least, "buckets")
    stars = asked.join(least, ["s", "v"]).where((F.col("a") != F.col("b")) & _near(max_bits)).select("a", "b").distinct()
    stars = stage(stars, "links")
    roots = stage(components(stars), "roots")

    # What is left: entries of buckets of two or more, that are in several components.
    entries = held.join(least.where("n > 1").select("s", "v"), ["s", "v"]).join(roots.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    entries = stage(entries, "entries")
    sums = entries.groupBy("s", "v", "root").agg(F.count(F.lit(1)).alias("n"))
    main = stage(sums.groupBy("s", "v").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts")), "main")
    outside = entries.join(main.where("parts > 1").drop("parts"), ["s", "v"]).where(F.col("root") != F.col("main")).select("s", "v", "b", F.col("root").alias("to"))
    rooted = asked.join(main, ["s", "v"]).join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    rooted = stage(rooted.where((F.col("parts") > 1) | (F.col("root") != F.col("main"))), "askers")
    apart = _near(max_bits) & (F.col("root") != F.col("to"))
    # Askers of the bucket's main component meet what lies outside it; others meet all.
    one = rooted.where("root = main").select("s", "v", "a", "root").join(stage(outside, "outside"), ["s", "v"]).where(apart)
    two = rooted.where("root <> main").select("s", "v", "a", "root").join(entries.select("s", "v", "b", F.col("root").alias("to")), ["s", "v"]).where(apart)
    more = stage(one.select("a", "b").unionByName(two.select("a", "b")).distinct(), "links")
    return roots if more.isEmpty() else stage(components(stars.unionByName(more)), "roots")


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """Of distinct fingerprints (fp): all pairs (a, b), a < b, that differ in at most ``max_bits`` bits, each once.

    As many rows as there are such pairs: for components use ``linked``.
    """
    held, asked = _tables(fps, max_bits, segments)
    return asked.join(held, ["s", "v"]).where((F.col("a") < F.col("b")) & _near(max_bits)).select("a", "b").distinct()


def similar(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sketches (fp, sketch) put the share of common shingles at ``similarity`` or, within two standard errors, below."""
    least = similarity - 2 * (similarity * (1 - similarity) / SKETCH) ** 0.5
    both = pairs.join(sketched.select(F.col("fp").alias("a"), F.col("sketch").alias("x")), "a").join(sketched.select(F.col("fp").alias("b"), F.col("sketch").alias("y")), "b")

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(dtype=float)
        p, q = (np.frombuffer(b"".join(c), np.uint16).reshape(len(x), -1) for c in (x, y))
        held = (p != 65535) | (q != 65535)
        return pd.Series(((p == q) & held).sum(1) / np.maximum(1, held.sum(1)))

    return both.where(share("x", "y") >= least).select("a", "b")


def set_prints(hashes: np.ndarray, count: int) -> np.ndarray:
    """That many independent SimHash fingerprints of BITS bits of a set of distinct hashes, as 64-bit words: the bits set in over half of them."""
    words = count * BITS // 64
    counts = np.zeros((words, 8, 8), np.int64)  # by word, byte, bit of a byte
    for at in range(0, len(hashes), 255 * 16):
        part = hashes[at : at + 255 * 16]
        mixed = part[None, :] * _FACTORS[:words]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for low in range(0, len(part), 255):  # a byte lane holds up to 255
            lanes = mixed[:, low : low + 255]
            for i in range(8):
                counts[:, :, i] += ((lanes >> np.uint64(i)) & _ONES).sum(axis=1, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(words, 8)
    return np.packbits((2 * counts > len(hashes)).reshape(words, 64), axis=1, bitorder="little").view("<u8").reshape(-1)


def plan_prints(rows: int, similarity: float) -> tuple[int, int]:
    """(fingerprints, segments of each) for that many rows: longer segments for more rows, and fingerprints enough that all tables miss a pair of that similarity with probability MISS.

    Two large sets differ in a bit with the probability of the angle between them, which is widest for sets alike in size.
    """
    m = 10 if rows <= 1 << 20 else 8 if rows <= 1 << 25 else 6
    agree = (1 - acos(min(1.0, 2 * similarity / (1 + similarity))) / pi) ** (BITS / m)
    return max(1, ceil(log(MISS) / log(1 - agree) / m)) if agree < 1 else 1, m


def _cuts(m: int) -> list[tuple[int, int, int]]:
    """(word, lowest bit, bits) of m segments of BITS bits; none lies in two words."""
    half = m // 2
    return [(w, a, b - a) for w in range(2) for a, b in zip([64 * i // half for i in range(half)], [64 * (i + 1) // half for i in range(half)], strict=True)]


def _values(x: np.ndarray, cut: tuple[int, int, int]) -> np.ndarray:
    word, low, bits = cut
    return (x[:, word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)


def _columns(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both words and the size of entries, each in one piece."""
    return np.ascontiguousarray(e["x"][:, 0]), np.ascontiguousarray(e["x"][:, 1]), e["n"].astype(float)


def _alike(columns: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Of pairs of entries, the places of those that differ in at most NEAR bits and have sizes that allow the similarity."""
    x, y, n = columns
    at = np.flatnonzero(np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= NEAR)
    n, m = n[i[at]], n[j[at]]
    return at[np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6]


def table_pairs(entries: np.ndarray, cut: tuple[int, int, int], similarity: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of one table's entries: near pairs of nodes that share a bucket, and the (value, entries) of dense buckets.

    A dense bucket has more than LARGE members or more than PAIRS near pairs a member; of its pairs only those with its first member are returned.
    """
    v = _values(entries["x"], cut)
    order = np.lexsort((entries["node"], v))
    e, v = entries[order], v[order]
    starts = np.flatnonzero(np.diff(v, prepend=v[:1] + np.uint64(1))) if len(v) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(v))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    dense, near = sizes > LARGE, np.zeros(len(starts), np.int64)
    ends = starts + sizes
    columns, last = _columns(e), np.repeat(ends, sizes)
    left, right, step = [], [], 0
    alive = np.flatnonzero(~dense[bucket])
    while len(alive):
        step += 1
        alive = alive[alive + step < last[alive]]
        i = alive[_alike(columns, alive, alive + step, similarity)]
        left.append(i)
        right.append(i + step)
        if len(i):
            near += np.bincount(bucket[i], minlength=len(starts))
            dense |= near > PAIRS * sizes
            alive = alive[~dense[bucket[alive]]]
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    single = ~dense[bucket[i]]
    stars = np.flatnonzero(dense[bucket] & (np.arange(len(v)) != starts[bucket]))
    firsts = starts[bucket[stars]]
    at_star = _alike(columns, stars, firsts, similarity)
    i, j = np.concatenate([i[single], firsts[at_star]]), np.concatenate([j[single], stars[at_star]])
    pairs = np.stack([e["node"][i], e["node"][j]], axis=1)
    return pairs, [(int(v[starts[k]]), e[starts[k] : ends[k]]) for k in np.flatnonzero(dense)]


def grown(e: np.ndarray, similarity: float) -> np.ndarray:
    """Of entries: pairs of nodes, near ones, as many as join all that near pairs join. A member that is joined is compared only with what is not."""
    columns, left, out = _columns(e), np.arange(len(e)), [np.zeros((0, 2), np.int64)]
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = _alike(columns, np.full(len(left), i), left, similarity)
            if len(hit):
                out.append(np.stack([np.full(len(hit), e["node"][i]), e["node"][left[hit]]], axis=1))
                todo += left[hit].tolist()
                left = np.delete(left, hit)
    return np.concatenate(out)


def forest(pairs: np.ndarray) -> np.ndarray:
    """As few of the pairs of nodes as join all that they join."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    label, kept, rest = np.arange(len(nodes)), [np.zeros(0, np.int64)], np.arange(len(pairs))
    while True:
        low, high = np.sort(label[ends[rest]], axis=1).T
        rest, low, high = (x[low != high] for x in (rest, low, high))
        if not len(rest):
            return pairs[np.sort(np.concatenate(kept))]
        # Each label that has a lower one beside it goes under the lowest, so there is no circle.
        order = np.lexsort((low, high))
        first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
        kept.append(rest[first])
        above = np.arange(len(nodes))
        above[high[first]] = low[first]
        while (above[above] != above).any():
            above = above[above]
        label = above[label]


def _compared(nodes: DataFrame, rows: int, count: int, m: int, similarity: float, whole: bool) -> DataFrame:
    """Of that many classes (node, n, prints): near pairs (a, b), and, where ``dense`` is true, dense buckets (key, members).

    Not ``whole``, only as many near pairs of each task as join what its near pairs join, and no buckets.
    """
    cuts, parts = _cuts(m), ceil(rows / ENTRIES)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = np.frombuffer(b"".join(b["prints"]), "<u8").reshape(len(b), count, 2)
            out = []
            for f in range(count):
                e = np.empty(len(b), _ENTRY)
                e["node"], e["n"], e["x"] = b["node"], b["n"], words[:, f]
                if parts <= 1:
                    out.append((f, -1, 0, e.tobytes()))
                    continue
                for s, cut in enumerate(cuts):
                    part = (_values(e["x"], cut) * np.uint64(parts)) >> np.uint64(cut[2])
                    out += [(f, s, int(p), e[part == p].tobytes()) for p in np.unique(part)]
            yield pd.DataFrame(out, columns=["f", "s", "part", "entries"])

    def compare(rows_: pd.DataFrame) -> pd.DataFrame:
        f, s = int(rows_["f"].iloc[0]), int(rows_["s"].iloc[0])
        e, found, full = np.frombuffer(b"".join(rows_["entries"]), _ENTRY), [], []
        for at in range(m) if s < 0 else [s]:
            pairs, dense = table_pairs(e, cuts[at], similarity)
            found.append(np.sort(pairs, axis=1))
            if whole:
                full += [((f * m + at) << 40 | value, members.tobytes()) for value, members in dense]
            else:
                found += [np.sort(grown(members, similarity), axis=1) for _, members in dense]
        # No nulls: they would make nodes floating-point numbers.
        near, none = np.unique(np.concatenate(found), axis=0), [0] * len(full)
        if not whole:
            near = forest(near)
        ends = np.concatenate([near, np.array([none, none], np.int64).T])
        keys = np.array([0] * len(near) + [key for key, _ in full], np.int64)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1], "dense": np.arange(len(keys)) >= len(near), "key": keys, "members": [b""] * len(near) + [x for _, x in full]})

    dealt = nodes.select("node", "n", "prints").mapInPandas(deal, "f int, s int, part int, entries binary")
    return dealt.groupBy("f", "s", "part").applyInPandas(compare, "a long, b long, dense boolean, key long, members binary")


def candidates(nodes: DataFrame, rows: int, similarity: float) -> DataFrame:
    """Of classes (node, n, prints) made for that many rows: pairs (a, b), and, where ``dense`` is true, what is to be compared in place if links leave it apart; a stored table.

    Near pairs join classes to clusters. A task has the entries of one fingerprint, or, of more rows, a range of one of its tables, and returns as
    many near pairs as join its part of the clusters, so a large group makes less than a row a member and task. The pairs are each member with
    the first of its cluster; clusters of three or more have a dense row (a, key) for each member. Clusters of over CLUSTER members return all
    their near pairs instead, and their dense buckets (key, members).
    """
    count, m = plan_prints(rows, similarity)
    joined = stage(_compared(nodes, rows, count, m, similarity, False).select("a", "b").distinct(), "joined")
    found = components(joined)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    clusters = stage(found.join(sizes, "root"), "clusters")
    none = [F.lit(0).cast("long").alias("key"), F.lit(b"").alias("members")]
    small = clusters.where(F.col("c") <= CLUSTER)
    out = small.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(False).alias("dense"), *none)
    out = out.unionByName(small.where("c > 2").select(F.col("node").alias("a"), F.col("root").alias("b"), F.lit(True).alias("dense"), F.col("root").alias("key"), none[1]))
    if more := clusters.where(F.col("c") > CLUSTER).count():
        out = out.unionByName(_compared(nodes.join(clusters.where(F.col("c") > CLUSTER), "node", "left_semi"), more, count, m, similarity, True))
    out = stage(out, "candidates")
    release(joined, clusters)
    return out


def left_apart(dense: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Of dense buckets (key, members): (key, node, n, members) of those with a near member that the roots (node, root) leave apart, a stored table."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, members in zip(b["key"], b["members"], strict=True):
                e = np.frombuffer(members, _ENTRY)
                yield pd.DataFrame({"key": key, "node": e["node"], "n": e["n"].astype(np.int64), "x": e["x"][:, 0].view(np.int64), "y": e["x"][:, 1].view(np.int64)})

    def apart(b: pd.DataFrame) -> pd.DataFrame:
        e = np.empty(len(b), _ENTRY)
        e["node"], e["n"] = b["node"], b["n"]
        e["x"] = np.stack([b["x"].to_numpy(), b["y"].to_numpy()], axis=1).view(np.uint64)
        root = pd.factorize(b["root"])[0]
        main, columns = np.bincount(root).argmax(), _columns(e)
        # A pair that is apart has an end outside the most frequent root.
        every, marked = np.arange(len(e)), np.zeros(len(e), bool)
        for i in np.flatnonzero(root != main):
            near = every[_alike(columns, np.full(len(e), i), every, similarity)]
            near = near[root[near] != root[i]]
            if len(near):
                marked[near] = marked[i] = True
        return b.loc[marked, ["key", "node", "n"]]

    rows = dense.mapInPandas(unpack, "key long, node long, n long, x long, y long").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = rows.select("key", "node", "n", "x", "y", "root").groupBy("key").applyInPandas(apart, "key long, node long, n long")
    # Three members or more are compared; here two are enough.
    return stage(found.withColumn("members", F.lit(3)), "apart")


def _rooted_by_similarity(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, root), a stored table: equal roots for what links of at least that similarity join."""
    rows = docs.count()
    made = stage(minhash.classes(docs, words, id_col, text_col, plan_prints(rows, similarity)[0]), "classes")
    nodes = stage(made.groupBy("node").agg(F.first("n").alias("n"), F.first("prints").alias("prints"), F.first(F.struct(F.col("doc_id").alias("k0"), F.col("th").alias("k1"))).alias("k")), "nodes")
    near = candidates(nodes, rows, similarity)
    pairs = stage(near.where("NOT dense").select("a", "b").distinct(), "pairs")
    found = minhash.links(docs, nodes, pairs, words, similarity, id_col, text_col)
    roots = stage(components(found), "roots")
    shared = near.where("dense AND length(members) = 0").select("key", F.col("a").alias("node")).join(nodes.select("node", "n"), "node").withColumn("members", F.lit(3))
    full, kept = near.where("length(members) > 0").select("key", "members"), []
    if not full.isEmpty():
        kept = [left_apart(full, roots, similarity)]
        shared = shared.unionByName(kept[0].select(shared.columns))
    more = minhash.apart_links(docs, nodes, shared, roots, words, similarity, id_col, text_col)
    if more is not None and not more.isEmpty():
        roots = stage(components(found.unionByName(more)), "roots")
    out = stage(made.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root")), "rooted")
    release(made, nodes, near, pairs, *kept)
    return out


def _rooted(docs: DataFrame, words: int, max_bits: int, similarity: float | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, fp, root), a stored table; without fp if there is a similarity."""
    if similarity is not None:
        return _rooted_by_similarity(docs, words, similarity, id_col, text_col)
    fps = stage(fingerprints(docs, words, False, id_col, text_col), "fp")
    distinct = stage(fps.select("fp").distinct(), "fps")
    roots = linked(distinct, max_bits).withColumnRenamed("node", "fp")
    return stage(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id.

    component_id is the smallest id among the documents reachable over links, the document itself
    included (null if all these ids are null). Texts without words (null, empty, white space)
    have fingerprint zero and are linked like others. Shorter texts than a shingle are one shingle.
    Repeated rows fall into one component. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    rooted = _rooted(docs, words, max_bits, None, id_col, text_col)
    least = stage(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rooted.join(least, "root").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the one with the smallest id (null ids last); of rows alike in id and text, one.

    With ``similarity`` the links are documents with that share of common distinct shingles, among the near ones of several wider fingerprints
    of these shingles, whose number follows the similarity; ``max_bits`` is not used.
    """
    rooted = _rooted(docs, words, max_bits, similarity, id_col, text_col)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("k1"), F.col("x.th").alias("k2"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("k0"), F.xxhash64(text_col).alias("th"))
    kept = keyed.join(stage(first, "kept"), F.col("k0").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("k2")))
    return kept.groupBy("k0", "th").agg(F.first("row").alias("row")).select("row.*")
