"""Repeated substrings by sparse suffix sorting.

A text's windows of ``length`` bytes each choose an anchor: the leftmost of their GRAM-byte strings
with the smallest hash. Equal windows choose the same anchor, so only the suffixes that start at
anchors, about one in 150, are sorted, and only those whose gram occurs twice. What lies around an
anchor, as far as a window that chose it can reach, is its context. Contexts equal in every byte are
one class from the start, so copies cost one row; all windows of a class with two members repeat.

Within a gram's group the classes are sorted twice, by what follows the anchor and by what precedes
it, read backwards. That is deep-shallow sorting: a multikey sort on the first SHALLOW bytes; groups
that are still tied have long common prefixes and are ordered by blind tries. The sorted neighbours' common
prefixes number the classes at each depth; a window repeats if another class agrees with it on both
sides, to the depths at which the window starts and ends. Equal contexts are found by a gram's 64-bit
hash and a 64-bit digest of the context together; different contexts are told apart byte by byte.

Skew: a gram's repeats are counted by partial aggregation, and joins are sort-merge joins against
stored tables, whose hot partitions adaptive execution splits. A group of more than ``hot`` classes
is split by further bytes, as in a radix sort: its windows by where they start, cut where ``hot`` classes or more cease to
agree with one of them before or after the anchor, and then by all bytes that every window of such a range has, so
that only contexts that can share a window of the range
stay together. Within a range contexts that agree in all bytes of its windows are one class again. Parts that are
still hot are split on, down to single windows; all others are sorted as any group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage, text_of

LENGTH, GRAM, SHALLOW, HOT, AT_ONCE = 400, 100, 16, 60_000, 20_000
CHUNK, PLACE_BITS = 1 << 20, 21
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        size = CHUNK + 4096
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def _gram_hashes(part: np.ndarray, gram: int) -> np.ndarray:
    up, down = _power_tables()
    n = len(part)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:], dtype=np.uint64)
    x = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors of all windows."""
    n, width = len(raw), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    every, places, found = np.frombuffer(raw, np.uint8), [], []
    for at in range(0, n - length + 1, CHUNK):
        h = _gram_hashes(every[at : at + CHUNK + length - 1], gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        fill = -len(h) % width
        blocks = np.concatenate([keyed, np.full(fill, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(h) - width + 1
        place = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & low).astype(np.int64)
        place = place[np.flatnonzero(np.diff(place, prepend=-1))]
        places.append(place + at)
        found.append(h[place])
    where, first = np.unique(np.concatenate(places), return_index=True)
    return where, np.concatenate(found)[first]


class BlindTrie:
    """Orders strings of one length. Inner nodes know only the depth and bytes at which they branch."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.size = strings, len(strings[0])
        self.whole = [int.from_bytes(s, "big") for s in strings]
        self.root: object = [0]  # a leaf is a list of rows, an inner node a tuple (depth, children by byte)
        for i in range(1, len(strings)):
            self._add(i)

    def _add(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, tuple):  # blindly down to some leaf
            depth, children = node
            node = children.get(s[depth]) or next(iter(children.values()))
        leaf = node[0]
        differ = self.whole[i] ^ self.whole[leaf]
        if not differ:
            node.append(i)
            return
        same = self.size - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == same:
            node[1][s[same]] = [i]
            return
        made = (same, {s[same]: [i], self.strings[leaf][same]: node})
        if above is None:
            self.root = made
        else:
            above[1][s[above[0]]] = made

    def order(self) -> tuple[list[int], list[int]]:
        """Rows in order, and what each has in common with the one before (0 for the first)."""
        rows: list[int] = []
        common: list[int] = []
        todo = [(self.root, 0)]
        while todo:
            node, same = todo.pop()
            if isinstance(node, tuple):
                depth, children = node
                keys = sorted(children)
                todo += [(children[k], depth) for k in reversed(keys[1:])]
                todo.append((children[keys[0]], same))
            else:
                rows += node
                common += [same] + [self.size] * (len(node) - 1)
        return rows, common


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by group and string (rows of bytes); the order, and the prefix in common with the row before (-1: another group)."""
    n, size = strings.shape
    words = np.ascontiguousarray(strings[:, : SHALLOW - SHALLOW % 8]).view(">u8").astype(np.uint64)
    order = np.lexsort((*[words[:, j] for j in range(words.shape[1] - 1, -1, -1)], group))
    new_group = np.ones(n, bool)
    new_group[1:] = group[order][1:] != group[order][:-1]
    head = strings[order][:, :SHALLOW]
    differ = np.ones((n, head.shape[1] + 1), bool)
    differ[1:, :-1] = head[1:] != head[:-1]
    common = differ.argmax(1)
    common[new_group] = -1
    tied = np.flatnonzero(common == head.shape[1])
    if len(tied):
        begins = tied[np.flatnonzero(np.diff(tied, prepend=-2) > 1)] - 1
        ends = tied[np.flatnonzero(np.diff(tied, append=n + 2) > 1)] + 1
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            rows = order[a:b]
            if b - a == 2:
                x, y = strings[rows[0]], strings[rows[1]]
                at = np.flatnonzero(x != y)
                common[a + 1] = at[0] if len(at) else size
                if len(at) and x[at[0]] > y[at[0]]:
                    order[a], order[a + 1] = rows[1], rows[0]
                continue
            got, same = BlindTrie([strings[r].tobytes() for r in rows]).order()
            order[a:b] = rows[got]
            common[a + 1 : b] = same[1:]
    return order, common


def repeated_windows(group: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
    """Whether the window that starts d bytes before the anchor (a column for each d) repeats in another class of its group.

    before: the bytes before the anchor, read backwards, ``left`` of them real; after: those from the anchor on, ``right`` real.
    Only windows from ``lo`` to ``hi`` (not included) bytes before the anchor count; a group's rows agree in both.
    """
    n, reach, length = len(group), before.shape[1], after.shape[1]
    out = np.zeros((n, reach + 1), bool)
    sides = []
    for strings in (before, after):
        order, common = deep_shallow(group, strings)
        most = np.maximum(common, np.append(common[1:], -1))
        back = np.empty(n, np.int64)
        back[order] = most
        sides.append((order, common, back))
    (l_order, l_common, l_most), (r_order, r_common, r_most) = sides
    low = np.maximum(lo, length - np.minimum(r_most, right))
    high = np.minimum(np.minimum(l_most, left), reach if hi is None else np.asarray(hi) - 1)
    l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach + 1):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows) < 2:
            continue
        l_class[l_order] = np.cumsum(l_common < d)
        r_class[r_order] = np.cumsum(r_common < length - d)
        key = l_class[rows] * (n + 1) + r_class[rows]
        turn = np.argsort(key, kind="stable")
        same = key[turn][1:] == key[turn][:-1]
        again = np.zeros(len(rows), bool)
        again[1:] = same
        again[:-1] |= same
        out[rows[turn[again]], d] = True
    return out


def _spans(windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the bytes that each row's windows cover, relative to the anchor. Windows of one anchor overlap, so that is one span."""
    first = windows.argmax(1)
    last = windows.shape[1] - 1 - windows[:, ::-1].argmax(1)
    return -last, length - first


def _key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document's rows are found again by id and text; rows alike in both share their spans."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text"))


def _text_with(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    m = more.withColumnRenamed("doc_id", "m_id").withColumnRenamed("th", "m_th")
    return docs.join(m, docs["doc_id"].eqNullSafe(m["m_id"]) & (docs["th"] == m["m_th"]), how).drop("m_id", "m_th")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Of (doc_id, text, th): (doc_id, th, spans), the spans not yet merged, for documents that have any."""
    reach = length - gram
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part, out = b.iloc[at : at + 500], []
                for i, text in enumerate(part["text"]):
                    raw = text.encode("utf-8")
                    where, h = anchors(raw, length, gram)
                    if len(where):
                        low = np.maximum(0, where - reach)
                        c = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z], seed=s) for a, z, s in zip(low.tolist(), (where + length).tolist(), (where - low).tolist(), strict=True)), np.uint64, len(where))
                        out.append((np.full(len(where), i), h, c, where, np.full(len(where), len(raw))))
                if out:
                    i, h, c, where, size = map(np.concatenate, zip(*out, strict=True))
                    yield pd.DataFrame({"g": h.view(np.int64), "c": c.view(np.int64), "doc_id": part["doc_id"].take(i).array, "th": part["th"].to_numpy()[i], "pos": where, "n": size})

    found = stage(docs.select("doc_id", "th", "text").mapInPandas(find, f"g long, c long, doc_id {kind}, th long, pos long, n long"), "anchors")
    grams = stage(found.groupBy("g").agg(F.count(F.lit(1)).alias("times"), (F.min("c") != F.max("c")).alias("mixed")).where("times > 1").select("g", "mixed"), "grams")
    hits = stage(found.join(grams, "g"), "hits")
    whole = F.struct(F.greatest(F.lit(0), F.col("pos") - reach).alias("a"), F.least("n", F.col("pos") + length).alias("b"))
    spans = hits.where("not mixed").select("doc_id", "th", whole.alias("span"))

    classes = hits.where("mixed").groupBy("g", "c").agg(F.count(F.lit(1)).alias("times"), *[F.first(x).alias(x) for x in ("doc_id", "th", "pos")])
    classes = stage(classes, "classes")
    wanted = classes.groupBy("doc_id", "th").agg(F.collect_list(F.struct("g", "c", "times", "pos")).alias("wanted"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, rows in zip(b["text"], b["wanted"], strict=True):
                raw = text.encode("utf-8")
                made = [(r["g"], r["c"], r["times"], min(r["pos"], reach), raw[max(0, r["pos"] - reach) : r["pos"] + length]) for r in rows]
                for at in range(0, len(made), 2000):
                    yield pd.DataFrame(made[at : at + 2000], columns=["g", "c", "times", "lead", "context"])

    shown = stage(_text_with(_once(docs), wanted, "inner").select("text", "wanted").mapInPandas(contexts, "g long, c long, times long, lead int, context binary"), "contexts")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        before, after = np.zeros((n, reach), np.uint8), np.zeros((n, length), np.uint8)
        left, right = rows["lead"].to_numpy(np.int64), np.empty(n, np.int64)
        for i, (lead, raw) in enumerate(zip(left.tolist(), rows["context"], strict=True)):
            x = np.frombuffer(raw, np.uint8)
            before[i, :lead] = x[:lead][::-1]
            right[i] = len(x) - lead
            after[i, : right[i]] = x[lead:]
        group = rows.groupby(["g", "lo", "k"]).ngroup().to_numpy()
        lo, hi = rows["lo"].to_numpy(np.int64), rows["hi"].to_numpy(np.int64)
        windows = repeated_windows(group, before, after, left, right, lo, hi)
        d = np.arange(reach + 1)
        several = rows["times"].to_numpy() > 1
        windows[several] = ((d >= np.maximum(lo, length - right)[:, None]) & (d <= np.minimum(left, hi - 1)[:, None]))[several]
        a, b = _spans(windows, length)
        return rows[["g", "lo", "u"]].assign(a=a, b=b)[windows.any(1)]

    def sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups of a sorted partition, some thousands of rows at once."""
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += len(b)
            if size >= AT_ONCE:
                rows = pd.concat(held, ignore_index=True)
                last = (rows[["g", "lo", "k"]] == rows[["g", "lo", "k"]].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield solve(rows[~last])
                held, size = [rows[last]], int(last.sum())
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    def ordered(rows: DataFrame) -> DataFrame:
        """Of (g, lo, hi, k, u, times, lead, context): (g, lo, u, a, b), the span of each class's repeated windows."""
        return rows.repartition("g", "lo", "k").sortWithinPartitions("g", "lo", "k").mapInPandas(sorted_groups, "g long, lo int, u long, a long, b long")

    # At most classes / hot grams are hot, and a row of them is one number: small against a task's memory.
    hot_grams = stage(classes.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("g"), "hot")
    mixed = hits.where("mixed")
    zero = F.lit(0)
    cool = shown.join(hot_grams, "g", "left_anti").select("g", zero.alias("lo"), F.lit(reach + 1).alias("hi"), zero.cast("long").alias("k"), F.col("c").alias("u"), "times", "lead", "context")
    solved = stage(ordered(cool), "solved")
    ends = [solved.select("g", F.col("u").alias("c"), "a", "b")]
    if not hot_grams.isEmpty():

        group = ["g", "lo", "hi", "k"]
        kinds = "g long, lo int, hi int, k long"

        def agreed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[group].assign(l=[_common_end(x[:i], y[:j]) for i, x, j, y in zip(b["lead"], b["context"], b["at"], b["shape"], strict=True)], r=[_common_start(x[i:], y[j:]) for i, x, j, y in zip(b["lead"], b["context"], b["at"], b["shape"], strict=True)])

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for g, c, times, lead, raw, lo, hi, l, r in zip(*[b[x] for x in ("g", "c", "times", "lead", "context", "lo", "hi", "l", "r")], strict=True):
                    right = len(raw) - lead
                    cuts = sorted({lo, hi, min(hi, max(lo, length - r)), min(hi, max(lo, l + 1))})
                    if len(cuts) == 2:
                        cuts.insert(1, (lo + hi) // 2)
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        if x < y and max(x, length - right) <= min(y - 1, lead):
                            before, after = min(y - 1, lead), min(length - x, right)
                            k, u = xxhash.xxh3_64_intdigest(raw[lead - x : lead + length - y + 1]), xxhash.xxh3_64_intdigest(raw[lead - before : lead + after], seed=before)
                            out.append((g, c, times, x, y, k - 2**63, u - 2**63))
                yield pd.DataFrame(out, columns=["g", "c", "times", "lo", "hi", "k", "u"])

        todo = classes.join(hot_grams, "g").select("g", "c", zero.alias("lo"), F.lit(reach + 1).alias("hi"), zero.cast("long").alias("k"))
        todo = stage(todo, "todo")
        while not todo.isEmpty():
            heads = todo.groupBy(*group).agg(F.min("c").alias("c"))
            heads = stage(heads.join(shown, ["g", "c"]).select(*group, F.col("lead").alias("at"), F.col("context").alias("shape")), "heads")
            members = stage(todo.join(shown, ["g", "c"]), "members")
            depths = stage(members.join(heads, group).mapInPandas(agreed, f"{kinds}, l int, r int"), "depths")
            # How deep more than ``hot`` members agree with the group's head, on either side.
            depth = lambda side: depths.groupBy(*group, side).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy(F.desc(side)))).where(F.col("upto") > hot).groupBy(*group).agg(F.max(side).alias(side))  # noqa: B023, E731
            cuts = stage(depth("l").join(depth("r"), group), "cuts")
            tags = stage(members.join(cuts, group).mapInPandas(split, "g long, c long, times long, lo int, hi int, k long, u long"), "tags")
            alike = stage(tags.groupBy(*group, "u").agg(F.sum("times").alias("times"), F.min("c").alias("c")), "alike")
            sizes = stage(alike.groupBy(*group).agg(F.count(F.lit(1)).alias("m"), F.sum("times").alias("all")).where("all > 1").drop("all"), "sizes")
            small = alike.join(sizes.where(F.col("m") <= hot).drop("m"), group)
            found_here = stage(ordered(small.join(shown.select("g", "c", "lead", "context"), ["g", "c"]).select(*group, "u", "times", "lead", "context")), "solved")
            ends.append(stage(tags.join(found_here, ["g", "lo", "u"]).select("g", "c", "a", "b"), "ends"))
            left = stage(tags.join(sizes.where(F.col("m") > hot).drop("m"), group).select("g", "c", *group[1:]), "todo")
            release(todo, heads, members, depths, cuts, tags, alike, sizes, found_here)
            todo = left
    every = ends[0]
    for more in ends[1:]:
        every = every.unionByName(more)
    if len(ends) > 1:
        # A context's windows from several ranges: they all hold the anchor, so they are one span.
        every = stage(every.groupBy("g", "c").agg(F.min("a").alias("a"), F.max("b").alias("b")), "ends")
    parts = mixed.join(every, ["g", "c"])
    spans = spans.unionByName(parts.select("doc_id", "th", F.struct((F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b")).alias("span")))
    # Rows alike in id and text have the same spans: a set has each once.
    return spans.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))


def _common_start(x: bytes, y: bytes) -> int:
    """How many bytes two strings begin with alike."""
    n = min(len(x), len(y))
    return n - -(-(int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() // 8)


def _common_end(x: bytes, y: bytes) -> int:
    return _common_start(x[::-1], y[::-1])


def _once(docs: DataFrame) -> DataFrame:
    """One of the rows that are alike in id and text."""
    again = stage(docs.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    if again.isEmpty():
        return docs
    a = again.select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"))
    same = docs["doc_id"].eqNullSafe(a["a_id"]) & (docs["th"] == a["a_th"])
    first = docs.join(a, same, "left_semi").groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    return docs.join(a, same, "left_anti").unionByName(first.select(*docs.columns))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and ``kept``, the bytes that stay, or ``kept_text`` and ``kept_chars``, on request).

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in the
    same document or another; texts are UTF-8 bytes, and a match never crosses documents. A null text
    is empty. Repeated rows repeat each other. What stays may be no valid UTF-8. An empty table gives
    an empty result; other columns are ignored. In kept_text half characters at the ends of what stays are left out.
    """
    keyed = _key(docs, id_col, text_col)
    found = repeated_spans(keyed, length, gram, hot)
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part, out = b.iloc[at : at + 1000], []
                for text, spans in zip(part["text"], part["spans"], strict=True):
                    raw = text.encode("utf-8")
                    runs = merge([(s["a"], s["b"]) for s in spans]) if spans is not None else []
                    ends = [0, *[x for r in runs for x in r], len(raw)]
                    kept = b"".join(raw[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True)) if runs else raw
                    out.append((len(raw), sum(z - a for a, z in runs), len(runs), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": z} for a, z in runs], *([kept] if with_bytes else []), *((left := kept.decode("utf-8", "ignore") if runs else text, len(left)) if with_text else [])))
                made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_bytes + ["kept_text", "kept_chars"] * with_text)
                made.insert(0, "doc_id", part["doc_id"].array)
                yield made

    whole = _text_with(keyed, found, "left").select("doc_id", "text", "spans")
    return whole.mapInPandas(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: long, b: long>>" + ", kept binary" * with_bytes + ", kept_text string, kept_chars long" * with_text)
