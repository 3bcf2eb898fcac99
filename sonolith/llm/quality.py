"""Quality classifier with hierarchical empirical Bayes.

A document's evidence comes from a logistic model over words, word beginnings and binned style ratios.
A mark is a word, or a beginning that one, two or three of the document's distinct words share: rare
words of one stem count together, in any language. For each target all marks that go with it beyond
SIGNIFICANT standard deviations are taken, however many. The model is fitted on at
most TRAIN_ROWS labelled rows (the bound is the parameter ``train_rows``). Sites add what the other
documents there look like, without the document itself: the posterior mean of a path is shrunk toward its host's, and a
host's toward the global mean, each by a strength that the method of moments finds from how far sites differ
beyond chance. A sparse path thus has its host's prior, and a sparse host the global one. The
document's log odds are its log likelihood ratio plus the log odds of its path.

Two targets are judged alike: low quality and toxicity. A document is kept if neither is more
likely than not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

TRAIN_ROWS, SIGNIFICANT, BINS, LEAST_DOCS = 20_000, 6.0, 8, 3
BEGINNINGS, MOST_WORDS, SLICE, BLOCK = (3, 4, 5, 6), 3, 1_000_000, 1024
TARGETS = ("low", "toxic")
# What lies between words: all but letters, and numbers that are no decimal digits.
_BETWEEN = r"[^\pL\p{Nl}\p{No}]+"
_ODD = 0x9E3779B97F4A7C15
_known: list[np.ndarray] = []
# Bytes of each class whose share of the text is a style ratio.
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:", "!", "?", "|", "*#$%&@^~", "<>{}[]()/\\", "\"'`-_=+")
_TABLE = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _TABLE[[ord(c) for c in _chars]] = _i + 1
_TABLE[128:] = len(_CLASSES) + 1
STYLES = len(_CLASSES) + 1 + 6


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd number and of its inverse, modulo 2**64."""
    if not _known or len(_known[0]) < n:
        _known[:] = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[:1] = 1
            _known.append(np.cumprod(steps, dtype=np.uint64))
    return _known[0], _known[1]


def stems(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct words: (word's place, id) for each word and each of its beginnings. Ids are signed 64-bit numbers, their lowest two bits clear."""
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    letters = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters begin
    first = np.searchsorted(letters, begins)
    sizes = np.diff(np.append(first, len(letters) - 1))
    places, found = [], []
    for n in (0, *BEGINNINGS):
        who = np.flatnonzero(sizes >= max(n, 1))
        end = letters[first[who] + n] if n else ends[who]
        x = (sums[end] - sums[begins[who]]) * down[begins[who]]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x += np.uint64(n * _ODD % 2**64)  # a beginning is no word of its own
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        places.append(who)
        found.append((x ^ (x >> np.uint64(31))).view(np.int64) & ~np.int64(3))
    return np.concatenate(places), np.concatenate(found)


class Described:
    """A slice of texts: style ratios of each, the slice's distinct words in lower case, and which of them each text holds."""

    def __init__(self, texts: list[str | None]):
        texts = [t if isinstance(t, str) else "" for t in texts]
        spaced = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.string())), _BETWEEN, " ")
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        flat = lists.flatten().dictionary_encode()
        self.words, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        empty = pc.index(self.words, "").as_py()
        if empty >= 0:  # a text without a word
            row, codes = row[codes != empty], codes[codes != empty]
        pair = np.sort(row * max(1, len(self.words)) + codes)
        pair = pair[np.diff(pair, prepend=-1) != 0]
        self.row, self.code = np.divmod(pair, max(1, len(self.words)))
        n, kinds = np.maximum(1, np.bincount(row, minlength=len(texts))), np.bincount(self.row, minlength=len(texts))
        again = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=len(texts)) / n
        shares, rest = np.empty((len(texts), len(_CLASSES) + 1)), np.empty((len(texts), 3))
        for i, t in enumerate(texts):
            raw, parts = np.frombuffer(t.encode("utf-8"), np.uint8), t.split()
            shares[i] = np.bincount(_TABLE[raw], minlength=len(_CLASSES) + 2)[1:] / max(1, len(raw))
            rest[i] = np.log1p(len(parts)), np.log1p(len(parts) / (t.count("\n") + 1)), len("".join(parts)) / max(1, len(parts))
        capital = shares[:, 0] / np.maximum(1e-9, shares[:, 0] + shares[:, 1])
        self.style = np.column_stack([shares, capital, kinds / n**0.8, again, rest])

    def stems(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, stem, number of its words that the stem reaches) for the wanted stems (sorted), by their places."""
        word, stem = stems(self.words)
        at = np.searchsorted(wanted, stem)
        held = at < len(wanted)
        held[held] = wanted[at[held]] == stem[held]
        word, at = word[held], at[held]
        order = np.argsort(word, kind="stable")
        at, many = at[order], np.bincount(word, minlength=len(self.words))
        size = many[self.code]
        place = np.repeat((np.cumsum(many) - many)[self.code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pair = np.sort(np.repeat(self.row, size) * max(1, len(wanted)) + at[place])
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        row, at = np.divmod(pair[starts], max(1, len(wanted)))
        return row, at, np.diff(np.append(starts, len(pair)))


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of at most SLICE characters, or one longer text."""
    some, size = [], 0
    for t in texts:
        n = len(t) if isinstance(t, str) else 0
        if some and size + n > SLICE:
            yield some
            some, size = [], 0
        some.append(t)
        size += n
    if some:
        yield some


class Classifier:
    """Two logistic models over bins of style ratios and chosen marks."""

    def __init__(self, edges: np.ndarray, chosen: np.ndarray, weights: np.ndarray, prior: np.ndarray):
        self.edges, self.chosen, self.weights, self.prior = edges, chosen, weights, prior

    def bins(self, style: np.ndarray) -> np.ndarray:
        return np.arange(STYLES) * BINS + (self.edges < style[..., None]).sum(-1)

    def prepare(self) -> None:
        """For each stem the weights that one, two or three of its words add up to."""
        self.names = np.unique(self.chosen & ~np.int64(3))
        sums = np.zeros((len(self.names), MOST_WORDS + 1, len(TARGETS)))
        at = np.searchsorted(self.names, self.chosen & ~np.int64(3))
        sums[at, self.chosen & np.int64(3)] = self.weights[STYLES * BINS : -1]
        self.sums = np.cumsum(sums, axis=1)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """log likelihood ratio of each target for each text: the model's log odds without its prior's."""
        out = [np.zeros((0, len(TARGETS)))]
        for some in slices(texts):
            seen = Described(some)
            got = self.weights[self.bins(seen.style)].sum(1) + self.weights[-1] - self.prior
            row, stem, n = seen.stems(self.names)
            more = self.sums[stem, np.minimum(n, MOST_WORDS)]
            for t in range(len(TARGETS)):
                got[:, t] += np.bincount(row, weights=more[:, t], minlength=len(some))
            out.append(got)
        return np.concatenate(out)


def _logistic(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], size: int, ridge: float = 1.0, steps: int = 300) -> np.ndarray:
    """Weights over ``size`` columns by L-BFGS, given blocks of rows: their columns that are one, where each row's begin, how many they are, and what is true; a ridge on all but the last, the constant."""
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-3

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = (penalty * w) @ w / 2, penalty * w
        for at, starts, lengths, true in blocks:
            z = np.add.reduceat(w[at], starts)
            loss += np.logaddexp(0, z).sum() - true @ z
            slope += np.bincount(at, np.repeat(1 / (1 + np.exp(-np.clip(z, -500, 500))) - true, lengths), minlength=size)
        return float(loss), slope

    w, past = np.zeros(size), []
    loss, slope = value(w)
    for _ in range(steps):
        step, used = slope.copy(), []
        for s, g in reversed(past):
            used.append((s @ step) / (s @ g))
            step -= used[-1] * g
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).sum())
        for (s, g), x in zip(past, reversed(used), strict=True):
            step += s * (x - (g @ step) / (s @ g))
        t = 1.0
        while True:
            now, fresh = value(w - t * step)
            if now <= loss - 1e-4 * t * (slope @ step) or t < 1e-9:
                break
            t /= 2
        if t < 1e-9:
            break
        if -t * step @ (fresh - slope) > 1e-12:
            past = [*past[-9:], (-t * step, fresh - slope)]
        gain, w, loss, slope = loss - now, w - t * step, now, fresh
        if gain < 1e-8 * max(1.0, abs(loss)):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier | None:
    """Of docs (doc_id, text) and labels (doc_id, quality, toxic); None without labelled rows."""
    # At most train_rows rows of integers: the bound of the broadcast.
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "quality", "toxic").limit(train_rows)
    joined = docs.join(F.broadcast(some), "doc_id").select((F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for some in slices(b["text"].tolist()):
                seen, here = Described(some), b.iloc[at : at + len(some)]
                at += len(some)
                every = np.unique(stems(seen.words)[1])
                row, at_stem, n = seen.stems(every)
                times = np.minimum(n, MOST_WORDS)
                marks = np.repeat(every[at_stem], times) | (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + 1)
                cuts = np.searchsorted(np.repeat(row, times), np.arange(1, len(some)))
                yield pd.DataFrame({"low": here["low"].to_numpy(), "toxic": here["toxic"].to_numpy(), "style": list(seen.style), "marks": np.split(marks, cuts)})

    rows = stage(joined.mapInPandas(run, "low int, toxic int, style array<double>, marks array<long>"), "labelled")
    n, *hits = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(t), F.lit(0)) for t in TARGETS]).first()
    if not n:
        return None
    sums = rows.select(*TARGETS, F.explode("marks").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).where(F.col("n") >= LEAST_DOCS)
    beyond = []
    for t, hit in zip(TARGETS, hits, strict=True):
        rate = float(hit) / n
        beyond.append((F.abs(F.col(t) - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1e-9) >= SIGNIFICANT).alias(t))
    picked = sums.select("mark", *beyond).where(" OR ".join(TARGETS)).orderBy("mark").toPandas()
    chosen = picked["mark"].to_numpy(np.int64)
    kind = np.uint16 if STYLES * BINS + len(chosen) < 2**16 else np.int32  # of a column's number

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A batch as one row of packed arrays: the driver holds no object for each mark."""
        for b in batches:
            held = []
            for m in b["marks"]:
                m = np.asarray(m, np.int64)
                at = np.searchsorted(chosen, m)
                at[at == len(chosen)] = 0
                held.append(at[chosen[at] == m].astype(kind) if len(chosen) else np.zeros(0, kind))
            if held:
                y, style = b[list(TARGETS)].to_numpy(np.int8), np.array(b["style"].tolist(), float)
                packed = [y, style, np.array([len(h) for h in held], np.int32), np.concatenate(held)]
                yield pd.DataFrame({k: [v.tobytes()] for k, v in zip(("y", "style", "lengths", "held"), packed, strict=True)})

    found = rows.mapInPandas(pick, "y binary, style binary, lengths binary, held binary").collect()
    y, style, lengths, held = (np.concatenate([np.frombuffer(r[k], t) for r in found]) for k, t in (("y", np.int8), ("style", float), ("lengths", np.int32), ("held", kind)))
    del found
    y, style = y.reshape(-1, 2).astype(float), style.reshape(-1, STYLES)
    model = Classifier(np.quantile(style, np.arange(1, BINS) / BINS, axis=0).T, chosen, np.zeros((0, 2)), np.zeros(2))
    size = STYLES * BINS + len(chosen) + 1
    begins = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def block(at: int, own: np.ndarray, true: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Some rows' columns that are one: bins, the target's own marks and the constant."""
        to = min(at + BLOCK, len(lengths))
        marks = held[begins[at] : begins[to]]
        mine = own[marks]
        row = np.repeat(np.arange(to - at), lengths[at:to])[mine]
        many = np.bincount(row, minlength=to - at)
        sizes = many + STYLES + 1
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), kind)
        out[starts[:, None] + np.arange(STYLES)] = model.bins(style[at:to])
        out[starts[row] + STYLES + np.arange(len(row)) - (np.cumsum(many) - many)[row]] = marks[mine].astype(np.int64) + STYLES * BINS
        out[starts + sizes - 1] = size - 1
        return out, starts, sizes, true[at:to]

    weights = []
    for i, t in enumerate(TARGETS):
        # Each target's model has its own marks.
        own = picked[t].to_numpy(bool)
        weights.append(_logistic([block(at, own, y[:, i]) for at in range(0, len(lengths), BLOCK)], size))
    model.weights = np.stack(weights, axis=1)
    share = (y.sum(0) + 0.5) / (len(y) + 1)
    model.prior = np.log(share / (1 - share))
    model.prepare()
    return model


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(rows: DataFrame, n: str, s: str, toward: Column) -> float:
    """The prior's strength by the method of moments: how far group means differ beyond what chance gives."""
    mean = F.col(s) / F.col(n)
    got = rows.agg(
        F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * (mean - toward) * (mean - toward)).alias("between"), F.sum(toward * (1 - toward)).alias("chance"), F.sum(F.col(n) * toward * (1 - toward)).alias("total")
    ).first()
    if not got["n"]:
        return 1.0
    var, excess = got["total"] / got["n"], max(1e-9, (got["between"] - got["chance"]) / got["n"])
    return float(min(1e6, max(1.0, var / excess - 1)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, p_low, p_toxic, kept (and ``row``, all its columns, with ``carry``).

    Null hosts and paths are sites of their own. A null text counts as empty. Labels without an id or
    value are ignored; without any label nothing is evident and all is kept. Rows that repeat an id are judged
    each on its own. An empty table gives an empty result; no column name of ``docs`` can clash.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(slim, labels, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.struct(host.isNull(), path.isNull()).cast("string").alias("none"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )

    @F.pandas_udf("low double, toxic double")
    def evidence(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        got = m.evidence(text.tolist()) if m is not None else np.full((len(text), 2), -1.0)
        return pd.DataFrame(got, columns=list(TARGETS))

    priors = model.prior if model is not None else np.zeros(2)
    judged = named.withColumn("e", evidence("text"))
    keep = ["doc_id", "host", "none", "path", "e.low", "e.toxic"] + (["row"] if carry else [])
    judged = stage(judged.select(*keep), "evidence")
    site = ["host", "none", "path"]
    odds = {t: 1 / (1 + F.exp(-(F.col(t) + float(priors[i])))) for i, t in enumerate(TARGETS)}
    paths = stage(judged.groupBy(*site).agg(F.count(F.lit(1)).alias("n"), *[F.sum(odds[t]).alias(t) for t in TARGETS]), "paths")
    hosts = paths.groupBy("host", F.substring("none", 1, 5).alias("hn")).agg(F.sum("n").alias("hosts_n"), *[F.sum(t).alias(f"host_{t}") for t in TARGETS])
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    both = stage(paths.withColumn("hn", F.substring("none", 1, 5)).join(hosts, ["host", "hn"]), "sites")
    out = judged.join(both.select(*site, *[F.col(c).alias(f"path_{c}") for c in ("n", *TARGETS)], "hosts_n", *[f"host_{t}" for t in TARGETS]), site)
    judged_odds = []
    for i, t in enumerate(TARGETS):
        start, own = 1 / (1 + float(np.exp(-priors[i]))), odds[t]
        # The global mean of the others and of one document that the model's prior stands for.
        top = (F.lit(float(total[t] or 0) + start) - own) / F.lit(float(total["n"] or 1))
        whole = F.lit(float(total[t]) / total["n"] if total["n"] else 0.5)
        k1 = _strength(hosts, "hosts_n", f"host_{t}", whole)
        k2 = _strength(both, "n", t, (F.col(f"host_{t}") + k1 * whole) / (F.col("hosts_n") + k1))
        at_host = (F.col(f"host_{t}") - own + k1 * top) / (F.col("hosts_n") - 1 + k1)
        prior = (F.col(f"path_{t}") - own + k2 * at_host) / (F.col("path_n") - 1 + k2)
        judged_odds.append((1 / (1 + F.exp(-(F.col(t) + _logit(prior))))).alias(f"p_{t}"))
    out = out.select("doc_id", *(["row"] if carry else []), *judged_odds)
    return out.withColumn("kept", (F.col("p_low") <= 0.5) & (F.col("p_toxic") <= 0.5))
