"""Language-model scoring by a hidden Markov model over word classes.

The vocabulary counts cover every training text and stay distributed. The commonest words are word
classes of their own; all others fall into hashed buckets, within which a word has its smoothed
share of the bucket. So the model's tables have a fixed size while the counts behind them grow with
the corpus, and the probabilities of all known words and of one unknown word a bucket sum to one.

Baum-Welch: from seeded emissions about the unigram and states that tend to stay, each of PASSES passes
runs the scaled forward and backward recursions over all training texts and sums expected counts across
partitions. Scoring is the scaled forward recursion over each whole text, in double precision.
Texts are split, and a slice's distinct words found, by Arrow; each is looked up once a slice.

A word's count is looked up in at most DICTIONARY of the commonest words within the task; all other words of
a document are rows that join the counts, so none is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

STATES, OWN, BUCKETS, DICTIONARY, PASSES, SEED = 8, 3000, 1024, 200_000, 4, 17
# The start: how far emissions differ from the unigram (of the logarithm), and how likely a state stays.
SPREAD, STAYS = 1.0, 0.97
CLASSES = OWN + BUCKETS
END = b"\n"
#: Entries of a task's running counts, tokens that the recursions hold at once, and bytes of text that are split at once.
FLUSH, HELD, SLICE = 1_000_000, 1_000_000, 16_000_000


def split_words(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """Of slices of texts: (from, to, distinct words, the words' places among them, how many words each text has). A-Z in lower case; words are what lies between ASCII white space."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, before + SLICE, "right")))
        lists = pc.ascii_split_whitespace(texts.slice(at, to - at))
        found = lists.flatten().dictionary_encode()
        codes, sizes = found.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        empty = pc.index(found.dictionary, "").as_py()  # before the first and after the last white space
        if empty >= 0:
            there = codes != empty
            sizes = np.diff(np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])])
            codes = codes[there]
        yield at, to, found.dictionary.cast(pa.binary()), codes, sizes
        at, before = to, int(upto[to - 1])


def bucket(word: bytes) -> int:
    return OWN + zlib.crc32(word) % BUCKETS


def count_words(texts: DataFrame) -> DataFrame:
    """Of (text): (word, n) over all tokens. Each task adds up what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            made = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": made["word"], "n": made["n_sum"]})

        for b in batches:
            if b.num_rows:
                held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([b.num_rows], pa.int64())}))
            for _, _, words, codes, _ in split_words(b.column(0)):
                n = np.bincount(codes, minlength=len(words))
                held.append(pa.table({"word": words.filter(pa.array(n > 0)), "n": pa.array(n[n > 0].astype(np.int64))}))
                if sum(t.num_rows for t in held) > FLUSH:
                    held = [summed()]
                    if held[0].num_rows > FLUSH // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from summed().to_batches()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Of (word, n): ``most`` words at most, all those above a count; a histogram of some hundred rows finds the count, so no task sends more than its share to the driver."""
    level = F.floor(F.log2("n") * 16)
    least, total = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return counts.where(F.col("n") >= least) if least else counts.limit(0)


class Lexicon:
    """What a task knows of words: the dictionary's classes and counts, and each bucket's size."""

    def __init__(self, words: list[bytes], counts: np.ndarray, bucket_words: np.ndarray, bucket_tokens: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        own = np.arange(len(words)) < OWN
        self.cls = np.array([i if i < OWN else bucket(w) for i, w in enumerate(words)], np.uint16)
        self.log_count = np.log10(counts + 0.5)
        size = bucket_tokens + 0.5 * (bucket_words + 1)
        self.log_size = np.log10(size)
        self.log_share = np.where(own, 0.0, self.log_count - self.log_size[np.where(own, 0, self.cls.astype(int) - OWN)]) if len(words) else np.zeros(0)
        mass = np.bincount(self.cls, weights=np.where(own, counts, 0), minlength=CLASSES).astype(float)
        mass[OWN:] += size
        mass[min(len(words), OWN) : OWN] = 0
        self.unigram = mass / mass.sum()


def read_classes(docs: DataFrame, lexicon) -> DataFrame:
    """Of (rid, doc_id, held_out, text): classes of the tokens as 16-bit numbers, sums over dictionary words, and the other words with their counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        get = lex.at.get
        for b in batches:
            for at, to, words, codes, sizes in split_words(b.column(3)):
                names, rows = [*words.to_pylist(), END], to - at
                # The end is a word after all others of its text.
                codes = np.insert(codes.astype(np.int64), np.cumsum(sizes), len(names) - 1)
                sizes = sizes + 1
                i = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
                known, new = i >= 0, np.flatnonzero(i < 0)
                cls, log_count, log_share = np.zeros(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names))
                cls[known], log_count[known], log_share[known] = (x[i[known]] for x in (lex.cls, lex.log_count, lex.log_share)) if known.any() else (0, 0, 0)
                cls[new] = [bucket(names[j]) for j in new.tolist()]
                log_share[new] = -lex.log_size[cls[new] - OWN]
                row = np.repeat(np.arange(rows), sizes)
                sums = [np.bincount(row, weights=x[codes], minlength=rows) for x in (known, log_count, log_share)]
                rare = np.flatnonzero(~known[codes])
                pair, times = np.unique(row[rare] * len(names) + codes[rare], return_counts=True)
                begins = pa.array(np.searchsorted(pair // len(names), np.arange(rows + 1)).astype(np.int32))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 2
                seq = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(cls[codes].astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(k).slice(at, rows) for k in range(3)], seq, pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                        pa.ListArray.from_arrays(begins, pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(pair % len(names)))), pa.ListArray.from_arrays(begins, pa.array(times.astype(np.int64))),
                    ],
                    ["rid", "doc_id", "held_out", "seq", "n_tokens", "known", "base", "share", "rare", "times"],
                )

    return docs.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, seq binary, n_tokens long, known long, base double, share double, rare array<binary>, times array<long>")


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start (states), move (states, states), emit (classes, states)."""
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, unigram: np.ndarray, states: int = STATES) -> Model:
        rng = np.random.default_rng(SEED)
        emit = unigram[:, None] * np.exp(rng.normal(0, SPREAD, (len(unigram), states)))
        move = np.full((states, states), (1 - STAYS) / max(1, states - 1))
        np.fill_diagonal(move, STAYS)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def of_counts(cls, counts: np.ndarray, unigram: np.ndarray, states: int = STATES) -> Model:
        """Expected counts, flat, each table smoothed: emissions toward the unigram."""
        start, rest = counts[:states], counts[states:]
        move, emit = rest[: states * states].reshape(states, states), rest[states * states :].reshape(-1, states)
        emit = emit + 20 * unigram[:, None]
        return cls((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))


class Batch:
    """Sequences from the longest, laid out step by step: step t has the token t of those that are longer."""

    def __init__(self, seqs: list[np.ndarray]):
        sizes = np.array([len(s) for s in seqs], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        flat = np.concatenate([seqs[i] for i in self.order]).astype(np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        steps = int(self.sizes[0])
        self.active = np.searchsorted(-self.sizes, -np.arange(steps), "left")  # sequences with more than t tokens
        self.ends = np.cumsum(self.active)
        self.obs = np.empty(len(flat), np.int64)
        for t in range(steps):
            n = self.active[t]
            self.obs[self.ends[t] - n : self.ends[t]] = flat[starts[:n] + t]


def forward(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's likelihood."""
    b = Batch(seqs)
    out, alpha = np.zeros(len(seqs)), None
    for t, n in enumerate(b.active.tolist()):
        e = model.emit[b.obs[b.ends[t] - n : b.ends[t]]]
        alpha = model.start * e if alpha is None else (alpha[:n] @ model.move) * e
        s = alpha.sum(1)
        alpha /= s[:, None]
        out[:n] += np.log10(s)
    back = np.empty(len(seqs))
    back[b.order] = out
    return back


def expected(model: Model, seqs: list[np.ndarray], dtype: type = np.float32) -> np.ndarray:
    """Expected counts of starts, moves and emissions, flat."""
    b, k = Batch(seqs), len(model.start)
    start, move, emit = model.start.astype(dtype), model.move.astype(dtype), model.emit.astype(dtype)
    alpha, scale = np.empty((len(b.obs), k), dtype), np.empty(len(b.obs), dtype)
    before = None
    for t, n in enumerate(b.active.tolist()):
        at = slice(b.ends[t] - n, b.ends[t])
        a = (start if before is None else before[:n] @ move) * emit[b.obs[at]]
        scale[at] = a.sum(1)
        a /= scale[at, None]
        alpha[at] = before = a
    moves, beta, after = np.zeros((k, k)), None, 0
    for t in range(len(b.active) - 1, -1, -1):
        n = b.active[t]
        at = slice(b.ends[t] - n, b.ends[t])
        now = np.ones((n, k), dtype)
        if after:
            moves += alpha[at][:after].T @ beta
            now[:after] = beta @ move.T
        weight = emit[b.obs[at]] * now / scale[at, None]
        alpha[at] *= now
        beta, after = weight, n
    moves *= model.move
    first = alpha[: b.active[0]].sum(0)
    emits = np.stack([np.bincount(b.obs, weights=alpha[:, j], minlength=model.emit.shape[0]) for j in range(k)], axis=1)
    return np.concatenate([first.astype(float), moves.ravel(), emits.ravel()])


def _groups(column: pd.Series) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of rows of at most HELD tokens, or one longer row."""
    seqs = [np.frombuffer(x, "<u2") for x in column]
    at = 0
    while at < len(seqs):
        to, size = at, 0
        while to < len(seqs) and (to == at or size + len(seqs[to]) <= HELD):
            size += len(seqs[to])
            to += 1
        yield at, to, seqs[at:to]
        at = to


def baum_welch(training: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One pass over all training sequences (seq); counts are summed by entry across partitions."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for _, _, seqs in _groups(b["seq"]):
                got = expected(shared.value, seqs)
                total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"entry": at.astype(np.int32), "n": total[at]})

    # A fixed-size table: states x (1 + states + classes) entries.
    sums = training.select("seq").mapInPandas(run, "entry int, n double").groupBy("entry").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(model.start) * (1 + len(model.start) + CLASSES))
    counts[sums["entry"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    return Model.of_counts(counts, unigram, len(model.start))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows where ``held_out`` isn't true. base_score is the smoothed unigram's log10
    probability, score the model's; both cover every token of the whole text, its end included. A
    null or empty text is its end alone. Unknown words have count 0. Without any training row
    nothing is known and the model is uniform over its classes. Rows that repeat an id are scored each on its own. An empty
    table gives an empty result; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = stage(count_words(base.where(~F.col("held_out"))), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = commonest(counts, DICTIONARY).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, known = [bytes(w) for w in top["word"]], top["n"].to_numpy(float)
    sizes = counts.groupBy((F.crc32("word") % BUCKETS).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).toPandas()
    in_words, in_tokens = np.zeros(BUCKETS), np.zeros(BUCKETS)
    in_words[sizes["b"].to_numpy(int)], in_tokens[sizes["b"].to_numpy(int)] = sizes["v"].to_numpy(float), sizes["n"].to_numpy(float)
    for w, n in zip(words[:OWN], known[:OWN], strict=True):  # they have classes of their own
        in_words[bucket(w) - OWN] -= 1
        in_tokens[bucket(w) - OWN] -= n
    lex = Lexicon(words, known, in_words, in_tokens)
    rows = stage(read_classes(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text"), sc.broadcast(lex)), "classes")

    training = rows.where(~F.col("held_out"))
    model = Model.first(lex.unigram, states)
    for _ in range(passes if total["n"] else 0):
        model = baum_welch(training, model, lex.unigram)
    shared = sc.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b))
            for at, to, seqs in _groups(b["seq"]):
                out[at:to] = forward(shared.value, seqs)
            yield b.drop(columns=["seq"]).assign(path=out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    paths = rows.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "share", "seq").mapInPandas(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, share double, path double")
    rare = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left")
    seen = F.when(F.col("n") > 0, F.col("times")).otherwise(0)
    per_row = found.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(seen).alias("rare_known"))
    all_log = np.log10(total["n"] + 0.5 * (total["v"] + 1))
    got = F.coalesce("rare_log", F.lit(0.0))
    return paths.join(per_row, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + got - F.col("n_tokens") * float(all_log)).alias("base_score"), (F.col("path") + F.col("share") + got).alias("score"),
    )
