"""Best-fit packing of tokenized documents with exact-complement hashing.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` lengths times SALTS rows,
and a row more for each ROWS_A_SALT pieces of a length that is still commoner. The plan works on counts: for each length from the longest,
the gap is filled exactly by one, two or three lengths looked up by their sum, as often as the
counts allow at once; what is left goes best-fit, equal bins together. Each such step uses up a
length or a kind of bin, so the plan stays small too. Pieces then take the plan's places by their
rank within their length; ranks are counted within salted parts of each length, SALTS or more, of about
ROWS_A_SALT pieces at most, so that no common length is a hot key.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CAPACITY, END_ID, SALTS, ROWS_A_SALT = 4096, 1, 128, 20_000
#: Entries of a worker's cache of parts, and bytes of text that are split at once.
CACHE, SLICE = 800_000, 16_000_000
# How the word-end tokenizer prepares text, as its file says it.
PREPARES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# The same on chunks of printable ASCII without the sign that special tokens begin with, and of composed Latin letters with marks, but for the one whose lower case is two.
_PLAIN = r"^[!-;=-~À-ÖØ-öø-įı-ſ]+\z"
_SIMPLE, _STOPS = r"^[a-zß-öø-įı-ſ]+[.,;:!?]?\z", ".,;:!?"
_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZÀ-ÖØ-öø-ſ]+|[0-9]|[^a-zA-ZÀ-ÖØ-öø-ſ0-9\n]+")
_SPACES = re.compile(rb"[ \t-\r]")


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _mask(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)


class Encoder:
    """A tokenizer's ids as bytes.

    A word-end tokenizer drops white space and no token spans it, so a text's ids are those of its
    chunks between ASCII white space. A slice of texts is split and its distinct chunks are found by Arrow;
    each is looked at once, and the slice's ids are gathered from theirs. Plain chunks are split into
    the tokenizer's parts all at once. Parts recur: a bounded cache keeps their ids, and new ones go to
    the tokenizer's model many at once, for the last token of each part tells its end; chunks that
    aren't plain go through the whole tokenizer. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.end = end_id
        self.whole = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        self.by_chunk = made["model"].get("end_of_word_suffix") == "</w>" and {k: made[k] for k in PREPARES} == PREPARES and all(t["content"].startswith("<") for t in made["added_tokens"])
        if self.by_chunk:
            self.ends = np.zeros(max(made["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in made["model"]["vocab"].items() if t.endswith("</w>")]] = True
            made |= {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(made))
            self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c and b != 10}

    def _of_parts(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts, one after the other, and how many each has."""
        parts = self.parts
        got = list(map(parts.get, names))
        lacking = [i for i, x in enumerate(got) if x is None]
        if len(parts) + len(lacking) > CACHE:
            parts.clear()
            parts[""] = b""
        new = [names[i] for i in lacking]
        ascii_only = [x for x in new if x.isascii()]
        if len(ascii_only) < len(new):
            self._learn([x for x in new if not x.isascii()], True)
        self._learn(ascii_only, False)
        for i, x in zip(lacking, new, strict=True):
            got[i] = parts[x]
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4

    def _learn(self, new: list[str], marked: bool) -> None:
        """Ask the model for parts. One letter stands for each byte, ASCII letters for themselves; Latin-1 decoding gives a letter a byte, and the table moves some."""
        parts = self.parts
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            shown = "\n".join(part)
            if marked:
                shown = shown.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode(shown, add_special_tokens=False).ids, "<u4")
            raw, begin = ids.tobytes(), 0
            for x, end in zip(part, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                parts[x] = raw[begin:end]
                begin = end

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks in one array, where each chunk's begin, and how many it has."""
        plain = _mask(chunks, _PLAIN)
        low = pc.utf8_lower(chunks.filter(pa.array(plain)))
        simple = _mask(low, _SIMPLE)
        one, several = low.filter(pa.array(simple)), low.filter(pa.array(~simple))
        stems = pc.utf8_rtrim(one, _STOPS)
        found = _PARTS.findall("\n".join(several.to_pylist()))
        parts = pa.concat_arrays([stems, pa.array(found, pa.string()), pa.array([*_STOPS, "\n"])]).dictionary_encode()
        codes = parts.indices.to_numpy()
        signs, line = codes[-1 - len(_STOPS) : -1], codes[-1]
        names = parts.dictionary.to_pylist()
        names[line] = ""  # between chunks, and where no sign follows a stem
        flat, sizes = self._of_parts(names)
        begins = np.cumsum(sizes) - sizes
        pairs = np.full((len(one), 2), line, codes.dtype)
        pairs[:, 0] = codes[: len(one)]
        for sign, code in zip(_STOPS, signs, strict=True):
            pairs[pc.ends_with(one, sign).to_numpy(zero_copy_only=False), 1] = code
        rest = codes[len(one) : len(one) + len(found)]
        others = [np.array(self.whole.encode(x, add_special_tokens=False).ids, "<u4") for x in chunks.filter(pa.array(~plain)).to_pylist()]
        every = np.concatenate([pairs.ravel(), rest])
        n_ids, at = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        where = np.flatnonzero(plain)
        order = np.concatenate([where[simple], where[~simple], np.flatnonzero(~plain)])
        by_chunk = np.cumsum(rest == line)
        n_ids[order] = np.concatenate([sizes[pairs].sum(1), np.bincount(by_chunk, weights=sizes[rest], minlength=len(several)).astype(np.int64), np.array([len(x) for x in others], np.int64)])
        at[order] = np.cumsum(n_ids[order]) - n_ids[order]
        return np.concatenate([_gather(flat, begins[every], sizes[every]), *others]), at, n_ids

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        flat, starts, sizes = self._of_chunks(chunks.dictionary)
        codes = chunks.indices.to_numpy()
        ids = _gather(flat, starts[codes], sizes[codes])
        upto = np.concatenate([[0], np.cumsum(sizes[codes])])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        raw = np.insert(ids, upto, self.end).astype("<u4", copy=False).tobytes()
        begin = 0
        for end in ((upto + np.arange(1, len(upto) + 1)) * 4).tolist():
            yield raw[begin:end]
            begin = end

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit numbers. A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_chunk:
            for t in texts.to_pylist():
                yield np.array([*self.whole.encode(t, add_special_tokens=False).ids, self.end], "<u4").tobytes()
            return
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < len(texts):
            to = int(np.searchsorted(upto, before + SLICE, "right"))
            if to == at:
                whole = [x[:-4] for part in _cut(texts[at].as_py().encode("utf-8")) for x in self._encode(pa.array([part.decode("utf-8")], pa.string()))]
                yield b"".join([*whole, np.array([self.end], "<u4").tobytes()])
                to = at + 1
            else:
                yield from self._encode(texts.slice(at, to - at))
            at, before = to, int(upto[to - 1])


def _cut(raw: bytes) -> Iterator[bytes]:
    """Parts of about SLICE bytes, cut at white space."""
    at = 0
    while at < len(raw):
        space = _SPACES.search(raw, at + SLICE)
        to = space.start() if space else len(raw)
        yield raw[at:to]
        at = to


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 upward in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encode(texts: pa.Array, tokenizer_path: str, end_id: int = END_ID) -> Iterator[bytes]:
    """Each text's ids and the end id, by this worker's encoder."""
    if (tokenizer_path, end_id) not in _ENCODERS:
        _ENCODERS[tokenizer_path, end_id] = Encoder(tokenizer_path, end_id)
    return _ENCODERS[tokenizer_path, end_id](texts)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's tokens and its end, cut only where they are more than ``capacity``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids = [], []
            for i, raw in enumerate(encode(b.column(1), tokenizer_path, end_id)):
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            row, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            made = [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if with_ids:
                made.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces counted by length."""
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] += n
    bins: list[tuple[tuple[int, ...], int]] = []
    if c[capacity]:
        bins.append(((capacity,), int(c[capacity])))
        c[capacity] = 0
    here = c > 0
    sums = np.rint(np.fft.irfft(np.fft.rfft(here.astype(float), 2 * capacity + 2) ** 2, 2 * capacity + 2))[: capacity + 1] > 0  # by sum: two lengths may have it

    def take(lengths: tuple[int, ...]) -> bool:
        """Consume the combination as often as the counts allow."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(c[x]) // k for x, k in need.items())
        if times < 1:
            return False
        for x, k in need.items():
            c[x] -= k * times
            here[x] = c[x] > 0
        bins.append((tuple(sorted(lengths, reverse=True)), times))
        return True

    def pair(total: int, besides: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths of that sum, the longer as long as can be, that are there besides others."""
        low = np.arange(1, total // 2 + 1)
        for x in low[here[low] & here[total - low]].tolist():
            both = (*besides, total - x, x)
            if all(c[y] >= both.count(y) for y in both):
                return total - x, x
        return None

    rest = []
    for length in range(capacity - 1, 0, -1):
        while c[length]:
            gap = capacity - length
            if here[gap] and take((length, gap)):
                continue
            if gap >= 2 and sums[gap] and (two := pair(gap, (length,))):
                take((length, *two))
                continue
            found = False
            if gap >= 3:
                one = np.arange(gap - 2, 0, -1)
                for x in one[here[one] & sums[gap - one]].tolist():
                    if c[x] < 1 + (x == length):
                        continue
                    if two := pair(gap - x, (length, x)):
                        found = take((length, x, *two))
                        break
                    if not pair(gap - x, ()):
                        sums[gap - x] = False
            if not found:
                rest.append((length, int(c[length])))
                c[length] = 0
                here[length] = False
    gaps: list[int] = []  # sorted
    open_bins: dict[int, list[list]] = {}

    def put(gap: int, lengths: tuple[int, ...], n: int) -> None:
        if gap not in open_bins:
            open_bins[gap] = []
            insort(gaps, gap)
        open_bins[gap].append([lengths, n])

    for length, n in rest:
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fit = capacity // length
                if n >= fit:
                    put(capacity - fit * length, (length,) * fit, n // fit)
                if n % fit:
                    put(capacity - n % fit * length, (length,) * (n % fit), 1)
                break
            gap = gaps[at]
            lengths, there = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            fit = min(gap // length, n)  # best fit puts the next ones in the same bin
            used = min(there, n // fit)
            put(gap - fit * length, (*lengths, *(length,) * fit), used)
            if there > used:
                put(gap, lengths, there - used)
            n -= used * fit
    return bins + [(lengths, n) for kinds in open_bins.values() for lengths, n in kinds]


def places(bins: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, times in a sequence), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in bins:
        offset, at = 0, 0
        while at < len(lengths):
            length, times = lengths[at], 1
            while at + times < len(lengths) and lengths[at + times] == length:
                times += 1
            rows.append((length, used.get(length, 0), sequence, offset, times))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
            at += times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...), which must be a stored table.

    A full piece is a sequence, numbered where it stands (from -1 down); it needs no plan and no shuffle.
    """
    spark, names = cut.sparkSession, [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema]
    alone = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = cut.where(F.col("length") < capacity)
    # At most ``capacity`` rows: the bound of the broadcast.
    counted = [(r["length"], max(SALTS, -(-r["n"] // ROWS_A_SALT))) for r in part.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    salts = F.broadcast(spark.createDataFrame(counted, "length long, salts long"))
    salted = part.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).select(*cut.columns, "salt")
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "salt"])
    length, salt, n = (sums[c].to_numpy(np.int64) for c in ("length", "salt", "n"))
    per_length = np.bincount(length, weights=n, minlength=capacity).astype(np.int64)
    where = places(plan({int(k): int(per_length[k]) for k in np.flatnonzero(per_length)}, capacity))
    before = np.cumsum(n) - n - (np.cumsum(per_length) - per_length)[length]
    shared = spark.sparkContext.broadcast((where, where[:, 0] << 44 | where[:, 1], length << 40 | salt, before))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, keys, groups, ranks = shared.value
        for b in batches:
            if not len(b):
                continue
            length = b["length"].to_numpy(np.int64)
            rank = ranks[np.searchsorted(groups, length << 40 | b["salt"].to_numpy(np.int64))] + b["rank"].to_numpy(np.int64)
            row = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            turn = rank - row[:, 1]
            yield b.drop(columns=["salt", "rank"]).assign(sequence_id=row[:, 2] + turn // row[:, 4], offset=row[:, 3] + turn % row[:, 4] * length)

    return alone.unionByName(ranked.mapInPandas(run, ", ".join(names) + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    A null or empty text is its end id alone, one piece of length 1. Rows that repeat an id are packed
    each on its own. An empty table gives an empty result. Other columns are ignored.
    """
    return pack(stage(pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "pieces"), capacity)
