"""Streams of chunks: the kernels of whole clips, with their state kept between micro-batches.

A stream's rows are CHUNKS. Chunks of a clip may come in any order and are processed in theirs; the
last one (``is_last``) brings the tail out. The state of a clip is its kernels' arrays, the number
of the next chunk and the chunks that came too early.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import CHUNKS, Format, StreamError
from ..operators import kernels as K

TAIL_CHUNK = 4096
COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]


def chunked(clips: DataFrame, channels: int, frames: int = 4096) -> DataFrame:
    """Clips as CHUNKS."""
    n = F.floor(F.size("samples") / channels).cast("long")
    last = F.greatest(F.ceil(n / frames) - 1, F.lit(0).cast("long"))
    rows = clips.select("clip_id", "samples", n.alias("n"), last.alias("z"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    start = F.col("seq") * frames
    part = F.slice("samples", (start * channels + 1).cast("int"), F.lit(frames * channels))
    return rows.select("clip_id", "seq", start.alias("start_frame"), F.least(F.lit(frames).cast("long"), F.col("n") - start).cast("int").alias("n_frames"), (F.col("seq") == F.col("z")).alias("is_last"), part.alias("samples"))


def joined(chunks: DataFrame) -> DataFrame:
    """CHUNKS as clips, in the order of their numbers."""
    whole = chunks.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "samples"))).alias("c"))
    return whole.select("clip_id", F.flatten(F.transform("c", lambda x: x["samples"])).alias("samples"))


class Pipe:
    """A chain over one clip, chunk by chunk. ``feed`` gives what each chunk gives; after the last, the tails cascade."""

    def __init__(self, make: Callable[[], Sequence[K.Kernel]], fmt: Format, kept: bytes | None = None):
        self.fmt, self.chain = fmt, list(make())
        for k in self.chain:
            k.start(1, fmt.channels, fmt.sample_rate)
        self.times, self.next, self.early = [0] * len(self.chain), 0, {}
        if kept:
            states, self.times, self.next, self.early = pickle.loads(kept)
            for k, s in zip(self.chain, states, strict=True):
                k.state = s

    def keep(self) -> bytes:
        return pickle.dumps(([k.state for k in self.chain], self.times, self.next, self.early))

    def _through(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        for i in range(first, len(self.chain)):
            if isinstance(self.chain[i], K.Biquad):
                x = self.chain[i].sweep(x)
                self.times[i] += len(x)
                continue
            out = np.empty_like(x)
            for j in range(len(x)):
                out[j] = self.chain[i].step(self.times[i], x[j : j + 1])[0]
                self.times[i] += 1
            x = out
        return x

    def feed(self, seq: int, x: np.ndarray, is_last: bool, tail: bool) -> Iterator[tuple[np.ndarray, bool]]:
        if seq < self.next or seq in self.early:
            raise StreamError(f"chunk {seq} came twice")
        self.early[seq] = (x, is_last)
        while self.next in self.early:
            x, is_last = self.early.pop(self.next)
            self.next += 1
            if not is_last:
                yield self._through(x), False
                continue
            if self.early:
                raise StreamError("chunks follow the last one")
            parts = [self._through(x)]
            for i, k in enumerate(self.chain if tail else []):
                left = k.tail(self.fmt.sample_rate)
                if isinstance(k, K.Biquad) and not any(v.any() for v in k.state.values()):
                    left = 0
                while left:
                    n = min(left, TAIL_CHUNK)
                    parts.append(self._through(np.zeros((n, self.fmt.channels)), i))
                    left -= n
            yield np.concatenate(parts), True


def _rows(pipe: Pipe, key: int, b: pd.DataFrame, fmt: Format, tail: bool) -> list[tuple]:
    out = []
    for r in b.sort_values("seq").itertuples():
        seq = pipe.next
        for x, last in pipe.feed(int(r.seq), np.asarray(r.samples, np.float64).reshape(-1, fmt.channels), bool(r.is_last), tail):
            out.append((key, seq, pipe.times[0] - len(x) if pipe.chain else 0, len(x), last, x.ravel()))
            seq += 1
    return out


def process(chunks: DataFrame, make: Callable[[], Sequence[K.Kernel]], fmt: Format, tail: bool = True, idle_seconds: float | None = None) -> DataFrame:
    """CHUNKS through a chain, batch or stream. In a batch, clips are grouped and need no kept state.

    In a stream the state of a clip whose last chunk doesn't come stays, or goes after ``idle_seconds`` without a chunk.
    """
    if not chunks.isStreaming:

        def whole(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            pipe = Pipe(make, fmt)
            made = _rows(pipe, key[0], b, fmt, tail)
            if pipe.early:
                raise StreamError(f"clip {key[0]}: chunk {pipe.next} is missing")
            return pd.DataFrame(made, columns=COLUMNS)

        return chunks.groupBy("clip_id").applyInPandas(whole, CHUNKS)

    def some(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pipe = Pipe(make, fmt, state.get[0] if state.exists else None)
        rows = [x for b in batches for x in _rows(pipe, key[0], b, fmt, tail)]
        if any(r[4] for r in rows):
            state.remove()
        else:
            state.update((pipe.keep(),))
            if idle_seconds is not None:
                state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame(rows, columns=COLUMNS)

    return chunks.groupBy("clip_id").applyInPandasWithState(some, CHUNKS, "kept binary", "append", GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout)


def map_chunks(chunks: DataFrame, f: Callable[[F.Column], F.Column] | Callable) -> DataFrame:
    """A function without memory over the samples of each chunk."""
    return chunks.withColumn("samples", f(F.col("samples")))


def meter(chunks: DataFrame) -> DataFrame:
    """Peak and root mean square of each chunk."""
    s = F.col("samples")
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)
    return chunks.select("clip_id", "seq", "n_frames", F.aggregate(s, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))).alias("peak"), F.when(F.size(s) > 0, F.sqrt(total / F.size(s))).otherwise(0.0).alias("rms"))


def progress(chunks: DataFrame, expected: int) -> DataFrame:
    """Frames so far by clip, and their share of what is expected, at most 1."""
    done = F.sum("n_frames").over(Window.partitionBy("clip_id").orderBy("seq"))
    return chunks.select("clip_id", "seq", done.alias("frames"), F.least(F.lit(1.0), done / float(expected)).alias("ratio"))


def tee(stream: DataFrame, folders: Sequence[str], checkpoint: str):
    """One pass of a stream into several folders of Parquet."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for folder in folders:
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
