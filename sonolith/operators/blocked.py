"""One very long signal through a linear filter, in parallel.

A second-order section is linear, so a block's output is what it gives from rest plus what the
state before it still rings. Blocks are filtered from rest, many side by side, and report the state
they end in; those few numbers a block are carried forward; then every block adds its share. States are
carried on two levels: SPAN blocks are summed up as one affine map in a task of their own, only these maps
are gone through in order, and then each span carries its own blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Format, frames_of
from . import kernels as K
from . import stateful as T

SPAN = 1024


Section = tuple[float, ...]


def _states(kernel: K.Biquad, clip: int) -> list[float]:
    """What sections carry: the input's last two samples, and each section's last two."""
    names = ["x10", "x20"] + [f"{n}{i}" for i in range(len(kernel.now)) for n in ("y1", "y2")]
    return [float(kernel.state[n][clip, 0]) for n in names]


def ringing(sections: tuple[Section, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """What each number of the state before a block of n frames adds to its frames, (n, states), and to the state after it."""
    size = 2 + 2 * len(sections)
    k = K.Biquad(*sections)
    k.start(size, 1, 8_000)
    for i in range(len(sections)):
        for j, names in enumerate((("x1", "y1"), ("x2", "y2"))):
            k.state[f"{names[0]}{i}"][2 * i + j, 0] = k.state[f"{names[1]}{i}"][2 * i + 2 + j, 0] = 1.0
    out, still = np.zeros((n, size)), np.zeros((size, 1))
    for t in range(n):
        out[t] = k.step(t, still)[:, 0]
    return out, np.array([_states(k, j) for j in range(size)]).T


def filter_rows(signal: DataFrame, coefficients: Section | tuple[Section, ...], block: int = 65_536) -> DataFrame:
    """(frame, x) through one section or several, one after another, to (frame, y). Frames count from 0 without gaps; blocks of so many frames are rows of arrays on the way."""
    sections = coefficients if isinstance(coefficients[0], tuple) else (coefficients,)
    size = 2 + 2 * len(sections)
    rows = signal.groupBy(F.floor(F.col("frame") / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("r")).select("b", F.transform("r", lambda p: p["x"]).alias("x"))

    @F.pandas_udf("y array<double>, ends array<double>")
    def rest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            clips = [np.asarray(v, np.float64).reshape(-1, 1) for v in x]
            for part in T.blocks(clips, 0, most=T.SENT_SAMPLES):
                kernel = K.Biquad(*sections)
                some = [clips[i] for i in part]
                made = [y.ravel() for y in K.run(kernel, some, 1, 8_000, False)]
                places = np.empty(len(some), int)
                places[np.argsort([-len(c) for c in some], kind="stable")] = np.arange(len(some))
                yield pd.DataFrame({"y": made, "ends": [_states(kernel, j) for j in places.tolist()]})

    first = rows.withColumn("z", rest("x")).select("b", "z.y", "z.ends")
    ends = first.select("b", F.size("y").alias("n"), "ends")

    def steps(e: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """In the order of blocks: the block, and the map from the state before it to the state after, as a matrix and a shift."""
        tables: dict[int, np.ndarray] = {}
        for r in e.sort_values("b").itertuples():
            if r.n not in tables:
                tables[r.n] = ringing(sections, r.n)[1]
            yield r.b, tables[r.n], np.asarray(r.ends)

    def total(e: pd.DataFrame) -> pd.DataFrame:
        m, v = np.eye(size), np.zeros(size)
        for _, a, shift in steps(e):
            m, v = a @ m, a @ v + shift
        return pd.DataFrame({"span": [e["span"].iloc[0]], "m": [m.ravel()], "v": [v]})

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = np.zeros(size)
        for b in batches:
            out = []
            for span, m, v in zip(b["span"], b["m"], b["v"], strict=True):
                out.append((span, state))
                state = np.reshape(m, (size, size)) @ state + v
            yield pd.DataFrame(out, columns=["span", "state"])

    def within(e: pd.DataFrame) -> pd.DataFrame:
        state, out = np.asarray(e["state"].iloc[0]), []
        for b, a, shift in steps(e):
            out.append((b, state))
            state = a @ state + shift
        return pd.DataFrame(out, columns=["b", "state"])

    ends = ends.withColumn("span", F.floor(F.col("b") / SPAN))
    totals = ends.groupBy("span").applyInPandas(total, "span long, m array<double>, v array<double>")
    # A row for SPAN blocks goes through one task.
    begun = totals.repartition(1).sortWithinPartitions("span").mapInPandas(starts, "span long, state array<double>")
    states = ends.join(begun, "span").groupBy("span").applyInPandas(within, "b long, state array<double>")

    @F.pandas_udf("array<double>")
    def settle(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ring = np.zeros((0, size))
        for y, state in batches:
            if (n := max((len(v) for v in y), default=0)) > len(ring):
                ring = ringing(sections, n)[0]
            yield from T.sent(np.asarray(v) + ring[: len(v)] @ np.asarray(s) for v, s in zip(y, state, strict=True))

    whole = first.select("b", "y").join(states, "b").select("b", settle("y", "state").alias("y"))
    return whole.select("b", F.posexplode("y").alias("i", "y")).select((F.col("b") * block + F.col("i")).alias("frame"), "y")


def block_energies(signal: DataFrame, rate: int, block: int = 65_536) -> DataFrame:
    """Of a mono signal (frame, x): (block, energy), the mean squares of its K-weighted blocks of 0.4 s, one each 0.1 s. A shorter signal is one block."""
    size, step = frames_of(K.BLOCK, rate), max(frames_of(K.STEP, rate), 1)
    unit = math.gcd(size, step)
    n = signal.agg((F.max("frame") + 1).alias("n"))
    weighted = filter_rows(signal, K.k_weighting(rate), block)
    sums = weighted.groupBy(F.floor(F.col("frame") / unit).alias("u")).agg(F.sum(F.col("y") * F.col("y")).alias("e"))
    # A unit lies in the blocks that begin at most so many units before it.
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("u") - size // unit + 1) / (step // unit)))
    parts = sums.select("e", F.explode(F.sequence(low, F.floor(F.col("u") / (step // unit)))).alias("block"))
    energy = parts.groupBy("block").agg(F.sum("e").alias("e"))
    there = (F.col("block") == 0) | (F.col("block") * step + size <= n.scalar())
    return energy.where(there).select("block", (F.col("e") / F.least(F.lit(size), n.scalar())).alias("energy"))


def integrated(signal: DataFrame, rate: int, block: int = 65_536) -> DataFrame:
    """One row, lufs: the gated loudness of a mono signal (frame, x) of any length; minus infinity for silence."""
    loud = lambda e: K.OFFSET + 10 * F.log10(e)
    held = block_energies(signal, rate, block).where((F.col("energy") > 0) & (loud(F.col("energy")) >= K.ABSOLUTE))
    gate = held.agg((loud(F.avg("energy")) + K.RELATIVE).alias("gate"))
    return held.where(loud(F.col("energy")) >= gate.scalar()).agg(F.coalesce(loud(F.avg("energy")), F.lit(float("-inf"))).alias("lufs"))
