"""Kernels over clips in Spark: one Arrow batch holds many clips, which step together.

A clip is one row, so no shuffle is needed. Consecutive kernels are one function call: a chain
crosses between the JVM and Python once. Clips leave a function in batches of their own, bounded by
samples: a batch of rows that comes in may give many times its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Format
from . import kernels as K

#: Samples, tail and kernel state included, that step at once.
BLOCK_SAMPLES = 4_000_000
#: Samples that a function hands to the JVM at a time.
SENT_SAMPLES = 1_000_000


def _as_frames(x, channels: int) -> np.ndarray:
    return np.asarray(x, np.float64).reshape(-1, channels)


def blocks(clips: list[np.ndarray], more: int, held: int = 0, most: int | None = None) -> list[range]:
    """Runs of clips whose padded block, with ``held`` numbers a clip besides, stays within the bound; a longer clip is alone."""
    most, out, at = most or BLOCK_SAMPLES, [], 0
    while at < len(clips):
        to, longest = at, 0
        while to < len(clips):
            longest = max(longest, len(clips[to]) + more)
            if to > at and (longest * clips[to].shape[1] + held) * (to - at + 1) > most:
                break
            to += 1
        out.append(range(at, to))
        at = to
    return out


def state_size(kernel: K.Kernel, fmt: Format) -> int:
    """Numbers that a kernel keeps for a clip."""
    kernel.start(1, fmt.channels, fmt.sample_rate)
    return sum(v.size for v in kernel.state.values())


def through(chain: Sequence[K.Kernel], clips: list[np.ndarray], fmt: Format, tail: bool) -> Iterator[np.ndarray]:
    """Each clip through the whole chain, in order. A block goes through all kernels before the next one begins."""
    more = sum(k.tail(fmt.sample_rate) for k in chain) if tail else 0
    for part in blocks(clips, more, max((state_size(k, fmt) for k in chain), default=0)):
        done = [clips[i] for i in part]
        for kernel in chain:
            done = K.run(kernel, done, fmt.channels, fmt.sample_rate, tail)
        yield from done


def sent(arrays: Iterable[np.ndarray]) -> Iterator[pd.Series]:
    """Arrays in batches of a bounded number of samples; a longer array is alone."""
    some, n = [], 0
    for a in arrays:
        if some and n + len(a) > SENT_SAMPLES:
            yield pd.Series(some, dtype=object)
            some, n = [], 0
        some.append(a)
        n += len(a)
    if some:
        yield pd.Series(some, dtype=object)


def apply(samples: Column, fmt: Format, make: Callable[[], Sequence[K.Kernel]], tail: bool = True) -> Column:
    """The chain that ``make`` builds, over each clip. With ``tail`` a clip ends when the chain has rung out, and latency is cut off; without, its length stays."""

    @F.pandas_udf("array<double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return sent(y.ravel() for x in batches for y in through(make(), [_as_frames(v, fmt.channels) for v in x], fmt, tail))

    return f(samples)


def limit(samples: Column, fmt: Format, **options) -> Column:
    """The limiter offline: its look-ahead is cut off and the clip keeps its length."""

    def limited(x: pd.Series) -> Iterator[np.ndarray]:
        clips = [_as_frames(v, fmt.channels) for v in x]
        for y, c in zip(through([K.Limiter(**options)], clips, fmt, True), clips, strict=True):
            yield y[: len(c)].ravel()

    @F.pandas_udf("array<double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return sent(y for x in batches for y in limited(x))

    return f(samples)


def compress_beside(samples: Column, side: Column, fmt: Format, side_end: str = "silence", **options) -> Column:
    """Each clip compressed by the level of another one beside it."""

    def compressed(v, w) -> np.ndarray:
        level = np.abs(_as_frames(w, fmt.channels)).max(1) if len(w) else np.zeros(0)
        return K.run(K.Compressor(sidechain=level, sidechain_end=side_end, **options), [_as_frames(v, fmt.channels)], fmt.channels, fmt.sample_rate, False)[0].ravel()

    @F.pandas_udf("array<double>")
    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return sent(compressed(v, w) for x, y in batches for v, w in zip(x, y, strict=True))

    return f(samples, side)


def _measure(samples: Column, fmt: Format, f: Callable[[np.ndarray], float]) -> Column:
    @F.pandas_udf("double")
    def g(x: pd.Series) -> pd.Series:
        return pd.Series([f(_as_frames(v, fmt.channels)) for v in x], dtype=float)

    return g(samples)


def true_peak(samples: Column, fmt: Format, oversampling: int = 4) -> Column:
    return _measure(samples, fmt, lambda v: max((K.true_peak(v[:, c], oversampling) for c in range(v.shape[1])), default=0.0))


def resample_sinc(samples: Column, fmt: Format, rate: int) -> Column:
    @F.pandas_udf("array<double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return sent(K.resample_sinc(_as_frames(v, fmt.channels), fmt.sample_rate, rate).ravel() for x in batches for v in x)

    return f(samples)


def _loudness(samples: Column, fmt: Format, last: float | None) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series) -> pd.Series:
        clips = [_as_frames(v, fmt.channels) for v in x]
        if last is not None:
            keep = K.frames_of(last, fmt.sample_rate)
            clips = [c[-keep:] if keep < len(c) else c for c in clips]
        weighted = through([K.Biquad(*K.k_weighting(fmt.sample_rate))], clips, fmt, False)
        how = (lambda w: K.integrated(w, fmt.sample_rate, fmt.channel_layout)) if last is None else (lambda w: K.ungated(w, fmt.channel_layout))
        return pd.Series([how(w) for w in weighted], dtype=float)

    return f(samples)


def lufs(samples: Column, fmt: Format) -> Column:
    """Integrated loudness; minus infinity for silence."""
    return _loudness(samples, fmt, None)


def momentary(samples: Column, fmt: Format) -> Column:
    return _loudness(samples, fmt, K.BLOCK)


def short_term(samples: Column, fmt: Format) -> Column:
    return _loudness(samples, fmt, K.SHORT)


def pink_noise(n: Column, seed: Column, level: float = 1.0) -> Column:
    """n samples of pink noise: white noise through leaky sums."""
    # Each sum's leak and its share of the white noise.
    leaks = ((0.99765, 0.0990460), (0.96300, 0.2965164), (0.57000, 1.0526913), (0.7616, -0.5511934), (0.8500, -0.7616))

    def noise(count: int, seed: int) -> np.ndarray:
        white = np.random.default_rng(abs(int(seed))).uniform(-1, 1, int(count))
        y, sums = np.empty(int(count)), [0.0] * len(leaks)
        for i, w in enumerate(white.tolist()):
            sums = [leak * v + share * w for v, (leak, share) in zip(sums, leaks, strict=True)]
            y[i] = sum(sums) + w * 0.115926 + w * 0.5362
        return np.clip(y * level, -1, 1)

    @F.pandas_udf("array<double>")
    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return sent(noise(k, s) for counts, seeds in batches for k, s in zip(counts, seeds, strict=True))

    return f(n, seed)


NO_LOUDNESS = -math.inf
