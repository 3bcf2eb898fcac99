"""Chains of operations on clips, planned before they run.

``Clips`` collects steps. Pointwise and positional steps are column expressions, which Catalyst
merges; processors with memory wait until another kind of step or the end, and all that wait then
run as one Arrow function. Each step on PCM clips ends in their format again, rounding included;
only float clips, or runs of processors, stay unrounded inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import samples as A
from ..model import Format, InvalidParameter, frames_of
from ..operators import kernels as K
from ..operators import stateful as T


class Clips:
    """An immutable set of clips (clip_id, samples, ...) in one format."""

    def __init__(self, df: DataFrame, fmt: Format, waiting: tuple[Callable[[], K.Kernel | list[K.Kernel]], ...] = (), lambdas: bool = False):
        self._df, self.format, self._waiting, self._lambdas = df, fmt, waiting, lambdas

    # ---- plumbing

    def _to(self, f: Callable[[Column], Column], fmt: Format | None = None) -> Clips:
        """A step: samples as floats through ``f``, then into the format."""
        base, fmt = self.df(), fmt or self.format
        return Clips(base.withColumn("samples", A.from_float(f(A.to_float(F.col("samples"), self.format)), fmt)), fmt, lambdas=True)

    def _settled(self) -> Clips:
        """For a Python function that comes next."""
        made = self.df()
        return Clips(A.settled(made) if self._lambdas else made, self.format)

    def df(self, tail: bool = True) -> DataFrame:
        if not self._waiting:
            return self._df
        waiting = self._waiting

        def make() -> list[K.Kernel]:
            made = [w() for w in waiting]
            return [k for m in made for k in (m if isinstance(m, list) else [m])]

        s = T.apply(A.to_float(F.col("samples"), self.format), self.format, make, tail)
        return (A.settled(self._df) if self._lambdas else self._df).withColumn("samples", A.from_float(s, self.format))

    def steps(self) -> list[str]:
        """What waits to be fused."""
        return [type(k).__name__ for w in self._waiting for k in (lambda m: m if isinstance(m, list) else [m])(w())]

    def _timing(self, what: str) -> float:
        made = [w() for w in self._waiting]
        return sum(getattr(k, what)(self.format.sample_rate) for m in made for k in (m if isinstance(m, list) else [m])) / self.format.sample_rate

    def latency(self) -> float:
        return self._timing("latency")

    def tail_duration(self) -> float:
        return self._timing("tail")

    def _frames(self, seconds: float) -> int:
        return frames_of(seconds, self.format.sample_rate)

    # ---- steps

    def effect(self, make: Callable[[], K.Kernel | list[K.Kernel]] | str, **options) -> Clips:
        maker = (lambda: K.build(make, **options)) if isinstance(make, str) else make
        return Clips(self._df, self.format, (*self._waiting, maker), self._lambdas)

    def gain(self, db: float) -> Clips:
        return self._to(lambda s: A.gain(s, db))

    def map_samples(self, f: Callable[[Column], Column]) -> Clips:
        return self._to(lambda s: A.map_samples(s, f))

    def map_frames(self, f: Callable[[Column], Column]) -> Clips:
        return self._to(lambda s: A.map_frames(s, self.format.channels, f))

    def fade_in(self, seconds: float, curve: str = "linear") -> Clips:
        return self._to(lambda s: A.fade(s, self.format.channels, self.format.sample_rate, seconds, "in", curve))

    def fade_out(self, seconds: float, curve: str = "linear") -> Clips:
        return self._to(lambda s: A.fade(s, self.format.channels, self.format.sample_rate, seconds, "out", curve))

    def pan(self, position: float) -> Clips:
        self._need(1)
        return self._to(lambda s: A.pan(s, position), self.format.with_(channels=2))

    def balance(self, position: float) -> Clips:
        self._need(2)
        return self._to(lambda s: A.balance(s, position))

    def rotate(self, position: float) -> Clips:
        self._need(2)
        return self._to(lambda s: A.rotate(s, position))

    def _need(self, channels: int) -> None:
        if self.format.channels != channels:
            raise InvalidParameter(f"{channels} channels are needed, there are {self.format.channels}")

    def trim(self, threshold: float = 0.01) -> Clips:
        return self._to(lambda s: A.trim(s, self.format.channels, threshold))

    def slice(self, start: float, end: float) -> Clips:
        a, b = self._frames(start), self._frames(end)
        if b < a:
            raise InvalidParameter("a slice can't end before it starts")
        return self._to(lambda s: A.slice_frames(s, self.format.channels, a, b - a))

    def crop(self, start: float, duration: float) -> Clips:
        return self.slice(start, start + duration)

    def split(self, at: float) -> tuple[Clips, Clips]:
        k, big = self._frames(at), 2**30 // self.format.channels
        return self._to(lambda s: A.slice_frames(s, self.format.channels, 0, k)), self._to(lambda s: A.slice_frames(s, self.format.channels, k, big))

    def pad(self, before: float = 0.0, after: float = 0.0) -> Clips:
        return self._to(lambda s: A.pad(s, self.format.channels, self._frames(before), self._frames(after)))

    def insert_silence(self, at: float, duration: float) -> Clips:
        return self._to(lambda s: A.insert_silence(s, self.format.channels, self._frames(at), self._frames(duration)))

    def reverse(self) -> Clips:
        return self._to(lambda s: A.reverse(s, self.format.channels))

    def repeat(self, times: int) -> Clips:
        if times < 0:
            raise InvalidParameter("times can't be negative")
        return self._to(lambda s: A.repeat(s, times))

    def remove_dc_offset(self) -> Clips:
        return self._to(lambda s: A.remove_dc(s, self.format.channels))

    def convert(self, fmt: Format, resampler: str = "linear") -> Clips:
        """Channels first, then the rate, then the sample format."""
        if fmt == self.format and not self._waiting:
            return self
        mid = self.format.as_float().with_(channels=fmt.channels)
        even = lambda s: A.channels_to(s, self.format.channels, fmt.channels, self.format.channel_layout)
        if resampler == "windowed_sinc" and mid.sample_rate != fmt.sample_rate:
            return self._to(even, mid)._settled()._to(lambda s: T.resample_sinc(s, mid, fmt.sample_rate), fmt)
        return self._to(lambda s: A.resample_linear(even(s), fmt.channels, mid.sample_rate, fmt.sample_rate), fmt)

    def to_mono(self) -> Clips:
        return self.convert(self.format.with_(channels=1))

    def to_stereo(self) -> Clips:
        return self.convert(self.format.with_(channels=2))

    def resample(self, rate: int, resampler: str = "linear") -> Clips:
        return self.convert(self.format.with_(sample_rate=rate), resampler)

    def with_bit_depth(self, bits: int) -> Clips:
        return self.convert(self.format.with_(bit_depth=bits, sample_format="pcm"))

    def normalize(self, target_db: float = 0.0, mode: str = "peak") -> Clips:
        """Silence stays as it is."""
        if mode not in ("peak", "rms", "lufs"):
            raise InvalidParameter(f"no such mode: {mode}")

        def f(s: Column) -> Column:
            if mode != "lufs":
                return A.normalize(s, A.amplitude(target_db), A.peak if mode == "peak" else A.rms)
            now = T.lufs(s, self.format)
            factor = F.when(now > float("-inf"), F.pow(F.lit(10.0), (target_db - now) / 20.0)).otherwise(1.0)
            return F.zip_with(s, F.array_repeat(factor, F.size(s)), lambda x, k: x * k)

        return (self._settled() if mode == "lufs" else self)._to(f)

    def envelope(self, note_on: float, **shape) -> Clips:
        rate, ch = float(self.format.sample_rate), self.format.channels
        return self._to(lambda s: A.by_frame(s, ch, lambda x, t, c: x * A.envelope(t / rate, note_on, **shape)))

    def envelope_with_tail(self, note_on: float, **shape) -> Clips:
        """Under an envelope, drawn out until its release has ended."""
        return self._to(lambda s: A.render_with_tail(s, self.format.channels, self.format.sample_rate, note_on, **shape))

    def automate_gain(self, points, unit: str = "db") -> Clips:
        rate, ch = float(self.format.sample_rate), self.format.channels
        level = (lambda v: F.pow(F.lit(10.0), v / 20.0)) if unit == "db" else (lambda v: v)
        return self._to(lambda s: A.by_frame(s, ch, lambda x, t, c: x * level(A.automation(t / rate, points))))

    # ---- steps with another set of clips, joined by clip_id

    def _with(self, other: Clips, f: Callable[[Column, Column], Column]) -> Clips:
        """Both sets as floats in this format; clips without a partner are left as they are."""
        there = other.convert(self.format).df().select(F.col("clip_id").alias("other_id"), F.col("samples").alias("other_samples"))
        both = self.df().join(there, F.col("clip_id") == F.col("other_id"), "left")
        made = f(A.to_float(F.col("samples"), self.format), A.to_float(F.coalesce("other_samples", F.array().cast("array<double>")), self.format))
        return Clips(both.withColumn("samples", A.from_float(made, self.format)).drop("other_id", "other_samples"), self.format, lambdas=True)

    def concat(self, other: Clips) -> Clips:
        return self._with(other, F.concat)

    def prepend(self, other: Clips) -> Clips:
        return self._with(other, lambda a, b: F.concat(b, a))

    def overlay(self, other: Clips, at: float = 0.0) -> Clips:
        return self._with(other, lambda a, b: A.add(a, b, self._frames(at) * self.format.channels))

    def crossfade(self, other: Clips, duration: float) -> Clips:
        return self._with(other, lambda a, b: A.crossfade(a, b, self.format.channels, self.format.sample_rate, duration))

    def mix(self, other: Clips, strategy: str = "clip", gains: tuple[float, float] = (0.0, 0.0)) -> Clips:
        """Two clips added up; ``none``, ``clip``, ``normalize`` or ``soft_limit`` says what becomes of sums above full scale."""
        if strategy not in ("none", "clip", "normalize", "soft_limit"):
            raise InvalidParameter(f"no such strategy for two clips: {strategy}")

        def f(a: Column, b: Column) -> Column:
            s = A.add(A.gain(a, gains[0]), A.gain(b, gains[1]))
            if strategy == "clip":
                return F.transform(s, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
            if strategy == "soft_limit":
                return A.soft_limit(s)
            if strategy == "normalize":
                return F.zip_with(s, F.array_repeat(F.greatest(F.lit(1.0), A.peak(s)), F.size(s)), lambda x, k: x / k)
            return s

        return self._with(other, f)

    def show(self) -> str:
        """What the set is, in words."""
        f = self.format
        rate = f"{f.sample_rate / 1000:g}kHz" if f.sample_rate >= 1000 else f"{f.sample_rate}Hz"
        return f"Clips({ {1: 'mono', 2: 'stereo'}.get(f.channels, f'{f.channels}ch') }, {rate}, {f.bit_depth} bit {f.sample_format})"

    # ---- measures

    def stats(self) -> DataFrame:
        """A row a clip; the scalar measures share one pass over the array, the others one Arrow call."""
        df, ch, s = self._settled().df(), self.format.channels, A.to_float(F.col("samples"), self.format)
        n = A.n_frames(F.col("samples"), ch)
        base = df.select(
            "clip_id", n.alias("frames"), (n / self.format.sample_rate).alias("duration"), A.peak(s).alias("peak"), A.rms(s).alias("rms"), A.clipped(s, ch).alias("clipped"),
            F.array(*[A.channel_mean(s, ch, c) for c in range(ch)]).alias("dc_offsets"), A.zero_crossing_rate(s, ch).alias("zero_crossing_rate"),
            T.true_peak(s, self.format).alias("true_peak"), T.lufs(s, self.format).alias("lufs"),
        )
        return base.withColumns({"peak_dbfs": A.dbfs(F.col("peak")), "rms_dbfs": A.dbfs(F.col("rms")), "true_peak_dbfs": A.dbfs(F.col("true_peak")), "silent": F.col("peak") == 0})
