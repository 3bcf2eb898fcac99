"""Column functions over interleaved sample arrays: no shuffle, no Python.

Each takes an array column and literals, and gives an array or a number. Frames and channels are
found by index, so pointwise work is one ``transform``; totals are one ``aggregate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LAYOUTS, Format, InvalidParameter, frames_of

# ---- helpers


def _d(x: float) -> Column:
    return F.lit(float(x))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once. A lambda that names an expression evaluates it for each element; one that names this value reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """``samples`` in a projection of their own. Folded into a Python function's argument, an expression whose inner lambda names the value of an outer one can't be told from the function; what isn't deterministic is never folded."""
    return df.withColumn("samples", F.when(F.monotonically_increasing_id() >= 0, F.col("samples")))


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """For functions whose lambdas name the array: any array expression is evaluated once."""

    @wraps(f)
    def g(s: Column, *more, **options) -> Column:
        return let(s, lambda v: f(v, *more, **options))

    return g


def n_frames(s: Column, channels: int) -> Column:
    return F.floor(F.size(s) / channels).cast("int")


def by_frame(s: Column, channels: int, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f(sample, frame, channel) for each sample."""
    return F.transform(s, lambda x, i: f(x, F.floor(i / channels), i % channels))


@bound
def frame_arrays(s: Column, channels: int) -> Column:
    """The frames, each an array of its channels."""
    n = n_frames(s, channels)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.slice(s, t * channels + 1, F.lit(channels)))).otherwise(F.array().cast("array<array<double>>"))


def at(s: Column, index: Column) -> Column:
    """The sample at an index from 0."""
    return F.element_at(s, index.cast("int") + 1)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(_d(low), F.least(_d(high), x))


def amplitude(db: float) -> float:
    return 10.0 ** (db / 20.0)


def dbfs(x: Column) -> Column:
    """Decibels of an amplitude; minus infinity from zero down."""
    return F.when(x <= 0, _d(-math.inf)).otherwise(20.0 * F.log10(x))


# ---- sample formats


def _scales(fmt: Format) -> tuple[float, float, int]:
    shift = fmt.bit_depth - fmt.valid_bits
    return float(2 ** (fmt.valid_bits - 1)), float(2 ** (fmt.valid_bits - 1) - 1), 2**shift


def to_float(s: Column, fmt: Format) -> Column:
    """PCM codes as -1.0 to 1.0: both end points are exact, for the two signs have scales of their own."""
    if fmt.is_float:
        return s
    neg, pos, unit = _scales(fmt)
    return F.transform(s, lambda x: _clamp(F.when(x < 0, x / (neg * unit)).otherwise(x / (pos * unit)), -1, 1))


def to_pcm(s: Column, fmt: Format) -> Column:
    """-1.0 to 1.0 as PCM codes, rounded half away from zero; the valid bits stand at the top of the container."""
    neg, pos, unit = _scales(fmt)
    return F.transform(s, lambda x: _clamp(F.round(_clamp(x, -1, 1) * F.when(x < 0, _d(neg)).otherwise(_d(pos))), -neg, pos) * unit)


def from_float(s: Column, fmt: Format) -> Column:
    return s if fmt.is_float else to_pcm(s, fmt)


def dithered_pcm(s: Column, fmt: Format, seed: Column | int = 0) -> Column:
    """As to_pcm, with triangular noise of one step; the noise is a hash of seed and index, so reruns agree."""
    _, pos, _ = _scales(fmt)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    unit = lambda k, i: F.pmod(F.xxhash64(seed, F.lit(k), i), F.lit(2**53)) / float(2**53)
    return to_pcm(F.transform(s, lambda x, i: _clamp(_clamp(x, -1, 1) + (unit(1, i) - unit(2, i)) / pos, -1, 1)), fmt)


# ---- levels, places


def gain(s: Column, db: float) -> Column:
    return F.transform(s, lambda x: x * amplitude(db))


def _curve(x: Column, curve: str) -> Column:
    if curve == "linear":
        return x
    if curve == "exp":
        return x * x
    if curve == "log":
        return F.log10(1.0 + 9.0 * x)
    raise InvalidParameter(f"no such curve: {curve}")


@bound
def fade(s: Column, channels: int, rate: int, seconds: float, mode: str, curve: str = "linear") -> Column:
    if mode not in ("in", "out"):
        raise InvalidParameter(f"no such fade: {mode}")
    n = n_frames(s, channels)
    k = F.least(F.lit(frames_of(seconds, rate)), n)
    end = 1.0 if mode == "in" else 0.0

    def factor(t: Column) -> Column:
        away = t if mode == "in" else n - t - 1
        ratio = F.when(k == 1, _d(end)).otherwise(away / (k - 1))
        return _curve(_clamp(F.when(away < k, ratio).otherwise(1.0), 0, 1), curve)

    return F.when(k == 0, s).otherwise(by_frame(s, channels, lambda x, t, c: x * factor(t)))


def _power(position: float) -> tuple[float, float]:
    angle = (position + 1.0) * (math.pi / 4.0)
    return math.cos(angle), math.sin(angle)


def pan(s: Column, position: float) -> Column:
    """Mono to stereo with constant power."""
    left, right = _power(position)
    return F.flatten(F.transform(s, lambda x: F.array(x * left, x * right)))


def balance(s: Column, position: float) -> Column:
    """Stereo: the far side goes down."""
    down = math.cos(abs(position) * math.pi / 2.0)
    left, right = (down, 1.0) if position > 0 else (1.0, down) if position < 0 else (1.0, 1.0)
    return by_frame(s, 2, lambda x, t, c: x * F.when(c == 0, _d(left)).otherwise(_d(right)))


def _stereo(s: Column, f: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    return F.flatten(F.transform(frame_arrays(s, 2), lambda p: F.array(*f(p[0], p[1]))))


def rotate(s: Column, position: float) -> Column:
    a = position * math.pi / 4.0
    return _stereo(s, lambda l, r: (l * math.cos(a) - r * math.sin(a), l * math.sin(a) + r * math.cos(a)))  # noqa: E741


def widen(s: Column, width: float) -> Column:
    return _stereo(s, lambda l, r: ((l + r) / 2.0 + (l - r) / 2.0 * width, (l + r) / 2.0 - (l - r) / 2.0 * width))  # noqa: E741


def channels_to(s: Column, source: int, target: int, layout: Sequence[str] | None = None) -> Column:
    """Mean to one; copies from one; a speaker-aware downmix to two; folding or repeating otherwise."""
    if source == target:
        return s
    frames = frame_arrays(s, source)
    if source == 1:
        return F.flatten(F.transform(s, lambda x: F.array(*[x] * target)))
    total = lambda p, cs: sum((p[c] for c in cs[1:]), p[cs[0]])
    if target == 1:
        return F.transform(frames, lambda p: total(p, range(source)) / float(source))
    if target == 2 and source > 2:
        where = {name: i for i, name in enumerate(layout or LAYOUTS.get(source) or ())}
        pick = lambda p, *names: next((p[where[n]] for n in names if n in where), _d(0))
        known = {"front_left", "front_right", "front_center", "low_frequency", "side_left", "side_right", "back_left", "back_right"}
        more = [i for n, i in where.items() if n not in known]

        def down(p: Column) -> Column:
            extra = total(p, more) if more else _d(0)
            side = lambda a, surround: a + pick(p, "front_center") * 0.707 + pick(p, "low_frequency") * 0.5 + surround * 0.707 + extra * 0.5
            left = p[where["front_left"]] if "front_left" in where else p[0]
            right = p[where["front_right"]] if "front_right" in where else p[1]
            return F.array(side(left, pick(p, "side_left", "back_left")), side(right, pick(p, "side_right", "back_right")))

        return F.flatten(F.transform(frames, down))
    if source > target:
        return F.flatten(F.transform(frames, lambda p: F.array(*[p[c] + total(p, range(target, source)) / float(target) for c in range(target)])))
    return F.flatten(F.transform(frames, lambda p: F.array(*[p[c % source] for c in range(target)])))


def _channel(s: Column, channels: int, channel: int) -> Column:
    return F.filter(s, lambda x, i: i % channels == channel)


def channel_mean(s: Column, channels: int, channel: int) -> Column:
    own = _channel(s, channels, channel)
    return F.when(F.size(own) > 0, F.aggregate(own, _d(0), lambda a, x: a + x) / F.size(own)).otherwise(0.0)


def remove_dc(s: Column, channels: int) -> Column:
    return let(s, lambda v: let(F.array(*[channel_mean(v, channels, c) for c in range(channels)]), lambda m: by_frame(v, channels, lambda x, t, c: x - F.element_at(m, c.cast("int") + 1))))


@bound
def normalize(s: Column, target: float, level: Callable[[Column], Column]) -> Column:
    """Scaled so that a measure (peak, rms) is the target; silence stays as it is."""
    return let(level(s), lambda now: F.when(now > 0, F.transform(s, lambda x: x * (target / now))).otherwise(s))


def soft_limit(s: Column, threshold: float = 0.8, ceiling: float = 1.0, drive: float = 1.0) -> Column:
    reach = ceiling - threshold

    def f(x: Column) -> Column:
        over = threshold + reach * (1.0 - F.exp(-((F.abs(x) - threshold) * drive) / reach)) if reach > 0 else _d(threshold)
        return F.when(F.abs(x) <= threshold, x).otherwise(F.when(x < 0, -1.0).otherwise(1.0) * _clamp(over, threshold, ceiling))

    return F.transform(s, f)


# ---- ranges and sequences


def slice_frames(s: Column, channels: int, start: int | Column, count: int | Column) -> Column:
    """Frames from ``start``; what is out of range is not there."""
    start = start if isinstance(start, Column) else F.lit(start)
    count = count if isinstance(count, Column) else F.lit(count)
    return F.slice(s, (start * channels + 1).cast("int"), F.greatest(F.lit(0), count * channels).cast("int"))


@bound
def trim(s: Column, channels: int, threshold: float = 0.01) -> Column:
    """Without the frames before the first and after the last that reach the threshold on any channel."""
    loud = F.filter(F.transform(s, lambda x, i: F.when(F.abs(x) >= threshold, F.floor(i / channels))), lambda t: t.isNotNull())
    first, last = F.array_min(loud), F.array_max(loud)
    return F.when(F.size(loud) == 0, F.array().cast("array<double>")).otherwise(slice_frames(s, channels, first, last - first + 1))


def reverse(s: Column, channels: int) -> Column:
    return F.reverse(s) if channels == 1 else F.flatten(F.reverse(frame_arrays(s, channels)))


def silence(count: int | Column) -> Column:
    return F.array_repeat(_d(0), count)


def pad(s: Column, channels: int, before: int = 0, after: int = 0) -> Column:
    return F.concat(silence(before * channels), s, silence(after * channels))


def insert_silence(s: Column, channels: int, at_frame: int, count: int) -> Column:
    return F.concat(slice_frames(s, channels, 0, at_frame), silence(count * channels), slice_frames(s, channels, at_frame, n_frames(s, channels) - at_frame))


def repeat(s: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(s, times))


def _padded(s: Column, before: Column | int, after: Column) -> Column:
    return F.concat(silence(before), s, silence(F.greatest(F.lit(0), after).cast("int")))


def add(a: Column, b: Column, offset: int | Column = 0) -> Column:
    """b added to a from an offset in samples; what is missing is zero."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    x = _padded(a, 0, offset + F.size(b) - F.size(a))
    y = _padded(b, offset, F.size(a) - offset - F.size(b))
    return F.zip_with(x, y, lambda p, q: p + q)


def crossfade(a: Column, b: Column, channels: int, rate: int, seconds: float) -> Column:
    """The end of a fades out under b, which fades in; the overlap is clipped to full scale."""

    def faded(a: Column, b: Column) -> Column:
        na, nb = n_frames(a, channels), n_frames(b, channels)
        k = F.least(F.lit(frames_of(seconds, rate)), na, nb)
        ratio = lambda t, one: F.when(k == 1, _d(one)).otherwise(t / (k - 1))
        out = by_frame(slice_frames(a, channels, na - k, k), channels, lambda x, t, c: x * ratio(k - t - 1, 0.0))
        into = by_frame(slice_frames(b, channels, 0, k), channels, lambda x, t, c: x * ratio(t, 1.0))
        both = F.zip_with(out, into, lambda p, q: _clamp(p + q, -1, 1))
        return F.concat(slice_frames(a, channels, 0, na - k), both, slice_frames(b, channels, k, nb - k))

    return let(a, lambda x: let(b, lambda y: faded(x, y)))


# ---- measures


def peak(s: Column) -> Column:
    return F.aggregate(s, _d(0), lambda a, x: F.greatest(a, F.abs(x)))


def rms(s: Column) -> Column:
    return F.when(F.size(s) > 0, F.sqrt(F.aggregate(s, _d(0), lambda a, x: a + x * x) / F.size(s))).otherwise(0.0)


def dc_offset(s: Column) -> Column:
    return F.when(F.size(s) > 0, F.aggregate(s, _d(0), lambda a, x: a + x) / F.size(s)).otherwise(0.0)


def zero_crossing_rate(s: Column, channels: int) -> Column:
    """The share of steps within a channel that change between below zero and not below."""
    n = F.size(s) - channels
    changed = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.lit(0), n)), F.slice(s, F.lit(channels + 1), F.greatest(F.lit(0), n)), lambda p, q: ((p < 0) != (q < 0)).cast("int"))
    return F.when(n > 0, F.aggregate(changed, F.lit(0), lambda a, x: a + x) / n).otherwise(0.0)


def clipped(s: Column, channels: int, frames: int = 2) -> Column:
    """Whether a channel holds full scale of one sign for that many frames on end."""
    runs = []
    for c in range(channels):
        own = _channel(s, channels, c)
        start = F.struct(F.lit(0).alias("up"), F.lit(0).alias("down"), F.lit(0).alias("most"))

        def step(a: Column, x: Column) -> Column:
            up, down = F.when(x >= 1, a["up"] + 1).otherwise(0), F.when(x <= -1, a["down"] + 1).otherwise(0)
            return F.struct(up.alias("up"), down.alias("down"), F.greatest(a["most"], up, down).alias("most"))

        runs.append(F.aggregate(own, start, step, lambda a: a["most"] >= frames))
    out = runs[0]
    for r in runs[1:]:
        out = out | r
    return out


# ---- rates


def resampled_frames(n: Column, source: int, target: int) -> Column:
    return F.round(n * float(target) / source).cast("int")


@bound
def resample_linear(s: Column, channels: int, source: int, target: int) -> Column:
    if source == target:
        return s
    n = n_frames(s, channels)
    count = resampled_frames(n, source, target)

    def frame(t: Column) -> Column:
        place = t * float(source) / target
        low = F.floor(place)
        high = F.least(low + 1, n - 1)
        return F.array(*[at(s, low * channels + c) + (at(s, high * channels + c) - at(s, low * channels + c)) * (place - low) for c in range(channels)])

    return F.when((n > 0) & (count > 0), F.flatten(F.transform(F.sequence(F.lit(0), count - 1), frame))).otherwise(F.array().cast("array<double>"))


@bound
def hold(s: Column, channels: int, factor: int) -> Column:
    """Each frame takes the samples of the last frame whose number the factor divides."""
    return by_frame(s, channels, lambda x, t, c: at(s, F.floor(t / factor) * factor * channels + c))


@bound
def bitcrush(s: Column, channels: int, bits: int = 8, downsample: int = 1, mix: float = 1.0) -> Column:
    steps = float(2**bits - 1)
    crushed = F.transform(s, lambda x: F.round((_clamp(x, -1, 1) + 1.0) / 2.0 * steps) / steps * 2.0 - 1.0)
    held = hold(crushed, channels, downsample) if downsample > 1 else crushed
    return F.zip_with(s, held, lambda d, w: d * (1.0 - mix) + w * mix)


# ---- modulation by closed forms


def tremolo(s: Column, channels: int, rate: int, hz: float = 5.0, depth: float = 0.5, mix: float = 1.0) -> Column:
    step = 2.0 * math.pi * hz / rate
    return by_frame(s, channels, lambda x, t, c: x * (1.0 - mix) + x * (1.0 - depth * ((F.sin(t * step) + 1.0) / 2.0)) * mix)


def auto_pan(s: Column, rate: int, hz: float = 0.5, depth: float = 1.0) -> Column:
    step = 2.0 * math.pi * hz / rate

    def f(x: Column, t: Column, c: Column) -> Column:
        angle = (F.sin(t * step) * depth + 1.0) * (math.pi / 4.0)
        return x * F.when(c == 0, F.cos(angle)).otherwise(F.sin(angle))

    return by_frame(s, 2, f)


@bound
def swept_delay(s: Column, channels: int, base: int, depth: float, turns: float, mix: float) -> Column:
    """Each channel delayed by base + depth x (sine + 1) / 2 samples; ``turns`` of the sine a frame."""

    def f(x: Column, t: Column, c: Column) -> Column:
        phase = 2.0 * math.pi * (t * turns + c / float(channels))
        delay = base + depth * ((F.sin(phase) + 1.0) / 2.0)
        whole = F.floor(delay)
        before = lambda k: F.when(t - whole - k >= 0, F.try_element_at(s, ((t - whole - k) * channels + c).cast("int") + 1)).otherwise(0.0)
        near = before(1)
        return x * (1.0 - mix) + (near + (before(2) - near) * (delay - whole)) * mix

    return by_frame(s, channels, f)


def chorus(s: Column, channels: int, rate: int, hz: float = 1.0, depth: float = 0.5, mix: float = 0.5) -> Column:
    return swept_delay(s, channels, max(frames_of(0.012, rate), 1), rate * 0.03 * depth * 0.6, hz / rate, mix)


def vibrato(s: Column, channels: int, rate: int, hz: float = 5.0, depth: float = 0.5, mix: float = 1.0) -> Column:
    return swept_delay(s, channels, max(frames_of(0.006, rate), 1), rate * 0.004 * depth, hz / rate, mix)


# ---- control signals


def lfo(t: Column, rate: int, hz: float, waveform: str = "sine", phase: float = 0.0) -> Column:
    p = F.pmod(phase + t * (hz / rate), _d(1))
    waves = {"sine": F.sin(2.0 * math.pi * p), "triangle": 1.0 - 4.0 * F.abs(p - 0.5), "square": F.when(p < 0.5, 1.0).otherwise(-1.0), "sawtooth": 2.0 * p - 1.0}
    if waveform not in waves:
        raise InvalidParameter(f"no such waveform: {waveform}")
    return waves[waveform]


def envelope(time: Column, note_on: Column | float, attack: float, decay: float, sustain: float, release: float, hold_: float = 0.0, curve: str = "linear") -> Column:
    """Attack, hold, decay, sustain; from ``note_on`` the release, from the level reached there."""
    note_on = note_on if isinstance(note_on, Column) else _d(note_on)
    shape = lambda x: _curve(_clamp(x, 0, 1), curve)

    def held(t: Column) -> Column:
        rise = shape(t / attack) if attack else _d(1)
        fall = 1.0 - (1.0 - sustain) * shape((t - attack - hold_) / decay) if decay else _d(sustain)
        return F.when(t < attack, rise).when(t < attack + hold_, 1.0).when(t < attack + hold_ + decay, fall).otherwise(float(sustain))

    after = held(note_on) * (1.0 - shape((time - note_on) / release)) if release else _d(0)
    return F.when(time < note_on, held(time)).otherwise(after)


def render_with_tail(s: Column, channels: int, rate: int, note_on: float, **shape) -> Column:
    """The clip under an envelope, its last frame repeated until the release has ended; an empty clip stays empty."""
    end = math.ceil(round((note_on + shape.get("release", 0.0)) * rate, 9))

    def f(v: Column) -> Column:
        n = n_frames(v, channels)
        last = F.slice(v, F.greatest(F.lit(1), (n - 1) * channels + 1), F.lit(channels))
        whole = F.when(n > 0, F.concat(v, F.flatten(F.array_repeat(last, F.greatest(F.lit(0), F.lit(end) - n))))).otherwise(v)
        return by_frame(whole, channels, lambda x, t, c: x * envelope(t / float(rate), note_on, **shape))

    return let(s, f)


def map_samples(s: Column, f: Callable[[Column], Column]) -> Column:
    """f of each sample; a result that is null or isn't finite is an error that names the sample."""
    made = F.transform(s, f)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.transform(made, lambda x, i: F.when(finite(x), x).otherwise(F.raise_error(F.concat(F.lit("map_samples: not finite at sample "), i.cast("string"))).cast("double")))


def map_frames(s: Column, channels: int, f: Callable[[Column], Column]) -> Column:
    """f of each frame, an array of its channels, which must give as many finite values."""
    made = F.transform(frame_arrays(s, channels), f)
    good = lambda p: (F.size(p) == channels) & F.forall(p, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.flatten(F.transform(made, lambda p, t: F.when(good(p), p).otherwise(F.raise_error(F.concat(F.lit("map_frames: wrong values at frame "), t.cast("string"))).cast("array<double>"))))


def automation(time: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Straight lines between points; constant outside; at a repeated time the right value begins."""
    if not points:
        raise InvalidParameter("automation needs a point")
    ps = sorted(((float(t), float(v)) for t, v in points), key=lambda p: p[0])
    out = F.when(time <= ps[0][0], _d(ps[0][1])).when(time >= ps[-1][0], _d(ps[-1][1]))
    for (a, x), (b, y) in zip(ps, ps[1:], strict=False):
        out = out.when(time <= b, _d(y) if a == b else x + (y - x) * ((time - a) / (b - a)))
    return out


# ---- oscillators

# Table sizes and the highest harmonic of the triangle.
SINE_TABLE, TRIANGLE_TABLE, TRIANGLE_HARMONIC = 2048, 2048, 255


def _blep(p: Column, step: Column | float) -> Column:
    """The correction that rounds a step's corner within one frame of it."""
    a, b = p / step, (p - 1.0) / step
    return F.when(p < step, a + a - a * a - 1.0).when(p > 1.0 - step, b * b + b + b + 1.0).otherwise(0.0)


def oscillator(t: Column, rate: int, waveform: str, hz: float | Column, level: float = 1.0, phase: float = 0.0, width: float = 0.5, detune: float = 0.0, unison: int = 1) -> Column:
    """A periodic waveform's value at frame ``t``: the mean of its voices, which lie ``detune`` cents apart. The frequency may be a column."""
    voices = [hz] if unison == 1 or detune == 0 else [hz * 2.0 ** ((v - (unison - 1) / 2.0) * detune / 1200.0) for v in range(unison)]
    if not isinstance(hz, Column) and max(voices) > rate / 2.0:
        raise InvalidParameter("the frequency is above half the rate")

    def one(f: float | Column) -> Column:
        step = F.least(_d(0.5), f / rate) if isinstance(f, Column) else min(0.5, f / rate)
        p = F.pmod(phase % 1.0 + t * (f / rate), _d(1))
        if waveform == "sine":
            # Between entries of a sine table of SINE_TABLE points, on a straight line.
            place = p * float(SINE_TABLE)
            low = F.floor(place)
            sine = lambda k: F.sin(2.0 * math.pi * k / SINE_TABLE)
            return sine(low) + (sine(low + 1) - sine(low)) * (place - low)
        if waveform == "sawtooth":
            return 2.0 * p - 1.0 - _blep(p, step)
        if waveform in ("square", "pulse"):
            w = 0.5 if waveform == "square" else width
            return F.when(p < w, 1.0).otherwise(-1.0) + _blep(p, step) - _blep(F.pmod(p - w, _d(1)), step)
        if waveform == "triangle":
            top = F.least(F.floor((rate / 2.0) / f).cast("int"), F.lit(TRIANGLE_HARMONIC)) if isinstance(f, Column) else F.lit(min(int((rate / 2.0) / f), TRIANGLE_HARMONIC))
            odd = F.sequence(F.lit(1), top, F.lit(2))
            wave = lambda k: F.aggregate(odd, _d(0), lambda a, h: a + F.cos(2.0 * math.pi * h * (k / float(TRIANGLE_TABLE))) / (h * h)) * (8.0 / math.pi**2)
            place = p * float(TRIANGLE_TABLE)
            low = F.floor(place)
            return wave(low) + (wave(low + 1) - wave(low)) * (place - low)
        raise InvalidParameter(f"no such waveform: {waveform}")

    raw = sum((one(f) for f in voices[1:]), one(voices[0])) / float(len(voices))
    return raw * level if waveform == "sine" else _clamp(raw * level, -1, 1)


def white_noise(t: Column, channel: Column, seed: int, level: float = 1.0) -> Column:
    """Even noise of a hash, so every frame is known without those before it."""
    return (F.pmod(F.xxhash64(F.lit(seed), t, channel), F.lit(2**53)) / float(2**52) - 1.0) * level
