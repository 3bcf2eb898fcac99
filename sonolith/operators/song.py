"""Songs: tracks, an arrangement, and their sound as rows of frames.

Rendering is a range join turned round: each note explodes into the frames that it covers, every
frame's value is a closed form of its distance from the note's start, and frames add up by partial
aggregation. Only what has memory (effects, the master's limiter) needs a clip as one row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as A
from ..model import Format, InvalidParameter, SonolithError
from ..plans.planner import Clips
from . import kernels as K
from . import stateful as T
from .sequence import Clock, Section, Track, _steps, duration, events


def play(notes: DataFrame, track: Track, rate: int) -> DataFrame:
    """Of events with midi_notes: (frame, y), mono, all voices added up; a chord's voices share its level."""
    release = float(track.envelope.get("release", 0.0))
    voices = notes.select("start_frame", "duration", F.size("midi_notes").alias("n"), F.explode("midi_notes").alias("midi"))
    count = F.round((F.col("duration") + release) * rate).cast("long")
    frames = voices.where(count > 0).select("start_frame", "duration", "n", (440.0 * F.pow(F.lit(2.0), (F.col("midi") - 69) / 12.0)).alias("hz"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("t"))
    y = A.oscillator(F.col("t"), rate, track.waveform, F.col("hz"), track.level) / F.col("n")
    if track.envelope:
        y = y * A.envelope(F.col("t") / float(rate), F.col("duration"), **{("hold_" if k == "hold" else k): v for k, v in track.envelope.items()})
    return frames.select((F.col("start_frame") + F.col("t")).alias("frame"), y.alias("y")).groupBy("frame").agg(F.sum("y").alias("y"))


def placed(mono: DataFrame, track: Track) -> DataFrame:
    """(frame, l, r): gain and balance."""
    return levelled(mono.select("frame", F.col("y").alias("l"), F.col("y").alias("r")), track)


def levelled(frames: DataFrame, track: Track) -> DataFrame:
    down = math.cos(abs(track.pan) * math.pi / 2.0)
    k = A.amplitude(track.gain_db)
    left, right = (k * down if track.pan > 0 else k), (k * down if track.pan < 0 else k)
    return frames.select("frame", (F.col("l") * left).alias("l"), (F.col("r") * right).alias("r"))


def chance(events_: DataFrame, seed: int) -> DataFrame:
    """The triggers that sound: each by its probability, drawn from a hash of the seed and the event, so reruns agree. 0 never sounds, 1 always."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "track", "bar", "step_index", "ratchet_index"), F.lit(2**53)) / float(2**53)
    return events_.where((F.col("kind") == "trigger") & (draw < F.col("probability")))


def play_samples(triggers: DataFrame, samples: DataFrame, stereo: bool = False) -> DataFrame:
    """Of triggers and clips (track, samples): (frame, l, r), a track's clip at each of its triggers, scaled by its velocity.

    Triggers join their track's clip, one row a track; of several clips of a track all sound. A track without a clip is silent.
    """
    s = F.col("samples")
    frames = A.frame_arrays(s, 2) if stereo else F.transform(s, lambda x: F.array(x, x))
    sound = triggers.join(samples.select(F.col("track").alias("of"), "samples"), F.col("track") == F.col("of")).select("start_frame", "velocity", F.posexplode(frames).alias("t", "x"))
    return sound.groupBy((F.col("start_frame") + F.col("t")).alias("frame")).agg(F.sum(F.col("x")[0] * F.col("velocity")).alias("l"), F.sum(F.col("x")[1] * F.col("velocity")).alias("r"))


def prepared(clips: DataFrame, fmt: Format, options: dict, target: Format) -> DataFrame:
    """Clips (clip_id, samples) as a track plays them: cut, trimmed, reversed, pitched, in the target's format as floats, louder or softer, panned.

    ``start``, ``to`` and ``duration`` in seconds; ``trim``: a threshold; ``reverse``; ``pitch`` in semitones (or ``pitch_ratio``), which
    changes the length; ``gain`` in decibels; ``pan`` from -1 to 1.
    """
    if unknown := options.keys() - {"start", "to", "duration", "trim", "reverse", "pitch", "pitch_ratio", "gain", "pan"}:
        raise InvalidParameter(f"no such sample options: {sorted(unknown)}")
    if "to" in options and "duration" in options or "pitch" in options and "pitch_ratio" in options:
        raise InvalidParameter("to or duration, and pitch or pitch_ratio")
    c = Clips(clips, fmt)
    start = options.get("start", 0.0)
    end = options.get("to", start + options["duration"] if "duration" in options else None)
    if start or end is not None:
        c = c.slice(start, 3600.0 if end is None else end)
    if "trim" in options:
        c = c.trim(options["trim"])
    if options.get("reverse"):
        c = c.reverse()
    ratio = options.get("pitch_ratio", 2.0 ** (options.get("pitch", 0.0) / 12.0))
    if not ratio > 0:
        raise InvalidParameter("a pitch ratio is above 0")
    s = A.to_float(F.col("samples"), c.format)
    if ratio != 1:
        # Played faster or slower: the frames are those of another rate.
        s = A.resample_linear(s, c.format.channels, round(c.format.sample_rate * ratio), c.format.sample_rate)
    mid = c.format.as_float()
    c = Clips(c.df().withColumn("samples", s), mid).convert(target.as_float().with_(channels=mid.channels))
    if options.get("gain"):
        c = c.gain(options["gain"])
    if mid.channels == 1 and target.channels == 2:
        c = c.pan(options.get("pan", 0.0)) if options.get("pan") else c.to_stereo()
    elif options.get("pan") and target.channels == 2:
        c = c.to_stereo().balance(options["pan"])
    return c.convert(target.as_float()).df()


def with_effects(frames: DataFrame, length: int, fmt: Format, effects: Sequence) -> DataFrame:
    """(frame, l, r) through a chain of effects (names, or names with options), tail included."""
    chain = [(e, {}) if isinstance(e, str) else (e[0], dict(e[1])) for e in effects]
    clip = as_clip(frames, length).withColumn("samples", T.apply(F.col("samples"), fmt, lambda: [K.build(name, **options) for name, options in chain]))
    return clip.select(F.posexplode(A.frame_arrays(F.col("samples"), 2)).alias("frame", "x")).select(F.col("frame").cast("long").alias("frame"), F.col("x")[0].alias("l"), F.col("x")[1].alias("r"))


def as_clip(frames: DataFrame, length: int) -> DataFrame:
    """(frame, l, r) as one stereo clip; frames without a row are silent."""
    every = frames.sparkSession.range(length).withColumnRenamed("id", "frame").join(frames, "frame", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("frame", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("r", F.lit(0.0)).alias("r")))).alias("f"))
    return rows.select(F.lit(0).cast("long").alias("clip_id"), F.flatten(F.transform("f", lambda p: F.array(p["l"], p["r"]))).alias("samples"))


@dataclass
class Song:
    """A declarative song; nothing in it is executed code."""

    tracks: list[Track] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)
    bars: int = 1
    clock: Clock = field(default_factory=Clock)
    format: Format = field(default_factory=lambda: Format(2, 44_100))

    @classmethod
    def from_json(cls, text: str) -> Song:
        spec = json.loads(text)
        clock = Clock(**{k: spec[k] for k in ("tempo", "beats_per_bar", "swing") if k in spec})
        sections = [Section(**(s | {"tracks": tuple(s["tracks"]), "markers": tuple(map(tuple, s.get("markers", ())))})) for s in spec.get("sections", [])]
        return cls([Track(**t) for t in spec["tracks"]], sections, spec.get("bars", 1), clock, Format(2, spec.get("sample_rate", 44_100)))

    def _what(self) -> int | Sequence[Section]:
        return self.sections or self.bars

    @staticmethod
    def _order() -> list[Column]:
        return [F.col("start_time"), F.col("track"), F.col("kind"), F.col("step_index"), F.col("ratchet_index")]

    def validate(self) -> list[str]:
        """What is wrong with the song, in words; nothing if it can be rendered."""
        found, names = [], [t.name for t in self.tracks]
        found += [f"two tracks are named {n}" for n in sorted({n for n in names if names.count(n) > 1})]
        found += [f"track {t.name} plays nothing" for t in self.tracks if not (t.pattern or t.notes or t.chords)]
        for s in self.sections:
            found += [f"section {s.name} names no track {n}" for n in s.tracks if n not in names]
        for t in self.tracks:
            try:
                _steps(t, self.clock)
                for e in t.effects:
                    K.build(e) if isinstance(e, str) else K.build(e[0], **dict(e[1]))
            except SonolithError as e:
                found.append(f"track {t.name}: {e}")
        return found

    def timeline(self, spark: SparkSession) -> DataFrame:
        """The events; a table has no order: timeline_text and timeline_json are sorted by time."""
        return events(spark, self.tracks, self._what(), self.clock, self.format.sample_rate)

    def timeline_json(self, spark: SparkSession) -> DataFrame:
        t = self.timeline(spark).orderBy(*self._order())
        return t.select(F.to_json(F.struct(*t.columns)).alias("event"))

    def timeline_text(self, spark: SparkSession) -> DataFrame:
        """(line): an event a line in the order of time: when, the track, what."""
        t = self.timeline(spark).orderBy(*self._order())
        what = F.coalesce(F.col("marker"), F.col("chord"), F.concat_ws(",", F.col("midi_notes").cast("array<string>")))
        return t.select(F.concat_ws(" ", F.format_string("%9.3fs", "start_time"), F.format_string("%7.3fs", "duration"), "track", "kind", F.when(what != "", what), F.when(F.col("velocity").isNotNull(), F.format_string("v=%.2f", "velocity"))).alias("line"))

    def duration(self) -> float:
        return duration(self._what(), self.clock)

    def stems(self, spark: SparkSession, samples: dict[str, tuple[DataFrame, Format]] | None = None, seed: int = 0) -> dict[str, DataFrame]:
        """(frame, l, r) of each track that has notes or chords, or triggers and a clip.

        ``samples``: for a track's name its clip, a set of one clip (clip_id, samples), and its format.
        """
        timeline, out = self.timeline(spark), {}
        for t in self.tracks:
            parts = []
            if t.notes or t.chords:
                own = timeline.where((F.col("track") == t.name) & F.col("kind").isin("note", "chord"))
                parts.append(placed(play(own, t, self.format.sample_rate), t))
            if t.pattern and t.name in (samples or {}):
                clip, fmt = samples[t.name]
                made = prepared(clip, fmt, t.sample, Format(2, self.format.sample_rate))
                heard = chance(timeline.where(F.col("track") == t.name), seed)
                parts.append(levelled(play_samples(heard, made.select(F.lit(t.name).alias("track"), "samples"), stereo=True), t))
            if parts:
                out[t.name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("frame").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
                if t.effects:
                    out[t.name] = with_effects(out[t.name], max(1, round(self.duration() * self.format.sample_rate)), self.format, t.effects)
        return out

    def write_stems(self, spark: SparkSession, path: str) -> None:
        """Stems as Parquet, a folder a track."""
        for name, stem in self.stems(spark).items():
            stem.withColumn("track", F.lit(name)).write.mode("append").partitionBy("track").parquet(path)

    def frames(self, spark: SparkSession, samples: dict[str, tuple[DataFrame, Format]] | None = None, seed: int = 0) -> DataFrame:
        """(frame, l, r): all stems added up."""
        stems = list(self.stems(spark, samples, seed).values())
        if not stems:
            return spark.createDataFrame([], "frame long, l double, r double")
        whole = stems[0]
        for s in stems[1:]:
            whole = whole.unionByName(s)
        return whole.groupBy("frame").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))

    def write(self, spark: SparkSession, folder: str, codec: str = "wav", bits: int = 16, name: str = "song", **more) -> None:
        """The rendered song as a file."""
        from ..sources import audio

        fmt = Format(2, self.format.sample_rate, bits, "pcm")
        made = self.render(spark, **more).select(F.lit(name).alias("clip_id"), A.from_float(F.col("samples"), fmt).alias("samples"))
        audio.write(made, folder, fmt, codec, overwrite=True)

    def render(self, spark: SparkSession, samples: dict[str, tuple[DataFrame, Format]] | None = None, seed: int = 0) -> DataFrame:
        """One stereo clip; the limiter holds it where it would pass full scale. A song is one row: its length is bounded by the caps on bars and events."""
        frames = self.frames(spark, samples, seed)
        length = (frames.agg(F.max("frame")).first()[0] or 0) + 1
        clip = as_clip(frames, max(length, round(self.duration() * self.format.sample_rate)))
        s: Column = F.col("samples")
        held = T.limit(s, self.format, ceiling=-0.1, attack=0.005, lookahead=0.005)
        return clip.withColumn("samples", F.when(A.peak(s) <= 1.0, s).otherwise(held))


def lofi_drums() -> list[Track]:
    # The preset's patterns.
    return [Track("kick", pattern="x---x---x---x---"), Track("snare", pattern="----x-------x---"), Track("hat", pattern="x-x-x-x-x-x-x-x-")]
