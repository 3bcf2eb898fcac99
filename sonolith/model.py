"""Formats, durations, errors and schemas.

A set of clips is a DataFrame with one row a clip (clip_id, samples): ``samples`` is an array of
doubles, frames after each other, a frame's channels side by side. One Format holds for the set, so
rates and channels are literals in every plan.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import types as T


class SonolithError(Exception):
    """The root of all errors that this library raises on purpose."""


class InvalidParameter(SonolithError, ValueError):
    pass


class InvalidFormat(SonolithError):
    pass


class UnsupportedFormat(SonolithError):
    pass


class StreamError(SonolithError):
    pass


class InvalidNotation(SonolithError, ValueError):
    pass


# Speaker positions by channel count, and what each format family allows.
LAYOUTS = {
    1: ("front_center",),
    2: ("front_left", "front_right"),
    3: ("front_left", "front_right", "front_center"),
    4: ("front_left", "front_right", "back_left", "back_right"),
    5: ("front_left", "front_right", "front_center", "back_left", "back_right"),
    6: ("front_left", "front_right", "front_center", "low_frequency", "side_left", "side_right"),
    7: ("front_left", "front_right", "front_center", "low_frequency", "back_center", "side_left", "side_right"),
    8: ("front_left", "front_right", "front_center", "low_frequency", "back_left", "back_right", "side_left", "side_right"),
}
PCM_DEPTHS, FLOAT_DEPTHS = (8, 16, 24, 32), (32, 64)


@dataclass(frozen=True)
class Format:
    channels: int
    sample_rate: int
    bit_depth: int = 32
    sample_format: str = "float"
    valid_bits: int | None = None
    channel_layout: tuple[str, ...] | None = None

    def __post_init__(self):
        if not 1 <= self.channels <= 32:
            raise InvalidFormat(f"channels must be 1 to 32: {self.channels}")
        if not 8_000 <= self.sample_rate <= 768_000:
            raise InvalidFormat(f"sample_rate must be 8000 to 768000: {self.sample_rate}")
        if self.sample_format not in ("pcm", "float") or self.bit_depth not in (PCM_DEPTHS if self.sample_format == "pcm" else FLOAT_DEPTHS):
            raise InvalidFormat(f"no such samples: {self.sample_format} {self.bit_depth}")
        if self.valid_bits is None:
            object.__setattr__(self, "valid_bits", self.bit_depth)
        if not 1 <= self.valid_bits <= self.bit_depth or (self.is_float and self.valid_bits != self.bit_depth):
            raise InvalidFormat(f"valid_bits don't fit the bit depth: {self.valid_bits}")
        if self.channel_layout is None:
            object.__setattr__(self, "channel_layout", LAYOUTS.get(self.channels))
        elif len(self.channel_layout) != self.channels or len(set(self.channel_layout)) != self.channels:
            raise InvalidFormat("channel_layout must name each channel once")

    @property
    def is_float(self) -> bool:
        return self.sample_format == "float"

    @property
    def bytes_per_sample(self) -> int:
        return self.bit_depth // 8

    @property
    def block_align(self) -> int:
        return self.channels * self.bytes_per_sample

    @property
    def byte_rate(self) -> int:
        return self.block_align * self.sample_rate

    def with_(self, **changes) -> Format:
        if "channels" in changes and "channel_layout" not in changes:
            changes["channel_layout"] = None
        if ("bit_depth" in changes or "sample_format" in changes) and "valid_bits" not in changes:
            changes["valid_bits"] = None
        return replace(self, **changes)

    def as_float(self) -> Format:
        return self.with_(sample_format="float", bit_depth=32)


CD_QUALITY = Format(2, 44_100, 16, "pcm")
DVD_QUALITY = Format(2, 96_000, 24, "pcm")
VOICE = Format(1, 16_000, 16, "pcm")

CLIPS = T.StructType([T.StructField("clip_id", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType(), False))])
CHUNKS = "clip_id long, seq long, start_frame long, n_frames int, is_last boolean, samples array<double>"
EVENTS = (
    "track string, kind string, bar int, step_index int, start_time double, duration double, start_frame long, duration_frames long, midi_notes array<int>, chord string, "
    "velocity double, probability double, ratchet_index int, ratchet_count int, marker string, section string"
)


def half_away(x: float) -> int:
    """Round to the nearest integer, halves away from zero."""
    return int(Decimal(x).quantize(Decimal(1), ROUND_HALF_UP))


def frames_of(seconds: float, rate: int) -> int:
    if not (isinstance(seconds, (int, float)) and 0 <= seconds < float("inf")):
        raise InvalidParameter(f"time must be finite and not negative: {seconds}")
    return half_away(seconds * rate)


def seconds(x: float) -> float:
    """A time in seconds, checked."""
    frames_of(x, 1)
    return float(x)


def milliseconds(x: float) -> float:
    return seconds(x / 1000.0)


def inside(folder: str, path: str) -> str:
    """The path within a folder; one that leads out of it is an error, links included."""
    root = os.path.realpath(folder)
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([root, full]) != root:
        raise InvalidParameter(f"{path} leads out of {folder}")
    return full


def parse_duration(text: str | float) -> float:
    """Seconds of ``SS(.s)``, ``MM:SS`` or ``HH:MM:SS``; below a higher part, minutes and seconds stay under 60."""
    if isinstance(text, (int, float)):
        return float(text)
    if not re.fullmatch(r"(\d+:){0,2}\d+(\.\d+)?", text.strip()):
        raise InvalidParameter(f"no duration: {text!r}")
    parts = [float(x) for x in text.strip().split(":")]
    if any(x >= 60 for x in parts[1:]):
        raise InvalidParameter(f"minutes and seconds must be below 60: {text!r}")
    total = 0.0
    for x in parts:
        total = total * 60 + x
    return total


def show_duration(seconds: float) -> str:
    ms = half_away(seconds * 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
