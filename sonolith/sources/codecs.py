"""Sound files as bytes: WAV, AIFF, FLAC and raw samples. Pure functions, for use within Spark tasks.

Decoding gives a Sound: its format, and an array (frames, channels) of codes (PCM) or values (float).
Broken input raises an error of this library, and no other.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..model import Format, InvalidFormat, SonolithError, UnsupportedFormat


@dataclass
class Sound:
    format: Format
    samples: np.ndarray
    tags: dict[str, str] = field(default_factory=dict)
    extra: dict[str, str] = field(default_factory=dict)
    frames: int = 0

    def __post_init__(self):
        self.frames = self.frames or len(self.samples)


# ---- plain samples


def unpack(raw: bytes, fmt: Format, big: bool = False, signed: bool = True) -> np.ndarray:
    """Codes or values of whole frames."""
    if len(raw) % fmt.block_align:
        raise InvalidFormat("the samples end within a frame")
    order, width = ">" if big else "<", fmt.bytes_per_sample
    if fmt.is_float:
        x = np.frombuffer(raw, f"{order}f{width}").astype(np.float64)
        if not np.isfinite(x).all():
            raise InvalidFormat("a sample isn't finite")
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        hi, mid, lo = (b[:, 0], b[:, 1], b[:, 2]) if big else (b[:, 2], b[:, 1], b[:, 0])
        x = hi << 16 | mid << 8 | lo
        x = (x - ((x >> 23) << 24)) if signed else x - 2**23
    else:
        x = np.frombuffer(raw, f"{order}{'i' if signed else 'u'}{width}").astype(np.int64)
        x = x if signed else x - 2 ** (fmt.bit_depth - 1)
    if not fmt.is_float and fmt.valid_bits < fmt.bit_depth:
        shift = fmt.bit_depth - fmt.valid_bits
        x = x >> shift << shift
    return x.astype(np.float64).reshape(-1, fmt.channels)


def pack(x: np.ndarray, fmt: Format, big: bool = False, signed: bool = True, clamp: bool = True) -> bytes:
    order, width, flat = ">" if big else "<", fmt.bytes_per_sample, np.asarray(x, np.float64).ravel()
    if fmt.is_float:
        return (np.clip(flat, -1, 1) if clamp else flat).astype(f"{order}f{width}").tobytes()
    codes = np.clip(flat, -(2 ** (fmt.bit_depth - 1)), 2 ** (fmt.bit_depth - 1) - 1).astype(np.int64) + (0 if signed else 2 ** (fmt.bit_depth - 1))
    if width == 3:
        b = np.stack([codes & 255, codes >> 8 & 255, codes >> 16 & 255], axis=1).astype(np.uint8)
        return (b[:, ::-1] if big else b).tobytes()
    return codes.astype(f"{order}{'i' if signed else 'u'}{width}").tobytes()


def raw_decode(data: bytes, fmt: Format, endianness: str = "little", signed: bool | None = None) -> Sound:
    return Sound(fmt, unpack(data, fmt, endianness == "big", fmt.bit_depth != 8 if signed is None else signed))


def raw_encode(sound: Sound, endianness: str = "little", signed: bool | None = None, float_domain: str = "normalized") -> bytes:
    return pack(sound.samples, sound.format, endianness == "big", sound.format.bit_depth != 8 if signed is None else signed, float_domain != "ieee")


# ---- WAV

# Chunk layouts, the tail that all sub-format ids share, tag names, speaker bits.
GUID = bytes.fromhex("000000001000800000AA00389B71")
INFO = {"INAM": "title", "IART": "artist", "IPRD": "album", "ICMT": "comment", "ICRD": "date", "IGNR": "genre", "ITRK": "track", "ISFT": "software"}
SPEAKERS = (
    "front_left", "front_right", "front_center", "low_frequency", "back_left", "back_right", "front_left_of_center", "front_right_of_center", "back_center", "side_left", "side_right", "top_center",
    "top_front_left", "top_front_center", "top_front_right", "top_back_left", "top_back_center", "top_back_right",
)


def _chunks(data: bytes, at: int, end: int, big: bool, sizes: dict[bytes, int] | None = None):
    """(id, start, size); a chunk that doesn't fit is an error."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big" if big else "little")
        if sizes and size == 0xFFFFFFFF:
            size = sizes.get(name, size)
        if at + 8 + size > end:
            raise InvalidFormat(f"chunk {name!r} is cut short")
        yield name, at + 8, size
        at += 8 + size + size % 2


def _wav_format(data: bytes, at: int, size: int) -> tuple[Format, list[str]]:
    if size < 16:
        raise InvalidFormat("the fmt chunk is too short")
    tag, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", data, at)
    valid, layout, warnings = bits, None, []
    if tag == 0xFFFE:
        if size < 40:
            raise InvalidFormat("the extensible fmt chunk is too short")
        valid, mask = struct.unpack_from("<HI", data, at + 18)
        tag, tail = struct.unpack_from("<H", data, at + 24)[0], data[at + 26 : at + 40]
        if tail != GUID:
            raise UnsupportedFormat("unknown sub-format")
        named = tuple(s for i, s in enumerate(SPEAKERS) if mask >> i & 1)
        layout = named if len(named) == channels else None
        valid = valid or bits
    if tag not in (1, 3):
        raise UnsupportedFormat(f"WAV format tag {tag}")
    fmt = Format(channels, rate, bits, "float" if tag == 3 else "pcm", valid, layout)
    if align != fmt.block_align:
        raise InvalidFormat("block_align doesn't fit")
    if byte_rate != fmt.byte_rate:
        warnings.append("byte_rate doesn't fit")
    return fmt, warnings


def wav_decode(data: bytes, header_only: bool = False) -> Sound:
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise InvalidFormat("no RIFF or RF64 WAVE header")
    sizes: dict[bytes, int] = {}
    if data[:4] == b"RF64":
        if data[12:16] != b"ds64" or len(data) < 48:
            raise InvalidFormat("RF64 without ds64")
        sizes[b"data"] = struct.unpack_from("<Q", data, 28)[0]
    fmt, place, tags, extra = None, None, {}, {}
    for name, at, size in _chunks(data, 12, len(data), False, sizes):
        if name == b"fmt ":
            if fmt:
                raise InvalidFormat("two fmt chunks")
            fmt, warnings = _wav_format(data, at, size)
            if warnings:
                extra["warnings"] = "; ".join(warnings)
        elif name == b"data":
            if place:
                raise InvalidFormat("two data chunks")
            place = (at, size)
        elif name == b"fact" and size >= 4:
            extra["fact_frames"] = str(struct.unpack_from("<I", data, at)[0])
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            for key, a, n in _chunks(data, at + 4, at + size, False):
                if key.decode("latin-1") in INFO:
                    tags[INFO[key.decode("latin-1")]] = data[a : a + n].split(b"\0")[0].decode("utf-8", "replace")
        elif name == b"smpl" and size >= 36:
            unity, loops = struct.unpack_from("<I", data, at + 12)[0], struct.unpack_from("<I", data, at + 28)[0]
            if size < 36 + 24 * loops:
                raise InvalidFormat("the smpl chunk is cut short")
            extra["smpl_unity_note"] = str(unity)
            for i in range(loops):
                kind, start, end = struct.unpack_from("<III", data, at + 36 + 24 * i + 4)
                extra[f"loop_{i}"] = f"{kind},{start},{end}"
        elif name == b"cue " and size >= 4:
            count = struct.unpack_from("<I", data, at)[0]
            if size < 4 + 24 * count:
                raise InvalidFormat("the cue chunk is cut short")
            for i in range(count):
                ident, position = struct.unpack_from("<II", data, at + 4 + 24 * i)
                extra[f"cue_{ident}"] = str(position)
        elif name == b"bext":
            if size < 602:
                raise InvalidFormat("the bext chunk is too short")
            text = lambda a, n: data[at + a : at + a + n].split(b"\0")[0].decode("utf-8", "replace")  # noqa: B023, E731
            extra |= {"description": text(0, 256), "originator": text(256, 32), "origination_date": text(320, 10), "origination_time": text(330, 8), "time_reference": str(struct.unpack_from("<Q", data, at + 338)[0])}
    if fmt is None or place is None:
        raise InvalidFormat("fmt or data is missing")
    at, size = place
    if size % fmt.block_align:
        raise InvalidFormat("the data end within a frame")
    frames = size // fmt.block_align
    x = np.zeros((0, fmt.channels)) if header_only else unpack(data[at : at + size], fmt, signed=fmt.bit_depth != 8)
    return Sound(fmt, x, tags, extra, frames)


def wav_encode(sound: Sound) -> bytes:
    fmt, body = sound.format, pack(sound.samples, sound.format, signed=sound.format.bit_depth != 8)
    tag = 3 if fmt.is_float else 1
    base = struct.pack("<HHIIHH", tag, fmt.channels, fmt.sample_rate, fmt.byte_rate, fmt.block_align, fmt.bit_depth)
    usual = Format(fmt.channels, fmt.sample_rate).channel_layout
    if fmt.channels > 2 or fmt.bit_depth > 16 and not fmt.is_float or fmt.valid_bits != fmt.bit_depth or fmt.channel_layout != usual:
        mask = sum(1 << SPEAKERS.index(s) for s in fmt.channel_layout or () if s in SPEAKERS)
        base = struct.pack("<H", 0xFFFE) + base[2:] + struct.pack("<HHIH", 22, fmt.valid_bits, mask, tag) + GUID
    chunk = lambda name, b: name + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    out = chunk(b"fmt ", base)
    if fmt.is_float:
        out += chunk(b"fact", struct.pack("<I", len(sound.samples)))
    names = {v: k for k, v in INFO.items()}
    info = b"".join(chunk(names[k].encode(), v.encode() + b"\0") for k, v in sound.tags.items() if k in names)
    if info:
        out += chunk(b"LIST", b"INFO" + info)
    out += chunk(b"data", body)
    if len(out) + 4 >= 2**32:
        raise UnsupportedFormat("a WAV file of 4 GB or more")
    return b"RIFF" + struct.pack("<I", len(out) + 4) + b"WAVE" + out


# ---- AIFF


def _extended(rate: int) -> bytes:
    """A whole number as an 80-bit float."""
    e = rate.bit_length() - 1
    return struct.pack(">HQ", 16383 + e, rate << (63 - e))


def aiff_decode(data: bytes, header_only: bool = False) -> Sound:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise InvalidFormat("no FORM AIFF header")
    packed, fmt, frames, place, big, extra = data[8:12] == b"AIFC", None, 0, None, True, {}
    for name, at, size in _chunks(data, 12, len(data), True):
        if name == b"COMM":
            if fmt or size < (22 if packed else 18):
                raise InvalidFormat("COMM is repeated or too short")
            channels, frames, bits = struct.unpack_from(">hIh", data, at)
            e, m = struct.unpack_from(">HQ", data, at + 8)
            rate = m * 2.0 ** ((e & 0x7FFF) - 16383 - 63)
            if not 1 <= rate <= 1e6:
                raise InvalidFormat("no such sample rate")
            if packed and data[at + 18 : at + 22] not in (b"NONE", b"sowt"):
                raise UnsupportedFormat(f"AIFC compression {data[at + 18 : at + 22]!r}")
            big = not (packed and data[at + 18 : at + 22] == b"sowt")
            depth = math.ceil(bits / 8) * 8
            fmt = Format(channels, int(rate + 0.5), depth, "pcm", bits)
        elif name == b"SSND":
            if place or size < 8:
                raise InvalidFormat("SSND is repeated or too short")
            place = (at + 8 + struct.unpack_from(">I", data, at)[0], at + size)
        elif name == b"MARK" and size >= 2:
            p = at + 2
            for _ in range(struct.unpack_from(">H", data, at)[0]):
                if p + 7 > at + size:
                    raise InvalidFormat("MARK is cut short")
                ident, position, n = struct.unpack_from(">HIB", data, p)
                extra[f"marker_{ident}"] = str(position)
                p += 7 + n + (n + 1) % 2
        elif name == b"INST" and size >= 20:
            extra["base_note"] = str(data[at])
    if fmt is None or (place is None and frames):
        raise InvalidFormat("COMM or SSND is missing")
    a, z = place or (0, 0)
    if frames * fmt.block_align != z - a:
        raise InvalidFormat("COMM and SSND disagree about the frames")
    x = np.zeros((0, fmt.channels)) if header_only else unpack(data[a:z], fmt, big)
    return Sound(fmt, x, {}, extra, frames)


def aiff_encode(sound: Sound) -> bytes:
    fmt = sound.format
    if fmt.is_float:
        raise UnsupportedFormat("AIFF holds PCM only")
    chunk = lambda name, b: name + struct.pack(">I", len(b)) + b + b"\0" * (len(b) % 2)
    out = chunk(b"COMM", struct.pack(">hIh", fmt.channels, len(sound.samples), fmt.valid_bits) + _extended(fmt.sample_rate)) + chunk(b"SSND", bytes(8) + pack(sound.samples, fmt, True))
    return b"FORM" + struct.pack(">I", len(out) + 4) + b"AIFF" + out


# ---- FLAC


def _crc(data: bytes, poly: int, bits: int) -> int:
    """Remainders of the polynomial, by a table of the 256 bytes that the rule gives."""
    key = (poly, bits)
    if key not in _CRC:
        table = []
        for b in range(256):
            c = b << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ poly) if c >> (bits - 1) & 1 else c << 1
            table.append(c & ((1 << bits) - 1))
        _CRC[key] = table
    table, c, mask = _CRC[key], 0, (1 << bits) - 1
    for b in data:
        c = (c << 8 & mask) ^ table[(c >> (bits - 8)) ^ b]
    return c


_CRC: dict[tuple[int, int], list[int]] = {}


class _Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.bits = data, np.unpackbits(np.frombuffer(data, np.uint8)[at:])
        self.ones, self.at, self.base = np.flatnonzero(self.bits), 0, at

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise InvalidFormat("the stream ends early")
        first, last = self.base + self.at // 8, self.base + (self.at + n + 7) // 8
        word = int.from_bytes(self.data[first:last], "big") >> (-(self.at + n) % 8)
        self.at += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        i = np.searchsorted(self.ones, self.at)
        if i == len(self.ones):
            raise InvalidFormat("the stream ends early")
        n = int(self.ones[i]) - self.at
        self.at += n + 1
        return n

    def byte(self) -> int:
        return self.base + (self.at + 7) // 8


# The weights of the fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _residual(b: _Bits, n: int, order: int) -> list[int]:
    method = b.take(2)
    if method > 1:
        raise InvalidFormat("unknown residual coding")
    wide, parts = (5 if method else 4), b.take(4)
    if n % (1 << parts) or n >> parts < order:
        raise InvalidFormat("the partitions don't fit the block")
    out: list[int] = []
    for p in range(1 << parts):
        count = (n >> parts) - (order if p == 0 else 0)
        k = b.take(wide)
        if k == (1 << wide) - 1:
            size = b.take(5)
            out += [b.signed(size) for _ in range(count)]
        else:
            for _ in range(count):
                v = b.unary() << k | b.take(k)
                out.append(v >> 1 ^ -(v & 1))
    return out


def _subframe(b: _Bits, n: int, bits: int) -> np.ndarray:
    if b.take(1):
        raise InvalidFormat("a subframe begins wrongly")
    kind, waste = b.take(6), 0
    if b.take(1):
        waste = b.unary() + 1
        bits -= waste
    if bits < 1:
        raise InvalidFormat("no bits are left")
    if kind == 0:
        x = np.full(n, b.signed(bits), np.int64)
    elif kind == 1:
        x = np.array([b.signed(bits) for _ in range(n)], np.int64)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > n:
            raise InvalidFormat("the order is above the block size")
        y = [b.signed(bits) for _ in range(order)]
        shift, weights = 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            if precision == 16 or shift < 0:
                raise InvalidFormat("no such predictor")
            weights = tuple(b.signed(precision) for _ in range(order))
        for r in _residual(b, n, order):
            y.append(r + (sum(w * y[-1 - j] for j, w in enumerate(weights)) >> shift))
        x = np.array(y, np.int64)
    else:
        raise InvalidFormat("a reserved subframe")
    return x << waste


def _utf8_number(b: _Bits) -> int:
    first = b.take(8)
    more = 0
    while first >> (7 - more) & 1:
        more += 1
    if more in (1,) or more > 7:
        raise InvalidFormat("a frame's number is broken")
    v = first & (0x7F >> more)
    for _ in range(max(0, more - 1)):
        c = b.take(8)
        if c >> 6 != 2:
            raise InvalidFormat("a frame's number is broken")
        v = v << 6 | c & 63
    return v


def _flac_frame(data: bytes, at: int, fmt: Format, longest: int) -> tuple[np.ndarray, int]:
    b = _Bits(data[at : at + longest], 0)
    if b.take(14) != 0x3FFE or b.take(1):
        raise InvalidFormat("a frame begins wrongly")
    if b.take(1):
        raise UnsupportedFormat("blocks of variable size")
    size, rate, layout, depth = b.take(4), b.take(4), b.take(4), b.take(3)
    if b.take(1):
        raise InvalidFormat("a reserved bit is set")
    _utf8_number(b)
    if size == 0 or rate == 15 or layout > 10 or depth in (3,):
        raise InvalidFormat("a frame header has a reserved value")
    n = 192 if size == 1 else 576 << (size - 2) if size <= 5 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << (size - 8)
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = b.byte()
    if _crc(data[at : at + head], 0x07, 8) != b.take(8):
        raise InvalidFormat("a frame header's checksum is wrong")
    bits = fmt.valid_bits if depth == 0 else {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    channels = layout + 1 if layout < 8 else 2
    if channels != fmt.channels or bits != fmt.valid_bits:
        raise InvalidFormat("a frame differs from the stream")
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    x = [_subframe(b, n, bits + (c == side)) for c in range(channels)]
    if layout == 8:
        x[1] = x[0] - x[1]
    elif layout == 9:
        x[0] = x[0] + x[1]
    elif layout == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    end = at + b.byte()
    if end + 2 > len(data) or _crc(data[at:end], 0x8005, 16) != int.from_bytes(data[end : end + 2], "big"):
        raise InvalidFormat("a frame's checksum is wrong")
    return np.stack(x, axis=1), end + 2


def flac_decode(data: bytes, header_only: bool = False) -> Sound:
    if data[:4] != b"fLaC":
        raise InvalidFormat("no fLaC header")
    at, last, fmt, total, digest, tags, extra = 4, False, None, 0, b"", {}, {}
    while not last:
        if at + 4 > len(data):
            raise InvalidFormat("the metadata are cut short")
        last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise InvalidFormat("the metadata are cut short")
        at += 4 + size
        if kind == 0:
            if fmt or size != 34:
                raise InvalidFormat("STREAMINFO is repeated or has a wrong size")
            word = int.from_bytes(body[10:18], "big")
            rate, channels, bits, total = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
            fmt, digest = Format(channels, rate, math.ceil(bits / 8) * 8, "pcm", bits), body[18:]
            extra |= {"min_block": str(int.from_bytes(body[:2], "big")), "max_block": str(int.from_bytes(body[2:4], "big"))}
        elif kind == 4 and size >= 8:
            p = 4 + int.from_bytes(body[:4], "little")
            count, p = int.from_bytes(body[p : p + 4], "little"), p + 4
            for _ in range(min(count, size)):
                n = int.from_bytes(body[p : p + 4], "little")
                key, _, value = body[p + 4 : p + 4 + n].decode("utf-8", "replace").partition("=")
                if p + 4 + n > size:
                    raise InvalidFormat("VORBIS_COMMENT is cut short")
                tags[key.lower()] = value
                p += 4 + n
        elif kind == 127 or fmt is None:
            raise InvalidFormat("the metadata don't begin with STREAMINFO")
    if fmt is None:
        raise InvalidFormat("STREAMINFO is missing")
    if header_only:
        return Sound(fmt, np.zeros((0, fmt.channels)), tags, extra, total)
    # No frame is longer than its samples as they are, by much.
    parts, longest = [], 65_536 * fmt.channels * 5 + 1024
    while at < len(data):
        x, at = _flac_frame(data, at, fmt, longest)
        parts.append(x)
    codes = np.concatenate(parts) if parts else np.zeros((0, fmt.channels), np.int64)
    if total and len(codes) != total:
        raise InvalidFormat("STREAMINFO tells another length")
    plain = Format(fmt.channels, fmt.sample_rate, fmt.bit_depth, "pcm")
    if digest != bytes(16) and hashlib.md5(pack(codes, plain)).digest() != digest:
        raise InvalidFormat("the samples' digest is wrong")
    return Sound(fmt, (codes << (fmt.bit_depth - fmt.valid_bits)).astype(np.float64), tags, extra)


def _put(v: int, n: int) -> np.ndarray:
    return np.array([v >> (n - 1 - i) & 1 for i in range(n)], np.uint8)


def _words(x: np.ndarray, n: int) -> np.ndarray:
    return (x[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).ravel()


def _rice(r: np.ndarray, k: int) -> np.ndarray:
    """Unary quotients and k-bit remainders of zig-zag numbers, all bits set at once."""
    z = (r << 1) ^ (r >> 63)
    ends = np.cumsum((z >> k) + 1 + k)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - k - 1] = 1
    for j in range(k):
        out[ends - k + j] = z >> (k - 1 - j) & 1
    return out


def _parameter(z: np.ndarray) -> int:
    """The number of plain bits that suits the mean of zig-zag numbers."""
    mean = float(z.mean()) if len(z) else 0.0
    return min(14, max(0, math.floor(math.log2(mean)))) if mean >= 1 else 0


def _coded(r: np.ndarray, n: int, order: int) -> np.ndarray:
    """Residuals in as many partitions as cost least; the costs are told from sums, and only the best is written."""
    z, best = (r << 1) ^ (r >> 63), None
    for parts in range(7):
        if n % (1 << parts) or n >> parts <= order:
            break
        size = n >> parts
        cuts = [0, *range(size - order, len(r) + 1, size)]
        ks = [_parameter(z[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        cost = sum(4 + int((z[a:b] >> k).sum()) + (b - a) * (k + 1) for (a, b), k in zip(zip(cuts, cuts[1:], strict=False), ks, strict=True))
        if best is not None and cost >= best[0]:
            break
        best = (cost, parts, cuts, ks)
    _, parts, cuts, ks = best
    bits = [_put(0, 2), _put(parts, 4)]
    for (a, b), k in zip(zip(cuts, cuts[1:], strict=False), ks, strict=True):
        bits += [_put(k, 4), _rice(r[a:b], k)]
    return np.concatenate(bits)


def _lpc(x: np.ndarray, bits: int, most: int = 8, precision: int = 14) -> list[np.ndarray]:
    """Subframes of predictors that Levinson and Durbin's recursion finds, of orders 2, 4 and 8."""
    n, out = len(x), []
    if n <= 32:
        return out
    w = x * np.hanning(n)
    auto = np.array([float(w[: n - i] @ w[i:]) for i in range(most + 1)])
    if auto[0] <= 0:
        return out
    a, err = np.zeros(0), auto[0]
    for i in range(1, most + 1):
        k = (auto[i] - a @ auto[i - 1 : 0 : -1] if i > 1 else auto[1]) / err
        a = np.append(a - k * a[::-1], k)
        err *= 1 - k * k
        if err <= 0:
            break
        if i not in (2, 4, 8):
            continue
        top = float(np.abs(a).max())
        if not 0 < top < 2**14:
            continue
        shift = min(15, max(0, precision - 1 - math.ceil(math.log2(top)) - 1))
        q = np.rint(a * 2**shift).astype(np.int64)
        if np.abs(q).max() >= 2 ** (precision - 1):
            continue
        guess = sum(int(q[j]) * x[i - 1 - j : n - 1 - j] for j in range(i)) >> shift
        r = x[i:] - guess
        if np.abs(r).max(initial=0) < 2**40:
            out.append(np.concatenate([_put(0, 1), _put(31 + i, 6), _put(0, 1), _words(x[:i], bits), _put(precision - 1, 4), _put(shift, 5), _words(q, precision), _coded(r, n, i)]))
    return out


def _shortest(x: np.ndarray, bits: int) -> np.ndarray:
    """The subframe of the fixed predictor with the least residuals, or a fitted one on longer blocks, or the samples as they are."""
    if (x == x[0]).all():
        return np.concatenate([_put(0, 8), _words(x[:1], bits)])
    steps = [np.diff(x, order) if order else x for order in range(min(4, len(x) - 1) + 1)]
    order = min(range(len(steps)), key=lambda o: int(np.abs(steps[o]).sum()))
    made = [np.concatenate([_put(0, 1), _put(8 + order, 6), _put(0, 1), _words(x[:order], bits), _coded(steps[order], len(x), order)])]
    if len(x) >= 256:
        made += _lpc(x, bits)
    best = min(made, key=len)
    return best if len(best) < 8 + len(x) * bits else np.concatenate([_put(2, 8), _words(x, bits)])


def _number(v: int) -> bytes:
    """A number in the extended form of UTF-8."""
    if v < 128:
        return bytes([v])
    n = next(k for k in range(2, 8) if v < 1 << (5 * k + 1))
    head = (0xFF << (8 - n) & 0xFF) | v >> 6 * (n - 1)
    return bytes([head]) + bytes(0x80 | v >> 6 * i & 63 for i in range(n - 2, -1, -1))


def flac_encode(sound: Sound, block: int = 4096, stereo: str = "auto") -> bytes:
    fmt = sound.format
    if fmt.is_float or fmt.channels > 8 or fmt.valid_bits > 24:
        raise UnsupportedFormat("FLAC is written from PCM of 8 channels and 24 bits at most")
    bits, codes = fmt.valid_bits, np.asarray(sound.samples).astype(np.int64) >> (fmt.bit_depth - fmt.valid_bits)
    depth, frames = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}.get(bits, 0), []
    for number, at in enumerate(range(0, len(codes), block)):
        x = codes[at : at + block]
        layout, subs = fmt.channels - 1, [_shortest(x[:, c], bits) for c in range(fmt.channels)]
        if fmt.channels == 2 and stereo != "independent":
            mid, side = x[:, 0] + x[:, 1] >> 1, x[:, 0] - x[:, 1]
            m, s = _shortest(mid, bits), _shortest(side, bits + 1)
            options = {1: subs, 8: [subs[0], s], 9: [s, subs[1]], 10: [m, s]}
            layout = 10 if stereo == "mid_side" else min(options, key=lambda k: sum(map(len, options[k])))  # noqa: B023
            subs = options[layout]
        head = bytes([0xFF, 0xF8, 0x70, layout << 4 | depth << 1]) + _number(number) + struct.pack(">H", len(x) - 1)
        body = np.concatenate(subs)
        frame = head + bytes([_crc(head, 0x07, 8)]) + np.packbits(body).tobytes()
        frames.append(frame + struct.pack(">H", _crc(frame, 0x8005, 16)))
    sizes = [len(f) for f in frames] or [0]
    digest = hashlib.md5(pack(codes, Format(fmt.channels, fmt.sample_rate, fmt.bit_depth, "pcm"))).digest()
    word = fmt.sample_rate << 44 | (fmt.channels - 1) << 41 | (bits - 1) << 36 | len(codes)
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + word.to_bytes(8, "big") + digest
    notes = b"".join(struct.pack("<I", len(t)) + t for t in (f"{k.upper()}={v}".encode() for k, v in sound.tags.items()))
    comment = struct.pack("<I", 8) + b"sonolith" + struct.pack("<I", len(sound.tags)) + notes
    meta = [(0, info)] + [(4, comment)] * bool(sound.tags)
    return b"fLaC" + b"".join(bytes([k | 128 * (i == len(meta) - 1)]) + len(m).to_bytes(3, "big") + m for i, (k, m) in enumerate(meta)) + b"".join(frames)


# ---- registry


@dataclass(frozen=True)
class Codec:
    name: str
    extensions: tuple[str, ...]
    magic: Callable[[bytes], bool] | None
    decode: Callable[..., Sound] | None
    encode: Callable[..., bytes] | None
    priority: int = 0


def _no_vorbis(*_, **__):
    raise UnsupportedFormat("OGG Vorbis needs a native library that isn't here")


_BUILT_IN = [
    Codec("wav", ("wav", "wave"), lambda b: b[:4] in (b"RIFF", b"RF64") and b[8:12] == b"WAVE", wav_decode, wav_encode),
    Codec("aiff", ("aif", "aifc", "aiff"), lambda b: b[:4] == b"FORM" and b[8:12] in (b"AIFF", b"AIFC"), aiff_decode, aiff_encode),
    Codec("flac", ("flac",), lambda b: b[:4] == b"fLaC", flac_decode, flac_encode),
    Codec("ogg", ("oga", "ogg"), lambda b: b[:4] == b"OggS", _no_vorbis, _no_vorbis),
    Codec("raw", ("pcm", "raw"), None, raw_decode, raw_encode),
]
_CODECS: list[Codec] = list(_BUILT_IN)


def register(codec: Codec) -> None:
    _CODECS.insert(0, codec)
    _CODECS.sort(key=lambda c: -c.priority)


def unregister(name: str) -> None:
    """Removes what was registered; a built-in codec stays."""
    _CODECS[:] = [c for c in _CODECS if c.name != name or c in _BUILT_IN]


def supported_formats() -> list[str]:
    return sorted({e for c in _CODECS for e in c.extensions})


def detect(path: str, head: bytes = b"", strict: bool = False) -> Codec:
    """By the first bytes, else by the extension; ``strict`` refuses a file whose two tell different codecs."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    by_name = next((c for c in _CODECS if ext in c.extensions), None)
    by_head = next((c for c in _CODECS if c.magic and c.magic(head)), None) if head else None
    if strict and by_name and by_head and by_name is not by_head and by_name.magic:
        raise InvalidFormat(f"{path} holds {by_head.name}")
    if found := by_head or by_name:
        return found
    raise UnsupportedFormat(f"no codec for {path}")


def for_writing(path: str) -> Codec:
    """The codec that a file's extension names, if it can write."""
    codec = detect(path)
    if codec.encode is None or codec.name == "ogg":
        raise UnsupportedFormat(f"no codec writes {path}")
    return codec


def decode(path: str, data: bytes, fmt: Format | None = None, header_only: bool = False, raw: dict | None = None) -> tuple[Codec, Sound]:
    """``raw``: endianness and signed, for raw samples."""
    codec = detect(path, data[:65_536])
    try:
        if codec.name == "raw":
            if fmt is None:
                raise InvalidFormat("raw samples need a format")
            return codec, raw_decode(data, fmt, **(raw or {}))
        return codec, codec.decode(data, header_only) if header_only else codec.decode(data)
    except SonolithError:
        raise
    except (struct.error, ValueError, IndexError, OverflowError, MemoryError) as e:
        raise InvalidFormat(f"{path}: {e}") from e


ADAPTERS = {"ffmpeg": "external decoder", "mp3": "codec", "midi": "events", "spectrogram": "analysis"}
