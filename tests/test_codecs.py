import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.model import Format, InvalidFormat, SonolithError, UnsupportedFormat
from sonolith.sources import audio
from sonolith.sources import codecs as C


def sound(channels=2, bits=16, valid=None, n=300, seed=1):
    f = Format(channels, 22_050, bits, "pcm", valid)
    top = 2 ** (f.valid_bits - 1)
    x = np.cumsum(np.random.default_rng(seed).normal(0, top / 50, (n, channels)), axis=0).clip(-top, top - 1).round()
    return C.Sound(f, x * 2 ** (bits - f.valid_bits), {"title": "é", "artist": "b"})


@pytest.mark.parametrize("codec", ["wav", "aiff", "flac", "raw"])
@pytest.mark.parametrize(("channels", "bits", "valid"), [(1, 8, 8), (2, 16, 16), (2, 24, 24), (3, 24, 20), (6, 16, 16)])
def test_round_trip(codec, channels, bits, valid):
    s = sound(channels, bits, valid)
    enc = next(c for c in C._BUILT_IN if c.name == codec).encode
    got = C.decode(f"x.{codec}", enc(s), s.format)[1]
    assert (got.samples == s.samples).all() and got.format.valid_bits == valid
    if codec in ("wav", "flac"):
        assert got.tags == s.tags
    head = C.decode(f"x.{codec}", enc(s), s.format, header_only=True)[1]
    assert head.frames == 300


def test_golden_samples_are_the_same_in_all_codecs():
    x = np.array([0, 1000, -1000, 2000, -2000, 3000, -3000, 4000], float).reshape(-1, 2)
    s = C.Sound(Format(2, 22_050, 16, "pcm"), x)
    assert all((d == x).all() for d in (C.wav_decode(C.wav_encode(s)).samples, C.aiff_decode(C.aiff_encode(s)).samples, C.flac_decode(C.flac_encode(s, block=2)).samples, C.raw_decode(C.raw_encode(s), s.format).samples))


def test_floats_raw_options_and_refusals():
    f = Format(1, 8000, 32, "float")
    s = C.Sound(f, np.array([[0.5], [2.0]]))
    assert C.wav_decode(C.wav_encode(s)).samples.ravel().tolist() == [0.5, 1.0]
    assert C.raw_decode(C.raw_encode(s, float_domain="ieee"), f).samples.ravel().tolist() == [0.5, 2.0]
    u8 = Format(1, 8000, 8, "pcm")
    assert C.raw_decode(b"\x00\x80\xff", u8).samples.ravel().tolist() == [-128, 0, 127]
    assert C.raw_decode(b"\x12\x34", Format(1, 8000, 16, "pcm"), "big").samples.ravel().tolist() == [0x1234]
    for bad in (lambda: C.aiff_encode(s), lambda: C.flac_encode(s), lambda: C.decode("x.ogg", b"OggS" + bytes(60))):
        with pytest.raises(UnsupportedFormat):
            bad()
    with pytest.raises(InvalidFormat):
        C.raw_decode(b"123", Format(1, 8000, 16, "pcm"))


@pytest.mark.parametrize("stereo", ["auto", "independent", "mid_side"])
def test_flac_stereo_and_broken_checksums(stereo):
    s = sound(2, 16, n=5000)
    data = C.flac_encode(s, 1024, stereo)
    assert (C.flac_decode(data).samples == s.samples).all() and len(data) < s.samples.size * 2
    for at in (60, len(data) // 2, len(data) - 1):
        with pytest.raises(SonolithError):
            C.flac_decode(data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1 :])


@pytest.mark.parametrize("codec", ["wav", "aiff", "flac"])
def test_mutations_raise_only_errors_of_the_library(codec):
    rnd = random.Random(11)
    data = next(c for c in C._BUILT_IN if c.name == codec).encode(sound(2, 16, n=60))
    for _ in range(200):
        broken = bytearray(data)
        for _ in range(rnd.randint(1, 6)):
            broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        broken = bytes(broken[: rnd.randint(0, len(broken))] if rnd.random() < 0.5 else broken)
        try:
            C.decode(f"x.{codec}", broken)
        except SonolithError:
            pass
    for cut in (b"", b"BROKEN", data[:20], data[: len(data) // 2]):
        with pytest.raises(SonolithError):
            C.decode(f"x.{codec}", cut)


def test_registry_and_detection():
    assert C.supported_formats() == sorted("aif aifc aiff flac oga ogg pcm raw wav wave".split())
    wav = C.wav_encode(sound())
    assert C.detect("x.flac", wav).name == "wav"
    with pytest.raises(InvalidFormat):
        C.detect("x.flac", wav, strict=True)
    C.register(C.Codec("mine", ("me",), lambda b: b[:2] == b"ME", None, None, priority=5))
    assert C.detect("a.bin", b"ME..").name == "mine" and "me" in C.supported_formats()
    C.unregister("mine")
    C.unregister("wav")
    assert C.detect("a.wav").name == "wav"
    with pytest.raises(UnsupportedFormat):
        C.detect("a.bin", b"ME..")


def test_files_as_rows(spark, tmp_path):
    s = sound(1, 16, n=100)
    clips = spark.createDataFrame([(i, [float(v + i) for v in s.samples.ravel()[:90]]) for i in range(5)], "clip_id long, samples array<double>")
    for codec in ("wav", "flac"):
        audio.write(clips, f"{tmp_path}/{codec}", s.format, codec)
        with open(f"{tmp_path}/{codec}/bad.{codec}", "wb") as f:
            f.write(b"BROKEN")
        got = audio.read(spark, f"{tmp_path}/{codec}")
        assert got.where("error is not null").count() == 1
        back = {r.path.rsplit("/", 1)[-1].split(".")[0]: r.samples for r in got.where("error is null").collect()}
        assert back == {str(r.clip_id): r.samples for r in clips.collect()}
        heads = audio.read(spark, f"{tmp_path}/{codec}", header_only=True).where("error is null")
        assert {(r.frames, r.codec) for r in heads.collect()} == {(90, codec)}
        assert {r.frames for r in audio.project_metadata(heads, 44_100).collect()} == {180}
        with pytest.raises(Exception, match="already"):
            audio.write(clips, f"{tmp_path}/{codec}", s.format, codec)
        audio.write(clips, f"{tmp_path}/{codec}", s.format, codec, overwrite=True)
    assert audio.catalog(spark).where(F.col("available")).count() == 4


def test_typed_metadata_and_chunks_in_and_out(spark, tmp_path):
    import struct

    s = sound(1, 16, n=1000)
    data = C.wav_encode(s)
    chunk = lambda name, b: name + struct.pack("<I", len(b)) + b
    more = chunk(b"smpl", struct.pack("<9I", 0, 0, 0, 60, 0, 0, 0, 1, 0) + struct.pack("<6I", 0, 2, 100, 900, 0, 0)) + chunk(b"cue ", struct.pack("<I", 2) + b"".join(struct.pack("<IIIIII", i, p, 0, 0, 0, p) for i, p in ((7, 500), (3, 10))))
    more += chunk(b"bext", b"told".ljust(256, b"\0") + b"me".ljust(32, b"\0") + bytes(32) + b"2024-01-0112:00:00" + struct.pack("<Q", 22_050) + bytes(256))
    whole = data + more
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", len(whole) - 8) + whole[8:])
    heads = audio.typed(audio.read(spark, str(tmp_path), header_only=True))
    for rate, k in ((22_050, 1), (44_100, 2)):
        r = audio.project_metadata(heads, rate).first()
        assert [tuple(x) for x in r.loops] == [(2, 100 * k, 900 * k)] and [tuple(x) for x in r.cues] == [(3, 10 * k), (7, 500 * k)]
        assert (r.broadcast.description, r.broadcast.time_reference, r.frames) == ("told", 22_050 * k, 1000 * k)
    batch = audio.read_chunks(spark, str(tmp_path), 300).orderBy("seq").collect()
    assert [(r.start_frame, r.n_frames, r.is_last) for r in batch] == [(0, 300, False), (300, 300, False), (600, 300, False), (900, 100, True)]
    assert [v for r in batch for v in r.samples] == (s.samples.ravel() / 32768).tolist()
    stream = audio.read_chunks(spark, str(tmp_path), 300, stream=True)
    audio.write_stream(stream, f"{tmp_path}/out", s.format, f"{tmp_path}/staging", "flac").awaitTermination()
    back = audio.read(spark, f"{tmp_path}/out").first()
    assert back.codec == "flac" and np.abs(np.array(back.samples) - s.samples.ravel()).max() <= 1
    (tmp_path / "b.raw").write_bytes(C.raw_encode(s, "big", False))
    r = audio.read(spark, f"{tmp_path}/b.raw", raw_format=s.format, raw_options={"endianness": "big", "signed": False}).first()
    assert r.samples == s.samples.ravel().tolist()
    assert C.for_writing("x.aif").name == "aiff"
    with pytest.raises(UnsupportedFormat):
        C.for_writing("x.ogg")


def test_maps_are_checked_and_paths_stay_inside(spark, tmp_path):
    from sonolith.model import InvalidParameter, inside, milliseconds
    from sonolith.plans.planner import Clips

    c = Clips(spark.createDataFrame([(1, [0.0, 0.5, 0.25, 1.0])], "clip_id long, samples array<double>"), Format(2, 8000))
    assert c.map_frames(lambda p: F.array(p[1], p[0])).df().first().samples == [0.5, 0.0, 1.0, 0.25]
    for bad in (c.map_samples(lambda x: F.try_divide(F.lit(1.0), x)), c.map_frames(lambda p: F.array(p[0]))):
        with pytest.raises(Exception, match="map_"):
            bad.df().collect()
    assert len(c.envelope_with_tail(0.0001, attack=0.0, decay=0.0, sustain=1.0, release=0.001).df().first().samples) == 18
    assert inside(str(tmp_path), "a/../b.wav") == f"{tmp_path.resolve()}/b.wav" and milliseconds(250) == 0.25
    with pytest.raises(InvalidParameter):
        inside(str(tmp_path), "../x")
