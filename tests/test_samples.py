import math

import pytest
from pyspark.sql import functions as F

from sonolith.functions import samples as A
from sonolith.model import Format
from sonolith.operators import stateful as T
from sonolith.plans.planner import Clips

PCM16 = Format(1, 44_100, 16, "pcm")


def run(spark, values, f):
    df = spark.createDataFrame([([float(v) for v in values],)], "samples array<double>")
    return df.select(f(F.col("samples")).alias("y")).first()["y"]


def test_pcm_end_points_are_exact(spark):
    assert run(spark, [-32768, 32767], lambda s: A.to_float(s, PCM16)) == [-1.0, 1.0]
    assert run(spark, [-1, 1, 2, -2], lambda s: A.to_pcm(s, PCM16)) == [-32768, 32767, 32767, -32768]


def test_depth_round_trip_stays_within_one(spark):
    p24 = Format(1, 44_100, 24, "pcm")
    x = [12345, -12345, 20000, -20000]
    got = run(spark, x, lambda s: A.to_pcm(A.to_float(A.to_pcm(A.to_float(s, PCM16), p24), p24), PCM16))
    assert all(abs(a - b) <= 1 for a, b in zip(x, got, strict=True))


@pytest.mark.parametrize(
    ("values", "f", "want"),
    [
        ([1, -1, 0.5, 0.5], lambda s: A.channels_to(s, 2, 1), [0, 0.5]),
        ([0, 0, 0.25, -0.25, 0, 0], lambda s: A.trim(s, 2, 0.1), [0.25, -0.25]),
        ([0, 0], lambda s: A.trim(s, 2, 0.1), []),
        ([1, -1, 0.2, -0.2, 0.4, -0.4], lambda s: A.reverse(s, 2), [0.4, -0.4, 0.2, -0.2, 1, -1]),
        ([0, 1, 0, -1], lambda s: A.resample_linear(s, 1, 8000, 16000), [0, 0.5, 1, 0.5, 0, -0.5, -1, -1]),
        ([1, 1, 1], lambda s: A.fade(s, 1, 1000, 0.001, "in"), [1, 1, 1]),
        ([1, 1, 1], lambda s: A.fade(s, 1, 1000, 0.001, "out"), [1, 1, 0]),
        ([1, 1, 1], lambda s: A.fade(s, 1, 1000, 0.0, "out"), [1, 1, 1]),
        ([0.5, 0.5, -0.5, -0.5], lambda s: A.repeat(s, 0), []),
    ],
)
def test_small_cases(spark, values, f, want):
    assert run(spark, values, f) == pytest.approx(want)


def test_three_channels_to_two(spark):
    left, right = run(spark, [1, 0, 1], lambda s: A.channels_to(s, 3, 2))
    assert left > 1 and right == pytest.approx(0.707)


def test_measures(spark):
    assert run(spark, [0.5, -0.5], A.peak) == run(spark, [0.5, -0.5], A.rms) == 0.5
    assert run(spark, [0.5, -0.5], lambda s: A.dbfs(A.rms(s))) == pytest.approx(-6.0206, abs=1e-4)
    assert run(spark, [0.5, 0.5, -0.5, -0.5], lambda s: A.zero_crossing_rate(s, 2)) == 1.0
    assert run(spark, [1, 0, 1, 0], lambda s: A.clipped(s, 2)) is True
    assert run(spark, [1, 0, -1], lambda s: A.clipped(s, 1)) is False
    for f in (A.peak, A.rms, A.dc_offset, lambda s: A.zero_crossing_rate(s, 1)):
        assert run(spark, [], f) == 0.0
    assert run(spark, [], lambda s: A.dbfs(A.peak(s))) == -math.inf


def test_loudness(spark):
    f = Format(1, 48_000)
    sine = [math.sin(2 * math.pi * 1000 * i / 48_000) for i in range(48_000)]
    assert run(spark, sine, lambda s: T.lufs(s, f)) == pytest.approx(-3.05, abs=0.15)
    two = Format(2, 48_000)
    assert run(spark, [x for x in sine for _ in "lr"], lambda s: T.lufs(s, two)) == pytest.approx(-0.04, abs=0.15)
    assert run(spark, [0.0] * 4800, lambda s: T.lufs(s, f)) == -math.inf
    assert run(spark, sine[:4000], lambda s: T.momentary(s, f)) > -10


def test_sinc_removes_what_lies_above_the_new_rate(spark):
    x = [math.sin(2 * math.pi * 10_000 * i / 48_000) for i in range(12_000)]
    assert run(spark, x, lambda s: A.rms(T.resample_sinc(s, Format(1, 48_000), 12_000))) < 0.01


def test_chain_of_steps(spark):
    df = spark.createDataFrame([(1, [0.5, -0.25, 0.125, 1.0]), (2, [])], "clip_id long, samples array<double>")
    clips = Clips(df, Format(1, 8000))
    got = {r.clip_id: r.samples for r in clips.gain(-6.0206).reverse().pad(0, 1 / 8000).df().collect()}
    assert got[1] == pytest.approx([0.5, 0.0625, -0.125, 0.25, 0.0], abs=1e-5) and got[2] == [0.0]
    pcm = Clips(df.where("clip_id = 1"), Format(1, 8000)).with_bit_depth(16)
    assert pcm.df().first()["samples"] == [16384.0, -8192.0, 4096.0, 32767.0]
    twice = pcm.gain(-3.0).gain(-3.0).df().first()["samples"]
    assert all(x == int(x) for x in twice)
    st = clips.stats().orderBy("clip_id").collect()
    assert st[0].peak == 1.0 and st[1].silent and st[1].lufs == -math.inf
    assert clips.normalize(-6.0).df().where("clip_id = 2").first()["samples"] == []


def test_two_sets_of_clips(spark):
    a = Clips(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.25])], "clip_id long, samples array<double>"), Format(1, 8000))
    b = Clips(spark.createDataFrame([(1, [0.75, 0.75, 1.0])], "clip_id long, samples array<double>"), Format(1, 8000))
    rows = lambda c: {r.clip_id: r.samples for r in c.df().collect()}
    assert rows(a.concat(b)) == {1: [0.5, 0.5, 0.75, 0.75, 1.0], 2: [0.25]}
    assert rows(a.prepend(b))[1] == [0.75, 0.75, 1.0, 0.5, 0.5]
    assert rows(a.mix(b)) == {1: [1.0, 1.0, 1.0], 2: [0.25]} and rows(a.mix(b, "none"))[1] == [1.25, 1.25, 1.0]
    assert rows(a.mix(b, "normalize"))[1] == [1.0, 1.0, 0.8] and rows(a.mix(b, "none", (0.0, -200.0)))[1][0] == pytest.approx(0.5)
    assert rows(a.overlay(b, 1 / 8000))[1] == [0.5, 1.25, 0.75, 1.0]
    assert rows(a.crossfade(b, 2 / 8000))[1] == pytest.approx([0.5, 0.75, 1.0])
    assert a.show() == "Clips(mono, 8kHz, 32 bit float)"
    one, two = a.split(1 / 8000)
    assert rows(one)[1] == [0.5] and rows(two) == {1: [0.5], 2: []}


def test_tones_and_silence(spark):
    from sonolith.sources.tables import silent, tone

    f = Format(2, 8000, 16, "pcm")
    s = tone(spark, f, 0.01, "square", 100.0, 0.5).first()["samples"]
    assert len(s) == 160 and max(s) <= 32767 and s[0] == s[1] and all(x == int(x) for x in s)
    assert tone(spark, f, 0.0).first()["samples"] == [] and silent(spark, f, 0.001).first()["samples"] == [0.0] * 16
    with pytest.raises(Exception):
        tone(spark, f, 0.01, "sine", 5000.0)
