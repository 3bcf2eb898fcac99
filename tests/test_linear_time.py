import time

import pytest
from pyspark.sql import functions as F

from sonolith.functions import samples as A
from sonolith.model import Format
from sonolith.plans.planner import Clips

STEPS = {
    "remove_dc": lambda c: c.remove_dc_offset(),
    "normalize": lambda c: c.normalize(-3.0),
    "rms": lambda c: c.normalize(-18.0, "rms"),
    "fade": lambda c: c.fade_in(1.0).fade_out(1.0, "log"),
    "reverse": lambda c: c.reverse(),
    "rotate": lambda c: c.rotate(0.3),
    "to_mono": lambda c: c.to_mono(),
    "resample": lambda c: c.resample(12_000),
    "trim": lambda c: c.trim(0.1),
    "bitcrush": lambda c: c._to(lambda s: A.bitcrush(s, 2, 6, 3)),
    "chorus": lambda c: c._to(lambda s: A.chorus(s, 2, 8_000)),
    "crossfade": lambda c: c.crossfade(c, 2.0),
}


def seconds(spark, step, frames):
    """How long a step takes over one stereo clip of 16 bits; the samples are an expression, not a stored column."""
    df = spark.range(1).select(F.col("id").alias("clip_id"), F.transform(F.sequence(F.lit(0), F.lit(2 * frames - 1)), lambda i: (F.sin(i * 0.01) * 20000).cast("int")).alias("samples"))
    began = time.time()
    n = step(Clips(df, Format(2, 8_000, 16, "pcm"))).df().select(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).collect()
    assert n
    return time.time() - began


@pytest.mark.parametrize("name", STEPS)
def test_ten_times_the_frames_take_no_hundred_times_the_time(spark, name):
    seconds(spark, STEPS[name], 100)
    short, long = seconds(spark, STEPS[name], 10_000), seconds(spark, STEPS[name], 100_000)
    assert long < 25 * max(short, 0.15), (name, short, long)


def test_python_steps_follow_bound_expressions(spark):
    df = spark.createDataFrame([(i, [float((i * 31 + k) % 200 - 100) for k in range(400)]) for i in range(6)], "clip_id long, samples array<double>").repartition(2)
    c = Clips(df, Format(2, 8_000, 16, "pcm"))
    made = c.fade_in(0.01).remove_dc_offset().effect("delay", time=0.01).normalize(-20.0, "lufs").convert(Format(1, 16_000, 16, "pcm"), "windowed_sinc").reverse().resample(12_000)
    assert made.stats().where("true_peak > 0").count() == 6
    assert made.df().count() == 6
