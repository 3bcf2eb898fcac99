"""The supplied tables as clips and long signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Format, InvalidParameter, frames_of

RATE = 8_000
MONO, STEREO = Format(1, RATE), Format(2, RATE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mono clip of 64 frames for each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("samples"), "label")


def groups(spark: SparkSession, sf_dir: str, channels: int) -> DataFrame:
    """Runs of ``channels`` successive embeddings as one clip of so many channels; a run that isn't whole is left out."""
    one = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / channels).alias("clip_id"), (F.col("vec_id") % channels).alias("c"), F.col("embedding").cast("array<double>").alias("s"))
    sides = one.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("c") == k, F.col("s"))).alias(f"s{k}") for k in range(channels)]).where(F.col("n") == channels)
    zipped = F.arrays_zip(*[f"s{k}" for k in range(channels)])
    return sides.select("clip_id", F.flatten(F.transform(zipped, lambda z: F.array(*[z[f"s{k}"] for k in range(channels)]))).alias("samples"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even clip beside the next odd one: (clip_id, a, b)."""
    one = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("clip_id"), (F.col("vec_id") % 2).alias("c"), F.col("embedding").cast("array<double>").alias("s"))
    return one.groupBy("clip_id").agg(F.max(F.when(F.col("c") == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("c") == 1, F.col("s"))).alias("b")).where("a is not null and b is not null")


def long_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as one signal, a row a frame: (frame, x)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_totalprice") / 500000.0).alias("x"))


def loud_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as one signal, centred and loud: (frame, x)."""
    return long_signal(spark, sf_dir).select("frame", (F.col("x") * 2 - 1).alias("x"))


def last_clip(signal: DataFrame, frames: int) -> DataFrame:
    """The last frames of a signal (frame, x), a bounded number, as one clip."""
    rows = signal.where(F.col("frame") > signal.agg(F.max("frame").alias("n")).scalar() - frames).agg(F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("r"))
    return rows.select(F.lit(0).cast("long").alias("clip_id"), F.transform("r", lambda p: p["x"]).alias("samples"))


def tone(spark: SparkSession, fmt: Format, seconds: float, waveform: str = "sine", hz: float = 440.0, level: float = 1.0, clip_id: int = 0, **options) -> DataFrame:
    """One clip of a waveform, the same on all channels."""
    from ..functions import samples as A

    n = frames_of(seconds, fmt.sample_rate)
    if seconds > 3600 or n > 50_000_000:
        raise InvalidParameter("a tone lasts an hour and 50 million frames at most")
    frames = F.sequence(F.lit(0), F.lit(max(n, 1) - 1))
    s = F.flatten(F.transform(frames, lambda t: F.array_repeat(A.oscillator(t, fmt.sample_rate, waveform, hz, level, **options), fmt.channels)))
    return spark.range(1).select(F.lit(clip_id).cast("long").alias("clip_id"), A.from_float(s if n else F.array().cast("array<double>"), fmt).alias("samples"))


def silent(spark: SparkSession, fmt: Format, seconds: float, clip_id: int = 0) -> DataFrame:
    n = frames_of(seconds, fmt.sample_rate) * fmt.channels
    return spark.range(1).select(F.lit(clip_id).cast("long").alias("clip_id"), F.array_repeat(F.lit(0.0), n).alias("samples"))
