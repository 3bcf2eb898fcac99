"""What leaves a Python function is many times what comes in; a worker must not hold a whole batch of it."""

import threading
import time
from pathlib import Path

from pyspark.sql import functions as F

from sonolith.model import Format
from sonolith.operators import kernels as K
from sonolith.operators import stateful as T
from sonolith.operators.blocked import filter_rows
from sonolith.sources import audio


def largest_worker(run) -> float:
    """The most MB that any of Spark's Python workers has while ``run`` goes on."""
    most, on = 0.0, True

    def watch():
        nonlocal most
        while on:
            for p in Path("/proc").glob("[0-9]*"):
                try:
                    if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                        most = max(most, int((p / "statm").read_text().split()[1]) * 4096 / 1e6)
                except OSError:
                    pass
            time.sleep(0.02)

    t = threading.Thread(target=watch)
    t.start()
    try:
        run()
    finally:
        on = False
        t.join()
    return most


def test_tails_leave_a_worker_as_they_are_made(spark):
    """1,500 short clips with long tails: 98 MB as samples."""
    fmt = Format(2, 8_000)
    clips = spark.range(0, 1_500, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.sin(i * (F.col("id") + 1) * 0.01)).alias("samples"))
    clips = clips.withColumn("samples", F.when(F.monotonically_increasing_id() >= 0, F.col("samples")))
    made = clips.select(F.size(T.apply(F.col("samples"), fmt, lambda: [K.Reverb(0.1, 0.5, 0.3, 0.001, 0.6)])).alias("n"))
    got = []
    assert largest_worker(lambda: got.append(made.agg(F.count("n"), F.min("n"), F.max("n")).first())) < 400
    assert tuple(got[0]) == (1_500, 2 * (64 + 4_008), 2 * (64 + 4_008))


def test_a_chain_goes_block_by_block(spark):
    """6,000 short clips through three processors with tails: 92 MB as samples."""
    fmt = Format(2, 8_000)
    clips = spark.range(0, 6_000, 1, 1).select("id", F.array_repeat(F.col("id") % 7 / 10.0 + 0.1, 128).alias("samples"))
    made = clips.select(F.size(T.apply(F.col("samples"), fmt, K.mastering_chain)).alias("n"))
    got = []
    assert largest_worker(lambda: got.append(made.agg(F.count("n"), F.min("n"), F.max("n")).first())) < 400
    assert got[0][0] == 6_000 and got[0][1] == got[0][2] == 1_912


def test_samples_leave_a_worker_as_they_are_decoded(spark):
    """4,000 files of 8-bit samples in one batch: 16 MB of bytes, 128 MB as samples."""
    text = spark.range(0, 4_000, 1, 1).select("id", F.repeat(F.lit("ab"), (F.col("id") % 2 + 1).cast("int") * 1_333).alias("text"))
    s = text.select(audio.decode_samples(F.encode("text", "UTF-8"), "a.raw", Format(1, 8_000, 8, "pcm")).alias("s"))
    made = s.select(F.size("s").alias("n"), F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    got = []
    assert largest_worker(lambda: got.append(made.agg(F.count("n"), F.sum("n"), F.min("a"), F.max("b")).first())) < 400
    assert tuple(got[0]) == (4_000, 4_000 * 3_999, ord("a") - 128.0, ord("b") - 128.0)


def test_blocks_of_a_long_signal_leave_a_worker_as_they_are_filtered(spark):
    """Five million frames in one task: 40 MB as samples."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    signal = spark.range(5_000_000).select(F.col("id").alias("frame"), (F.col("id") % 100 / 50.0 - 1).alias("x"))
    got = []
    try:
        made = filter_rows(signal, (0.5, 0.0, 0.0, -0.5, 0.0), 16_384)
        assert largest_worker(lambda: got.append(made.agg(F.count("y"), F.max("frame")).first())) < 380
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(got[0]) == (5_000_000, 4_999_999)


def test_blocks_give_what_single_clips_give():
    """Clips of several lengths, silent and empty ones, in blocks of a few, through a chain: each as by itself."""
    import numpy as np

    fmt, rng = Format(2, 8_000), np.random.default_rng(3)
    clips = [rng.uniform(-1, 1, (n, 2)) for n in (5, 64, 0, 200, 1, 64, 33)] + [np.zeros((20, 2))]
    make = lambda: [K.Delay(0.01, 0.5, 0.3), *K.mastering_chain()]
    alone = [y for c in clips for y in T.through(make(), [c], fmt, True)]
    bound = T.BLOCK_SAMPLES
    for T.BLOCK_SAMPLES in (1, 20_000, bound):
        got = list(T.through(make(), clips, fmt, True))
        assert len(got) == len(alone) and all(np.allclose(a, b, rtol=0, atol=1e-12) and a.shape == b.shape for a, b in zip(got, alone, strict=True))
    assert T.BLOCK_SAMPLES == bound
