"""Queries over files and streams of chunks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as A
from ..model import CHUNKS, Format
from ..operators import kernels as K
from ..sources import audio
from ..sources.tables import MONO, RATE, clips, groups, table
from ..streaming import chunks as C
from .effect_queries import _biquad_state, _lp
from .registry import S, query, recursion, rows, sql_rows, sql_stereo

PCM16 = Format(1, RATE, 16, "pcm")
_TO16 = "CASE WHEN {0} < 0 THEN round({0} * 32768) ELSE round({0} * 32767) END"

for _codec, _name in (("wav", "a.wav"), ("aiff", "a.aiff"), ("flac", "a.flac"), ("raw", "a.raw")):

    def _trip(spark, d, codec=_codec, name=_name):
        made = clips(spark, d).select("clip_id", audio.encode(A.to_pcm(F.col("samples"), PCM16), PCM16, codec).alias("content"))
        return rows(made, audio.decode_samples(F.col("content"), name, PCM16))

    query(f"WITH {S} " + sql_rows(_TO16.format("x")), f"codec_{_codec}")(_trip)



def _big_endian(spark, d):
    """Raw samples with their options, out and in."""
    made = clips(spark, d).select("clip_id", audio.encode(A.to_pcm(F.col("samples"), PCM16), PCM16, "raw", endianness="big", signed=False).alias("content"))
    return rows(made, audio.decode_samples(F.col("content"), "a.raw", PCM16, endianness="big", signed=False))


query(f"WITH {S} " + sql_rows(_TO16.format("x")), "codec_raw_options")(_big_endian)


@query(f"WITH {S} SELECT clip_id, CAST(i // 24 AS BIGINT) AS seq, CAST(i // 24 * 24 AS BIGINT) AS start_frame, CAST(count(*) AS INTEGER) AS n_frames, i // 24 = 2 AS is_last, round(sum({_TO16.format('x')} / 32768), 6) + 0.0 AS total FROM S GROUP BY clip_id, i // 24")
def file_chunks(spark, d) -> DataFrame:
    """WAV files read as chunks of 24 frames."""
    files = clips(spark, d).select("clip_id", F.lit("a.wav").alias("path"), audio.encode(A.to_pcm(F.col("samples"), PCM16), PCM16, "wav").alias("content"))
    got = audio.decode_chunks(files, 24)
    return got.select("clip_id", "seq", "start_frame", "n_frames", "is_last", (F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"))


_STEREO16 = Format(2, RATE, 16, "pcm")


@query(sql_stereo(_TO16.format("l"), _TO16.format("r")))
def codec_flac_stereo(spark, d) -> DataFrame:
    made = groups(spark, d, 2).select("clip_id", audio.encode(A.to_pcm(F.col("samples"), _STEREO16), _STEREO16, "flac").alias("content"))
    return rows(made, audio.decode_samples(F.col("content"), "a.flac", _STEREO16))


@query(
    """
WITH H AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
L AS (SELECT doc_id, n, list_transform(range(n), lambda k: (position(substr(h, 2 * k + 1, 1) IN '0123456789ABCDEF') - 1) * 16 + position(substr(h, 2 * k + 2, 1) IN '0123456789ABCDEF') - 129) AS v FROM H)
SELECT doc_id, CAST(n AS BIGINT) AS frames, CAST(coalesce(list_sum(v), 0) AS BIGINT) AS total, CAST(coalesce(list_max(list_transform(v, lambda x: abs(x))), 0) AS BIGINT) AS peak FROM L
"""
)
def raw_decode(spark, d) -> DataFrame:
    """Texts read as unsigned 8-bit samples."""
    u8 = Format(1, RATE, 8, "pcm")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    s = table(spark, d, "documents").select("doc_id", audio.decode_samples(content, "a.raw", u8).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("frames"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"), A.peak(F.col("s")).cast("long").alias("peak"))


@query(recursion(_biquad_state(_lp), "y1"))
def chunked_filter(spark, d) -> DataFrame:
    """Chunks of 5 frames, each clip's in one task, equal the whole clip."""
    parts = C.chunked(clips(spark, d), 1, 5)
    return rows(C.joined(C.process(parts, lambda: [K.Filter("lowpass", 1000.0)], MONO, tail=False)), F.col("samples"))


def _shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sonolith-")
    return f"{named.rstrip('/')}/sonolith-streams/{uuid.uuid4().hex}"


@query(recursion(_biquad_state(_lp), "y1"))
def stream_filter(spark, d) -> DataFrame:
    """The same as a Structured Streaming query: files of chunks, two a micro-batch, kernels' state kept between them."""
    at = _shared(spark)
    C.chunked(clips(spark, d), 1, 24).repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    done = C.process(stream, lambda: [K.Filter("lowpass", 1000.0)], MONO, tail=False)
    done.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return rows(C.joined(spark.read.schema(CHUNKS).parquet(f"{at}/out")), F.col("samples"))


@query(f"WITH {S} SELECT clip_id, CAST(i // 16 AS BIGINT) AS seq, CAST(16 AS INTEGER) AS n_frames, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round((i // 16 + 1) * 16 / 64.0, 6) AS ratio FROM S GROUP BY clip_id, i // 16")
def meter_stream(spark, d) -> DataFrame:
    parts = C.chunked(clips(spark, d), 1, 16)
    both = C.meter(parts).join(C.progress(parts, 64).select("clip_id", "seq", "ratio"), ["clip_id", "seq"])
    return both.select("clip_id", "seq", "n_frames", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"), F.round("ratio", 6).alias("ratio"))


@query()
def codec_catalog(spark, d) -> DataFrame:
    return audio.catalog(spark)
