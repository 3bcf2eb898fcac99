"""Sound files as DataFrames.

Reading goes through Spark's binary files, so any store that Spark reads will do; a file is one row
and one task's work. Writing is a Python data source with a two-phase commit: tasks write temporary
files beside their targets, and the commit renames them, so a lost task leaves nothing behind.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..model import CHUNKS, Format, InvalidFormat, InvalidParameter
from ..operators.stateful import sent
from . import codecs as C

HEADER = "path string, codec string, channels int, sample_rate int, bit_depth int, valid_bits int, sample_format string, channel_layout array<string>, frames long, duration double, tags map<string,string>, extra map<string,string>, error string"


def _row(path: str, data: bytes, fmt: Format | None, header_only: bool, raw: dict | None) -> dict:
    try:
        codec, s = C.decode(path, bytes(data), fmt, header_only, raw)
    except C.SonolithError as e:
        return {"path": path, "error": f"{type(e).__name__}: {e}"}
    f = s.format
    return {
        "path": path, "codec": codec.name, "channels": f.channels, "sample_rate": f.sample_rate, "bit_depth": f.bit_depth, "valid_bits": f.valid_bits, "sample_format": f.sample_format,
        "channel_layout": list(f.channel_layout) if f.channel_layout else None, "frames": s.frames, "duration": s.frames / f.sample_rate, "tags": s.tags, "extra": s.extra, "samples": s.samples.ravel(),
    }


def read(spark: SparkSession, path: str, header_only: bool = False, raw_format: Format | None = None, raw_options: dict | None = None) -> DataFrame:
    """HEADER, and ``samples`` (codes of PCM, values of float) unless only headers are asked for. A file that can't be read has an error and nothing else."""
    text, whole = pa.string(), pa.int32()
    kinds = [("path", text), ("codec", text), *[(k, whole) for k in ("channels", "sample_rate", "bit_depth", "valid_bits")], ("sample_format", text), ("channel_layout", pa.list_(text)), ("frames", pa.int64()), ("duration", pa.float64())]
    kinds += [("tags", pa.map_(text, text)), ("extra", pa.map_(text, text)), ("error", text)] + ([] if header_only else [("samples", pa.list_(pa.float64()))])
    arrow = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                row = _row(p.as_py(), data.as_py(), raw_format, header_only, raw_options)
                row |= {k: list(row[k].items()) for k in ("tags", "extra") if k in row}
                yield pa.RecordBatch.from_pylist([{k: row.get(k) for k, _ in kinds}], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, HEADER + ("" if header_only else ", samples array<double>"))


def decode_chunks(files: DataFrame, frames: int = 4096, raw_format: Format | None = None, raw_options: dict | None = None) -> DataFrame:
    """Of (clip_id, path, content): CHUNKS of ``frames`` frames, their samples as floats. A file is decoded in its task and leaves it chunk by chunk; one that can't be read raises."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for clip_id, path, content in zip(b["clip_id"], b["path"], b["content"], strict=True):
                s = C.decode(path, bytes(content), raw_format, raw=raw_options)[1]
                scale = 1.0 if s.format.is_float else 2.0 ** -(s.format.bit_depth - 1)
                last = max(0, -(-s.frames // frames) - 1)
                for seq in range(last + 1):
                    part = s.samples[seq * frames : (seq + 1) * frames]
                    yield pd.DataFrame([(clip_id, seq, seq * frames, len(part), seq == last, part.ravel() * scale)], columns=names)

    return files.select("clip_id", "path", "content").mapInPandas(run, CHUNKS)


def read_chunks(spark: SparkSession, path: str, frames: int = 4096, raw_format: Format | None = None, raw_options: dict | None = None, stream: bool = False) -> DataFrame:
    """Files as CHUNKS, in a batch or as a stream of files that come in; a file's clip_id is the hash of its path."""
    if stream:
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = spark.readStream.format("binaryFile").schema(schema).load(path)
    else:
        files = spark.read.format("binaryFile").load(path)
    return decode_chunks(files.select(F.xxhash64("path").alias("clip_id"), "path", "content"), frames, raw_format, raw_options)


def write_stream(chunks: DataFrame, folder: str, fmt: Format, staging: str, codec: str = "wav", **options):
    """A stream of CHUNKS into files, one a clip, each written when its last chunk has come.

    Chunks wait in ``staging``, a folder a micro-batch, so that a batch that is run again replaces its own.
    """
    from ..functions import samples as A
    from ..streaming.chunks import joined

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{staging}/chunks/batch={number}")
        every = spark.read.schema(CHUNKS).option("recursiveFileLookup", "true").parquet(f"{staging}/chunks")
        ended = spark.read.schema(CHUNKS).parquet(f"{staging}/chunks/batch={number}").where("is_last").select("clip_id").distinct()
        whole = joined(every.join(ended, "clip_id", "left_semi"))
        write(whole.withColumn("samples", A.from_float(F.col("samples"), fmt)), folder, fmt, codec, overwrite=True, **options)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", f"{staging}/state").trigger(availableNow=True).start()


def typed(headers: DataFrame) -> DataFrame:
    """Adds what ``extra`` says in columns: loops (kind, start, end) and cues (id, position) in frames, and broadcast, from whom and when a recording is."""
    entries = F.map_entries("extra")
    named = lambda start: F.filter(entries, lambda e: e["key"].startswith(start))
    loop = lambda e: F.struct(*[F.split(e["value"], ",")[i].cast("long").alias(n) for i, n in enumerate(("kind", "start", "end"))])
    cue = lambda e: F.struct(F.substring_index(e["key"], "_", -1).cast("long").alias("id"), e["value"].cast("long").alias("position"))
    of = lambda k: F.try_element_at("extra", F.lit(k))
    parts = ("description", "originator", "origination_date", "origination_time")
    told = F.struct(*[of(k).alias(k) for k in parts], of("time_reference").cast("long").alias("time_reference"))
    return headers.withColumns({"loops": F.transform(named("loop_"), loop), "cues": F.array_sort(F.transform(named("cue_"), cue)), "broadcast": F.when(of("time_reference").isNotNull(), told)})


def project_metadata(headers: DataFrame, rate: int) -> DataFrame:
    """Frame counts and durations, and if they are there loops, cues and the time reference, as they would be at another rate."""
    there = lambda x: F.floor((x * F.lit(2 * rate) + F.col("sample_rate")) / (2 * F.col("sample_rate"))).cast("long")
    n = there(F.col("frames"))
    more = {}
    if "loops" in headers.columns:
        more["loops"] = F.transform("loops", lambda x: F.struct(x["kind"].alias("kind"), there(x["start"]).alias("start"), there(x["end"]).alias("end")))
        more["cues"] = F.transform("cues", lambda x: F.struct(x["id"].alias("id"), there(x["position"]).alias("position")))
        more["broadcast"] = F.when(F.col("broadcast").isNotNull(), F.col("broadcast").withField("time_reference", there(F.col("broadcast.time_reference"))))
    # First what is within arrays: a lambda would read the new rate.
    return headers.withColumns(more).withColumns({"frames": n, "sample_rate": F.lit(rate), "duration": n / float(rate)})


def encode(samples: Column, fmt: Format, codec: str, **options) -> Column:
    """Each clip as a file's bytes."""
    made = next((c for c in C._CODECS if c.name == codec), None)
    if made is None or made.encode is None:
        raise InvalidParameter(f"no such codec: {codec}")

    @F.pandas_udf("binary")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series([made.encode(C.Sound(fmt, np.asarray(v, np.float64).reshape(-1, fmt.channels)), **options) for v in x], dtype=object)

    return f(samples)


def decode_samples(content: Column, name: str, fmt: Format | None = None, **raw) -> Column:
    """The samples of a file's bytes; a broken file raises. ``raw``: endianness and signed, for raw samples."""

    @F.pandas_udf("array<double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return sent(C.decode(name, bytes(v), fmt, raw=raw)[1].samples.ravel() for x in batches for v in x)

    return f(content)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace = folder, replace

    def write(self, rows) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for r in rows:
            name = os.path.basename(r["name"])
            target = os.path.join(self.folder, name)
            if not self.replace and os.path.exists(target):
                raise InvalidParameter(f"{target} is there already")
            temporary = os.path.join(self.folder, f".{name}.{uuid.uuid4().hex}")
            with open(temporary, "wb") as f:
                f.write(bytes(r["content"]))
                f.flush()
                os.fsync(f.fileno())
            files.append((temporary, target))
        return _Written(files)

    def commit(self, messages) -> None:
        for m in messages:
            for temporary, target in m.files:
                os.replace(temporary, target)

    def abort(self, messages) -> None:
        for m in messages:
            for temporary, _ in m.files if m else []:
                if os.path.exists(temporary):
                    os.remove(temporary)


class AudioFiles(DataSource):
    """``df.write.format("sound_files")``: rows (name, content) as files of a folder that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "sound_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        folder = self.options.get("path")
        if not folder:
            raise InvalidParameter("a folder is needed")
        return _Writer(folder.removeprefix("file://"), overwrite)


def write(df: DataFrame, folder: str, fmt: Format, codec: str = "wav", overwrite: bool = False, **options) -> None:
    """Each clip (clip_id, samples) as ``<clip_id>.<extension>`` in a folder."""
    ext = {"aiff": "aiff", "flac": "flac", "raw": "raw"}.get(codec, codec)
    df.sparkSession.dataSource.register(AudioFiles)
    from ..functions.samples import settled

    rows = settled(df).select(F.concat(F.col("clip_id").cast("string"), F.lit(f".{ext}")).alias("name"), encode(F.col("samples"), fmt, codec, **options).alias("content"))
    rows.write.format("sound_files").option("path", folder).mode("overwrite" if overwrite else "append").save()


def catalog(spark: SparkSession) -> DataFrame:
    """Codecs and adapters by name."""
    rows = [(c.name, "codec", list(c.extensions), c.decode is not None and c.name != "ogg") for c in C._BUILT_IN] + [(k, f"adapter: {v}", [], False) for k, v in C.ADAPTERS.items()]
    return spark.createDataFrame(rows, "name string, kind string, extensions array<string>, available boolean")


__all__ = ["HEADER", "AudioFiles", "InvalidFormat", "catalog", "decode_chunks", "decode_samples", "encode", "project_metadata", "read", "read_chunks", "typed", "write", "write_stream"]
