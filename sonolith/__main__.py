"""``python -m sonolith``: info, convert, normalize, trim, chain, tone, render, timeline, formats, doctor. Files are named one or by a pattern; the work is Spark's."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import Format, SonolithError


def _clips(spark: SparkSession, path: str):
    """The files of one format as clips; the file's name is the clip's."""
    from .plans.planner import Clips
    from .sources import audio

    rows = audio.read(spark, path).where("error is null")
    first = rows.select("channels", "sample_rate", "bit_depth", "sample_format", "valid_bits").first()
    if first is None:
        raise SonolithError(f"no file can be read: {path}")
    return Clips(rows.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("clip_id"), "samples"), Format(*first))


def _doctor(spark: SparkSession) -> int:
    """What this place can do; 0 if all that is needed is there."""
    import importlib.util

    missing = [x for x in ("numpy", "pandas", "pyarrow") if importlib.util.find_spec(x) is None]
    shared = spark.conf.get("spark.checkpoint.dir", None)
    print(f"spark {spark.version}, master {spark.sparkContext.master}")
    print(f"missing: {', '.join(missing) or 'nothing'}")
    print(f"shared folder: {shared or 'none (set spark.checkpoint.dir on a cluster)'}")
    return int(bool(missing))


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="sonolith")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("formats")
    sub.add_parser("doctor")
    sub.add_parser("info").add_argument("path")
    for name in ("chain", "render"):
        q = sub.add_parser(name)
        q.add_argument("path")
        q.add_argument("folder")
        q.add_argument("--codec", default="wav")
        if name == "chain":
            q.add_argument("--effect", action="append", required=True, help="a name, or name:option=number,option=number; applied in order")
    for name in ("convert", "normalize", "trim", "tone", "timeline"):
        q = sub.add_parser(name)
        if name not in ("tone",):
            q.add_argument("path")
        if name != "timeline":
            q.add_argument("folder")
            q.add_argument("--codec", default="wav")
        for option, kind in {"convert": {"rate": int, "channels": int}, "normalize": {"db": float}, "trim": {"threshold": float}, "tone": {"hz": float, "seconds": float, "rate": int}, "timeline": {}}[name].items():
            q.add_argument(f"--{option}", type=kind)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from .operators.song import Song
    from .sources import audio, tables

    try:
        if a.what == "formats":
            audio.catalog(spark).show(truncate=False)
        elif a.what == "doctor":
            return _doctor(spark)
        elif a.what == "render":
            with open(a.path, encoding="utf-8") as f:
                song = Song.from_json(f.read())
            if wrong := song.validate():
                raise SonolithError("; ".join(wrong))
            song.write(spark, a.folder, a.codec)
        elif a.what == "chain":
            c = _clips(spark, a.path)
            for e in a.effect:
                name, _, options = e.partition(":")
                c = c.effect(name, **{k: float(v) for k, v in (x.split("=", 1) for x in options.split(",") if x)})
            audio.write(c.df(), a.folder, c.format, a.codec, overwrite=True)
        elif a.what == "info":
            audio.read(spark, a.path, header_only=True).show(truncate=False, vertical=True)
        elif a.what == "timeline":
            with open(a.path, encoding="utf-8") as f:
                for r in Song.from_json(f.read()).timeline_json(spark).toLocalIterator():
                    print(r.event)
        elif a.what == "tone":
            fmt = Format(1, a.rate or 44_100, 16, "pcm")
            audio.write(tables.tone(spark, fmt, a.seconds or 1.0, hz=a.hz or 440.0), a.folder, fmt, a.codec, overwrite=True)
        else:
            c = _clips(spark, a.path)
            if a.what == "convert":
                c = c.convert(c.format.with_(sample_rate=a.rate or c.format.sample_rate, **({"channels": a.channels} if a.channels else {})))
            elif a.what == "normalize":
                c = c.normalize(a.db or 0.0)
            else:
                c = c.trim(0.01 if a.threshold is None else a.threshold)
            audio.write(c.df(), a.folder, c.format, a.codec, overwrite=True)
    except SonolithError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
