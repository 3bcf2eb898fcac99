"""Queries over clips: formats, levels, ranges, combinations, measures, rates, generators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import samples as A
from ..model import Format
from ..operators import stateful as T
from ..sources.tables import MONO, RATE, STEREO, clips, groups, long_signal, pairs
from .registry import ORACLES, QUERIES, P, S, query, rows, sql_rows, sql_stereo, tidy



def X():
    return F.col("samples")


PCM16 = Format(1, RATE, 16, "pcm")
PCM24 = Format(1, RATE, 24, "pcm")
PCM20 = Format(1, RATE, 24, "pcm", valid_bits=20)


def _put(name: str, f, sql: str | None) -> None:
    query(sql, name)(f)


def mapped(name: str, f, sql: str | None, digits: int = 6) -> None:
    """A query that maps each clip's array to another."""
    _put(name, lambda spark, d: rows(clips(spark, d), f(X()), digits=digits), sql)


def stereo(name: str, f, left: str, right: str, digits: int = 6) -> None:
    _put(name, lambda spark, d: rows(groups(spark, d, 2), f(X()), digits=digits), sql_stereo(left, right, digits))


def one(y: str, where: str = "", source: str = S, digits: int = 6) -> str:
    return f"WITH {source} " + sql_rows(y, where=where, digits=digits)


# ---- measures


@query(
    f"""
WITH {S}, D AS (SELECT *, lag(x) OVER (PARTITION BY clip_id ORDER BY i) AS p FROM S)
SELECT clip_id, max(n) AS frames, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) + 0.0 AS dc_offset,
       round(20 * log10(max(abs(x))), 6) AS peak_dbfs, round(avg(CASE WHEN p IS NOT NULL THEN CASE WHEN (p < 0) <> (x < 0) THEN 1.0 ELSE 0.0 END END), 6) AS zero_crossing_rate,
       max(abs(x)) = 0 AS silent, max(abs(x)) <= 0.5 AS quiet FROM D GROUP BY clip_id
"""
)
def clip_stats(spark, d) -> DataFrame:
    m = clips(spark, d).select("clip_id", F.size(X()).cast("long").alias("frames"), A.peak(X()).alias("p"), A.rms(X()).alias("r"), A.dc_offset(X()).alias("o"), A.zero_crossing_rate(X(), 1).alias("z"))
    return m.select(
        "clip_id", "frames", tidy(F.col("p")).alias("peak"), tidy(F.col("r")).alias("rms"), tidy(F.col("o")).alias("dc_offset"), tidy(A.dbfs(F.col("p"))).alias("peak_dbfs"),
        tidy(F.col("z")).alias("zero_crossing_rate"), (F.col("p") == 0).alias("silent"), (F.col("p") <= 0.5).alias("quiet"),
    )


@query(
    """
WITH F AS (SELECT o_orderkey AS frame, CASE WHEN o_totalprice >= 400000 THEN 1 ELSE 0 END AS full_scale FROM orders),
G AS (SELECT frame, full_scale, frame - row_number() OVER (PARTITION BY full_scale ORDER BY frame) AS run FROM F)
SELECT CAST(min(frame) AS BIGINT) AS first_frame, CAST(count(*) AS BIGINT) AS frames FROM G WHERE full_scale = 1 GROUP BY run HAVING count(*) >= 2
"""
)
def clipped_runs(spark, d) -> DataFrame:
    """Runs of two or more frames at full scale after amplification. Blocks meet at their ends only, on two levels before one task sees what is left: two rows a block of 16 million frames at most."""
    s = long_signal(spark, d).where(F.col("x") * 1.25 >= 1).select(F.col("frame").alias("a"), F.col("frame").alias("z"))
    done = None
    for size in (4096, 4096 * 4096, None):
        # Runs meet within a block; only those that reach its ends go on to the next, larger one.
        w = Window.partitionBy(F.floor(F.col("a") / size) if size else F.lit(0)).orderBy("a")
        new = s.withColumn("new", F.when(F.lag("z").over(w) + 1 == F.col("a"), 0).otherwise(1)).withColumn("part", F.floor(F.col("a") / size) if size else F.lit(0).cast("long"))
        runs = new.withColumn("id", F.sum("new").over(w)).groupBy("part", "id").agg(F.min("a").alias("a"), F.max("z").alias("z"))
        edge = (F.col("a") % size == 0) | ((F.col("z") + 1) % size == 0) if size else F.lit(False)
        ended = runs.where(~edge).select("a", "z")
        done, s = ended if done is None else done.unionByName(ended), runs.where(edge).select("a", "z")
    return done.where("z > a").select(F.col("a").alias("first_frame"), (F.col("z") - F.col("a") + 1).alias("frames"))


@query(
    f"""
WITH {P}, B AS (SELECT clip_id, avg(l) AS left_dc, avg(r) AS right_dc, sqrt(avg((l * l + r * r) / 2)) AS rms, greatest(max(abs(l)), max(abs(r))) AS peak FROM P GROUP BY clip_id)
SELECT clip_id, round(left_dc, 6) + 0.0 AS left_dc, round(right_dc, 6) + 0.0 AS right_dc, round(rms, 6) AS rms, round(20 * log10(rms), 6) AS rms_dbfs, round(peak, 6) AS peak FROM B
"""
)
def stereo_stats(spark, d) -> DataFrame:
    m = groups(spark, d, 2).select("clip_id", A.channel_mean(X(), 2, 0).alias("l"), A.channel_mean(X(), 2, 1).alias("r"), A.rms(X()).alias("rms"), A.peak(X()).alias("peak"))
    return m.select("clip_id", tidy(F.col("l")).alias("left_dc"), tidy(F.col("r")).alias("right_dc"), tidy(F.col("rms")).alias("rms"), tidy(A.dbfs(F.col("rms"))).alias("rms_dbfs"), tidy(F.col("peak")).alias("peak"))


@query(
    f"""
WITH {S}, C AS (SELECT clip_id, i, CASE WHEN x * 4 >= 1 THEN 1 WHEN x * 4 <= -1 THEN -1 ELSE 0 END AS k FROM S),
G AS (SELECT clip_id, k, i - row_number() OVER (PARTITION BY clip_id, k ORDER BY i) AS run FROM C),
R AS (SELECT clip_id, count(*) AS len FROM G WHERE k <> 0 GROUP BY clip_id, k, run)
SELECT e.vec_id AS clip_id, coalesce(max(len), 0) >= 2 AS clipped, coalesce(max(len), 0) >= 3 AS clipped3 FROM embeddings e LEFT JOIN R ON R.clip_id = e.vec_id GROUP BY e.vec_id
"""
)
def clipped_clips(spark, d) -> DataFrame:
    loud = F.transform(X(), lambda x: x * 4)
    return clips(spark, d).select("clip_id", A.clipped(loud, 1, 2).alias("clipped"), A.clipped(loud, 1, 3).alias("clipped3"))


# ---- sample formats

_TO16 = "CASE WHEN {0} < 0 THEN round(greatest({0}, -1.0) * 32768) ELSE round(least({0}, 1.0) * 32767) END"
mapped("gain_pcm16", lambda s: A.to_pcm(A.gain(s, -6.0), PCM16), one(_TO16.format(f"(x * {A.amplitude(-6.0)!r})")))
mapped("pcm16_round_trip", lambda s: A.to_float(A.to_pcm(A.gain(s, 9.0), PCM16), PCM16), f"WITH {S}, Q AS (SELECT clip_id, i, {_TO16.format(f'(x * {A.amplitude(9.0)!r})')} AS q FROM S) " + sql_rows("CASE WHEN q < 0 THEN q / 32768.0 ELSE q / 32767.0 END", "Q"))
mapped("pcm24_to_pcm16", lambda s: A.to_pcm(A.to_float(A.to_pcm(s, PCM24), PCM24), PCM16), f"WITH {S}, Q AS (SELECT clip_id, i, CASE WHEN x < 0 THEN round(x * 8388608) / 8388608.0 ELSE round(x * 8388607) / 8388607.0 END AS q FROM S) " + sql_rows(_TO16.format("q"), "Q"))
mapped("pcm20_in_24", lambda s: A.to_pcm(s, PCM20), one("16 * CASE WHEN x < 0 THEN round(x * 524288) ELSE round(x * 524287) END"))

# ---- levels and places

mapped("gain", lambda s: A.gain(s, -6.0), one(f"x * {A.amplitude(-6.0)!r}"))
mapped("map_samples", lambda s: F.transform(s, lambda x: x * x * F.signum(x)), one("x * x * sign(x)"))
mapped("remove_dc_offset", lambda s: A.remove_dc(s, 1), one("x - avg(x) OVER (PARTITION BY clip_id)"))
mapped("soft_limit", lambda s: A.soft_limit(A.gain(s, 12.0), 0.5, 0.9, 1.5), f"WITH {S}, Q AS (SELECT clip_id, i, x * {A.amplitude(12.0)!r} AS q FROM S) " + sql_rows("CASE WHEN abs(q) <= 0.5 THEN q ELSE sign(q) * least(0.9, 0.5 + 0.4 * (1 - exp(-(abs(q) - 0.5) * 1.5 / 0.4))) END", "Q"))
for _mode in ("in", "out"):
    _away = "i" if _mode == "in" else "(n - i - 1)"
    _ratio = f"least(1.0, greatest(0.0, CASE WHEN {_away} < 24 THEN {_away} / 23.0 ELSE 1.0 END))"
    for _curve, _f in (("linear", "{0}"), ("exp", "({0} * {0})"), ("log", "log10(1 + 9 * {0})")):
        mapped(f"fade_{_mode}_{_curve}", lambda s, m=_mode, c=_curve: A.fade(s, 1, RATE, 0.003, m, c), one("x * " + _f.format(_ratio)))
_put("pan", lambda spark, d: rows(clips(spark, d), A.pan(X(), 0.3)), f"WITH {S} " + sql_rows(f"x * {A._power(0.3)[0]!r}", i="2 * i") + " UNION ALL " + sql_rows(f"x * {A._power(0.3)[1]!r}", i="2 * i + 1"))
stereo("balance", lambda s: A.balance(s, 0.4), f"l * {math.cos(0.4 * math.pi / 2)!r}", "r")
_c, _s = math.cos(0.5 * math.pi / 4), math.sin(0.5 * math.pi / 4)
stereo("stereo_rotate", lambda s: A.rotate(s, 0.5), f"l * {_c!r} - r * {_s!r}", f"l * {_s!r} + r * {_c!r}")
stereo("stereo_widener", lambda s: A.widen(s, 1.25), "(l + r) / 2 + (l - r) / 2 * 1.25", "(l + r) / 2 - (l - r) / 2 * 1.25")
_put("to_mono", lambda spark, d: rows(groups(spark, d, 2), A.channels_to(X(), 2, 1)), f"WITH {P} " + sql_rows("(l + r) / 2", "P", i="t"))
_put("to_stereo", lambda spark, d: rows(clips(spark, d), A.channels_to(X(), 1, 2)), f"WITH {S} " + sql_rows("x", i="2 * i") + " UNION ALL " + sql_rows("x", i="2 * i + 1"))
_G6 = f"{S}, G AS (SELECT clip_id // 6 AS g, i, " + ", ".join(f"max(CASE WHEN clip_id % 6 = {k} THEN x END) AS c{k}" for k in range(6)) + " FROM S GROUP BY 1, 2 HAVING count(*) = 6)"
_side = lambda a, b: f"c{a} + c2 * 0.707 + c3 * 0.5 + c{b} * 0.707"
_put("downmix_surround", lambda spark, d: rows(groups(spark, d, 6), A.channels_to(X(), 6, 2)), f"WITH {_G6} " + sql_rows(_side(0, 4), "G", "g AS clip_id", "2 * i") + " UNION ALL " + sql_rows(_side(1, 5), "G", "g AS clip_id", "2 * i + 1"))
_put("fold_channels", lambda spark, d: rows(groups(spark, d, 6), A.channels_to(X(), 6, 4)), f"WITH {_G6} " + " UNION ALL ".join(sql_rows(f"c{k} + (c4 + c5) / 4", "G", "g AS clip_id", f"4 * i + {k}") for k in range(4)))
_put("repeat_channels", lambda spark, d: rows(groups(spark, d, 2), A.channels_to(X(), 2, 5)), f"WITH {P} " + " UNION ALL ".join(sql_rows("lr"[k % 2], "P", i=f"5 * t + {k}") for k in range(5)))

# ---- ranges and sequences

mapped("trim", lambda s: A.trim(s, 1, 0.25), f"WITH {S}, E AS (SELECT clip_id, min(i) AS a, max(i) AS z FROM S WHERE abs(x) >= 0.25 GROUP BY clip_id) " + sql_rows("x", "S JOIN E USING (clip_id)", i="i - a", where="WHERE i BETWEEN a AND z"))
mapped("slice_frames", lambda s: A.slice_frames(s, 1, 8, 24), f"WITH {S} " + sql_rows("x", i="i - 8", where="WHERE i >= 8 AND i < 32"))
mapped("crop", lambda s: A.slice_frames(s, 1, 48, 40), f"WITH {S} " + sql_rows("x", i="i - 48", where="WHERE i >= 48"))
_put(
    "split",
    lambda spark, d: rows(clips(spark, d).select("clip_id", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), s.alias("s")) for k, s in enumerate((A.slice_frames(X(), 1, 0, 20), A.slice_frames(X(), 1, 20, 1000)))])).alias("p")).select("clip_id", "p.part", "p.s"), F.col("s"), "clip_id", "part"),
    f"WITH {S} " + sql_rows("x", keys="clip_id, CASE WHEN i < 20 THEN 0 ELSE 1 END AS part", i="CASE WHEN i < 20 THEN i ELSE i - 20 END"),
)
mapped("reverse", lambda s: A.reverse(s, 1), one("x").replace("CAST(i AS INTEGER)", "CAST(n - 1 - i AS INTEGER)"))
stereo("reverse_stereo", lambda s: A.reverse(s, 2), "l", "r")
ORACLES["reverse_stereo"] = ORACLES["reverse_stereo"].replace("CAST(2 * t", "CAST(2 * (n - 1 - t)")
mapped("repeat", lambda s: A.repeat(s, 3), f"WITH {S} " + " UNION ALL ".join(sql_rows("x", i=f"i + {k} * n") for k in range(3)))
mapped("pad", lambda s: A.pad(s, 1, 5, 3), f"WITH {S} " + sql_rows("x", i="i + 5") + " UNION ALL " + sql_rows("0.0", "S, range(8) r(k)", i="CASE WHEN k < 5 THEN k ELSE n + k END", where="WHERE i = 0"))
mapped("insert_silence", lambda s: A.insert_silence(s, 1, 10, 4), f"WITH {S} " + sql_rows("x", i="CASE WHEN i < 10 THEN i ELSE i + 4 END") + " UNION ALL " + sql_rows("0.0", "S, range(4) r(k)", i="10 + k", where="WHERE i = 0"))
_PAIR = f"{S}, A AS (SELECT clip_id // 2 AS clip_id, i, x, n FROM S WHERE clip_id % 2 = 0), B AS (SELECT clip_id // 2 AS clip_id, i, x, n FROM S WHERE clip_id % 2 = 1)"
_put("concat", lambda spark, d: rows(pairs(spark, d), F.concat("a", "b")), f"WITH {_PAIR} " + sql_rows("x", "A") + " UNION ALL " + sql_rows("x", "B", i="64 + i"))
_put(
    "overlay",
    lambda spark, d: rows(pairs(spark, d), A.add(F.col("a"), F.col("b"), 40)),
    f"WITH {_PAIR}, U AS (SELECT clip_id, i, x FROM A UNION ALL SELECT clip_id, i + 40, x FROM B) SELECT clip_id, CAST(i AS INTEGER) AS i, round(sum(x), 6) + 0.0 AS y FROM U GROUP BY clip_id, i",
)
_put(
    "crossfade",
    lambda spark, d: rows(pairs(spark, d), A.crossfade(F.col("a"), F.col("b"), 1, RATE, 0.002)),
    f"WITH {_PAIR}, U AS (SELECT clip_id, i, CASE WHEN i < 48 THEN x ELSE x * (63 - i) / 15.0 END AS x FROM A UNION ALL SELECT clip_id, i + 48, CASE WHEN i < 16 THEN x * i / 15.0 ELSE x END FROM B) "
    "SELECT clip_id, CAST(i AS INTEGER) AS i, round(CASE WHEN i BETWEEN 48 AND 63 THEN least(1.0, greatest(-1.0, sum(x))) ELSE sum(x) END, 6) + 0.0 AS y FROM U GROUP BY clip_id, i",
)

# ---- mixing: sums by position, after partial aggregation


def mixed(df: DataFrame, key: str, samples: str = "samples", shift: str | None = None) -> DataFrame:
    """(key, i, x): the sum over clips at each position."""
    at = F.posexplode(samples).alias("i", "v")
    wide = df.select(key, *([shift] if shift else []), at)
    return wide.groupBy(key, (F.col("i") + (F.col(shift) if shift else 0)).alias("i")).agg(F.sum("v").alias("x"))


def strategy(m: DataFrame, key: str, how: str, smoothing: int = 40) -> DataFrame:
    """What a mix does about sums above full scale. Windows run within one mix."""
    whole = Window.partitionBy(key)
    x = F.col("x")
    if how == "clip":
        return m.withColumn("x", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    if how == "normalize":
        top = F.max(F.abs(x)).over(whole)
        return m.withColumn("x", F.when(top > 1, x / top).otherwise(x))
    if how == "soft_limit":
        over = 0.8 + 0.2 * (1.0 - F.exp(-(F.abs(x) - 0.8) / 0.2))
        return m.withColumn("x", F.when(F.abs(x) <= 0.8, x).otherwise(F.signum(x) * over))
    if how == "headroom":
        # A gain may rise by one step a frame at most, seen from either side: running minima of the gain against a ramp.
        step, order = 1.0 / smoothing, Window.partitionBy(key).orderBy("i")
        g = F.when(F.abs(x) > 1, 1.0 / F.abs(x)).otherwise(1.0)
        m = m.withColumn("g", g).withColumn("g", F.min(F.col("g") - F.col("i") * step).over(order) + F.col("i") * step)
        m = m.withColumn("g", F.min(F.col("g") + F.col("i") * step).over(order.rowsBetween(0, Window.unboundedFollowing)) - F.col("i") * step)
        return m.withColumn("x", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.col("g")))).drop("g")
    return m


_M = f"{S}, M AS (SELECT e.label, S.i, sum(S.x) AS x FROM S JOIN embeddings e ON e.vec_id = S.clip_id GROUP BY e.label, S.i)"
for _how, _y in (
    ("none", "x"),
    ("clip", "least(1.0, greatest(-1.0, x))"),
    ("normalize", "CASE WHEN max(abs(x)) OVER (PARTITION BY label) > 1 THEN x / max(abs(x)) OVER (PARTITION BY label) ELSE x END"),
    ("soft_limit", "CASE WHEN abs(x) <= 0.8 THEN x ELSE sign(x) * (0.8 + 0.2 * (1 - exp(-(abs(x) - 0.8) / 0.2))) END"),
):
    _put(f"mix_{_how}", lambda spark, d, h=_how: strategy(mixed(clips(spark, d), "label"), "label", h).select("label", "i", tidy(F.col("x")).alias("y")), f"WITH {_M} " + sql_rows(_y, "M", "label"))
# The loop over frames that the two running minima stand for.
_put(
    "mix_headroom",
    lambda spark, d: strategy(mixed(clips(spark, d), "label"), "label", "headroom").select("label", "i", tidy(F.col("x")).alias("y")),
    f"""WITH RECURSIVE {_M}, T AS (SELECT label, i, x, CASE WHEN abs(x) > 1 THEN 1 / abs(x) ELSE 1.0 END AS g FROM M),
U(label, i, g) AS (SELECT label, i, g FROM T WHERE i = 0 UNION ALL SELECT t.label, t.i, least(t.g, u.g + 0.025) FROM U u JOIN T t ON t.label = u.label AND t.i = u.i + 1),
V(label, i, g) AS (SELECT label, i, g FROM U WHERE i = 63 UNION ALL SELECT u.label, u.i, least(u.g, v.g + 0.025) FROM V v JOIN U u ON u.label = v.label AND u.i = v.i - 1)
SELECT label, CAST(M.i AS INTEGER) AS i, round(least(1.0, greatest(-1.0, M.x * V.g)), 6) + 0.0 AS y FROM M JOIN V USING (label, i)""",
)


def _aligned(spark, d, where: str) -> DataFrame:
    """Clips of different lengths: the one of id k keeps 16 + 8 (k mod 5) frames."""
    c = clips(spark, d).select("label", A.slice_frames(X(), 1, 0, (16 + 8 * (F.col("clip_id") % 5)).cast("int")).alias("samples")).withColumn("n", F.size("samples"))
    most = c.groupBy("label").agg(F.max("n").alias("most"))
    shift = {"start": F.lit(0), "center": F.round((F.col("most") - F.col("n")) / 2.0).cast("int"), "end": F.col("most") - F.col("n")}[where]
    return mixed(c.join(F.broadcast(most), "label").withColumn("shift", shift), "label", shift="shift").select("label", "i", tidy(F.col("x")).alias("y"))


for _where, _shift in (("start", "0"), ("center", "round((most - m) / 2.0)"), ("end", "most - m")):
    _put(
        f"mix_align_{_where}",
        lambda spark, d, w=_where: _aligned(spark, d, w),
        f"WITH {S}, C AS (SELECT e.label, S.i, S.x, 16 + 8 * (S.clip_id % 5) AS m, max(16 + 8 * (S.clip_id % 5)) OVER (PARTITION BY e.label) AS most FROM S JOIN embeddings e ON e.vec_id = S.clip_id) "
        f"SELECT label, CAST(i + {_shift} AS INTEGER) AS i, round(sum(x), 6) + 0.0 AS y FROM C WHERE i < m GROUP BY label, CAST(i + {_shift} AS INTEGER)",
    )
_put(
    "mix_gains",
    lambda spark, d: rows(pairs(spark, d), A.add(A.gain(F.col("a"), -3.0), A.gain(F.col("b"), -9.0))),
    f"WITH {_PAIR} SELECT A.clip_id, A.i, round(A.x * {A.amplitude(-3.0)!r} + B.x * {A.amplitude(-9.0)!r}, 6) + 0.0 AS y FROM A JOIN B USING (clip_id, i)",
)

# ---- frames, envelopes with their tails

stereo("map_frames", lambda s: A.map_frames(s, 2, lambda p: F.array(p[1] * 0.5, p[0] - p[1])), "r * 0.5", "l - r")
# 64 frames are 8 ms; note off at 6 ms, and 5 ms of release after it: 88 frames, the last sample held on.
_tailed = f"WITH {S}, E AS (SELECT S.clip_id, t AS i, S.x, t / {RATE}.0 AS s FROM range(88) r(t) JOIN S ON S.i = least(t, 63))"
mapped(
    "envelope_tail", lambda s: A.render_with_tail(s, 1, RATE, 0.006, attack=0.001, decay=0.002, sustain=0.5, release=0.005),
    f"{_tailed} SELECT clip_id, CAST(i AS INTEGER) AS i, round(x * CASE WHEN s < 0.001 THEN s / 0.001 WHEN s < 0.003 THEN 1 - 0.5 * (s - 0.001) / 0.002 WHEN s < 0.006 THEN 0.5 ELSE 0.5 * (1 - least(1.0, (s - 0.006) / 0.005)) END, 6) + 0.0 AS y FROM E",
)

# ---- normalizing, rates

mapped("normalize_peak", lambda s: A.normalize(s, A.amplitude(-1.0), A.peak), one(f"x * {A.amplitude(-1.0)!r} / max(abs(x)) OVER (PARTITION BY clip_id)"))
mapped("normalize_rms", lambda s: A.normalize(s, A.amplitude(-18.0), A.rms), one(f"x * {A.amplitude(-18.0)!r} / sqrt(avg(x * x) OVER (PARTITION BY clip_id))"))


def _resampled(target: int) -> str:
    n = f"CAST(round(64 * {target}.0 / {RATE}) AS INTEGER)"
    return f"""WITH {S}, K AS (SELECT DISTINCT clip_id FROM S), T AS (SELECT clip_id, t, t * {RATE}.0 / {target} AS place FROM K, range({n}) r(t))
SELECT T.clip_id, CAST(t AS INTEGER) AS i, round(a.x + (b.x - a.x) * (place - floor(place)), 6) + 0.0 AS y
FROM T JOIN S a ON a.clip_id = T.clip_id AND a.i = floor(place) JOIN S b ON b.clip_id = T.clip_id AND b.i = least(floor(place) + 1, 63)"""


mapped("resample_linear_up", lambda s: A.resample_linear(s, 1, RATE, 12_000), _resampled(12_000).replace("r(t))", "r(t))"))
mapped("resample_linear_down", lambda s: A.resample_linear(s, 1, RATE * 3 // 2, RATE), _resampled(RATE).replace("64 * 8000.0 / 8000", "64 * 8000.0 / 12000").replace("t * 8000.0 / 8000", "t * 12000.0 / 8000"))


def _sinc(target: int) -> str:
    cut = min(1.0, target / RATE)
    radius = min(max(math.ceil(8 / cut), 8), 64)
    n = f"CAST(round(64 * {target}.0 / {RATE}) AS INTEGER)"
    return f"""WITH {S}, K AS (SELECT DISTINCT clip_id FROM S), T AS (SELECT clip_id, t, t * {RATE}.0 / {target} AS place FROM K, range({n}) r(t)),
W AS (SELECT T.clip_id, t, S.x, place - S.i AS d FROM T JOIN S ON S.clip_id = T.clip_id AND S.i BETWEEN floor(place) - {radius} + 1 AND floor(place) + {radius}),
V AS (SELECT clip_id, t, x, {cut!r} * CASE WHEN abs(d * {cut!r}) < 1e-12 THEN 1.0 ELSE sin(pi() * d * {cut!r}) / (pi() * d * {cut!r}) END * CASE WHEN abs(d) / {radius} > 1 THEN 0.0 ELSE 0.5 + 0.5 * cos(pi() * abs(d) / {radius}) END AS w FROM W)
SELECT clip_id, CAST(t AS INTEGER) AS i, round(sum(x * w) / sum(w), 6) + 0.0 AS y FROM V GROUP BY clip_id, t"""


mapped("resample_sinc_up", lambda s: T.resample_sinc(s, MONO, 12_000), _sinc(12_000))
mapped("resample_sinc_down", lambda s: T.resample_sinc(s, Format(1, 12_000), 8_000), _sinc(RATE).replace(f"64 * {RATE}.0 / {RATE}", f"64 * {RATE}.0 / 12000").replace(f"t * {RATE}.0 / {RATE}", f"t * 12000.0 / {RATE}").replace("BETWEEN floor(place) - 8 + 1 AND floor(place) + 8", "BETWEEN floor(place) - 12 + 1 AND floor(place) + 12").replace("1.0 * CASE", "0.6666666666666666 * CASE").replace("d * 1.0", "d * 0.6666666666666666").replace("/ 8", "/ 12").replace("12000.0 / 12000", "12000.0 / 8000").replace("8000.0 / 12000)", "8000.0 / 12000)"))


@query(
    f"""
WITH {S}, T AS (SELECT clip_id, i, k, i + k / 4.0 AS place FROM S, range(1, 4) r(k) WHERE i < n - 1),
W AS (SELECT T.clip_id, T.i, T.k, S.x, place - S.i AS d FROM T JOIN S ON S.clip_id = T.clip_id AND S.i BETWEEN T.i - 7 AND T.i + 8),
V AS (SELECT clip_id, i, k, x, sin(pi() * d) / (pi() * d) * 0.5 * (1 + cos(pi() * d / 8)) AS w FROM W WHERE abs(d) < 8),
B AS (SELECT clip_id, abs(sum(x * w) / sum(w)) AS p FROM V GROUP BY clip_id, i, k UNION ALL SELECT clip_id, abs(x) FROM S)
SELECT clip_id, round(max(p), 6) AS true_peak FROM B GROUP BY clip_id
"""
)
def true_peak(spark, d) -> DataFrame:
    return clips(spark, d).select("clip_id", tidy(T.true_peak(X(), MONO)).alias("true_peak"))


# ---- generators: one row a frame, from the frame's number alone


def generated(name: str, value, sql: str, frames: int = 4000, digits: int = 6) -> None:
    def f(spark, d):
        return spark.range(frames).select(F.col("id").alias("frame"), tidy(value(F.col("id")), digits).alias("y"))

    _put(name, f, f"WITH G AS (SELECT CAST(t AS BIGINT) AS frame, CAST(t AS DOUBLE) AS t FROM range({frames}) r(t)) {sql}")


_PH = "(t * (440.0 / 8000) - floor(t * (440.0 / 8000)))"
_ST = 440.0 / 8000


def _blep_sql(p: str, step: float) -> str:
    return f"(CASE WHEN {p} < {step!r} THEN 2 * ({p} / {step!r}) - ({p} / {step!r}) * ({p} / {step!r}) - 1 WHEN {p} > 1 - {step!r} THEN (({p} - 1) / {step!r}) * (({p} - 1) / {step!r}) + 2 * (({p} - 1) / {step!r}) + 1 ELSE 0 END)"


def _osc(y: str) -> str:
    return f", H AS (SELECT frame, t, {_PH} AS p FROM G) SELECT frame, round({y}, 6) + 0.0 AS y FROM H"


_SINE = "(sin(2 * pi() * floor(p * 2048) / 2048) + (sin(2 * pi() * (floor(p * 2048) + 1) / 2048) - sin(2 * pi() * floor(p * 2048) / 2048)) * (p * 2048 - floor(p * 2048)))"
generated("osc_sine", lambda t: A.oscillator(t, RATE, "sine", 440.0, 0.7), _osc(f"{_SINE} * 0.7"))
generated("osc_sawtooth", lambda t: A.oscillator(t, RATE, "sawtooth", 440.0, 0.7), _osc(f"least(1.0, greatest(-1.0, 0.7 * (2 * p - 1 - {_blep_sql('p', _ST)})))"))
_Q = "(p - {0} - floor(p - {0}))"
for _name, _w in (("square", 0.5), ("pulse", 0.3)):
    generated(f"osc_{_name}", lambda t, n=_name: A.oscillator(t, RATE, n, 440.0, 0.7, width=0.3), _osc(f"least(1.0, greatest(-1.0, 0.7 * (CASE WHEN p < {_w} THEN 1.0 ELSE -1.0 END + {_blep_sql('p', _ST)} - {_blep_sql(_Q.format(_w), _ST)})))"))
_tri = lambda k: "(" + " + ".join(f"cos(2 * pi() * {h} * ({k} / 2048.0)) / {h * h}.0" for h in range(1, 10, 2)) + ") * (8 / (pi() * pi()))"
generated("osc_triangle", lambda t: A.oscillator(t, RATE, "triangle", 440.0, 0.7), _osc(f"least(1.0, greatest(-1.0, 0.7 * ({_tri('floor(p * 2048)')} + ({_tri('(floor(p * 2048) + 1)')} - {_tri('floor(p * 2048)')}) * (p * 2048 - floor(p * 2048)))))"))
_voices = [440.0 * 2.0 ** ((v - 1.0) * 12.0 / 1200.0) for v in range(3)]
generated(
    "osc_unison", lambda t: A.oscillator(t, RATE, "sawtooth", 440.0, 0.8, detune=12.0, unison=3),
    "SELECT frame, round(least(1.0, greatest(-1.0, 0.8 * (" + " + ".join(f"(2 * (t * {f / RATE!r} - floor(t * {f / RATE!r})) - 1 - {_blep_sql(f'(t * {f / RATE!r} - floor(t * {f / RATE!r}))', f / RATE)})" for f in _voices) + ") / 3)), 6) + 0.0 AS y FROM G",
)
_LP = "(0.25 + t * (5.0 / 8000) - floor(0.25 + t * (5.0 / 8000)))"
for _w, _y in (("sine", f"sin(2 * pi() * {_LP})"), ("triangle", f"1 - 4 * abs({_LP} - 0.5)"), ("square", f"CASE WHEN {_LP} < 0.5 THEN 1.0 ELSE -1.0 END"), ("sawtooth", f"2 * {_LP} - 1")):
    generated(f"lfo_{_w}", lambda t, w=_w: A.lfo(t, RATE, 5.0, w, 0.25), f"SELECT frame, round({_y}, 6) + 0.0 AS y FROM G", digits=6)
_env = "CASE WHEN u < 0.05 THEN c(u / 0.05) WHEN u < 0.07 THEN 1.0 WHEN u < 0.17 THEN 1 - 0.4 * c((u - 0.07) / 0.1) ELSE 0.6 END"
for _curve, _f in (("linear", "{0}"), ("exp", "({0}) * ({0})"), ("log", "log10(1 + 9 * ({0}))")):
    _g = lambda v, f=_f: f.format(f"least(1.0, greatest(0.0, {v}))")
    _hold = f"CASE WHEN u < 0.05 THEN {_g('u / 0.05')} WHEN u < 0.05 + 0.02 THEN 1.0 WHEN u < 0.05 + 0.02 + 0.1 THEN 1 - (1 - 0.6) * {_g('(u - 0.05 - 0.02) / 0.1')} ELSE 0.6 END"
    generated(
        f"envelope_{_curve}", lambda t, c=_curve: A.envelope(t / float(RATE), 0.3, 0.05, 0.1, 0.6, 0.15, 0.02, c),
        f", H AS (SELECT frame, t / 8000 AS u FROM G) SELECT frame, round(CASE WHEN u < 0.3 THEN {_hold} ELSE 0.6 * (1 - {_g('(u - 0.3) / 0.15')}) END, 12) + 0.0 AS y FROM H", digits=12,
    )
_POINTS = [(0.05, -12.0), (0.2, 0.0), (0.2, -3.0), (0.4, -20.0)]
generated(
    "automation", lambda t: A.automation(t / float(RATE), _POINTS),
    ", H AS (SELECT frame, t / 8000 AS u FROM G) SELECT frame, round(CASE WHEN u <= 0.05 THEN -12.0 WHEN u >= 0.4 THEN -20.0 WHEN u <= 0.2 THEN -12.0 + 12.0 * ((u - 0.05) / (0.2 - 0.05)) ELSE -3.0 + (-17.0) * ((u - 0.2) / (0.4 - 0.2)) END, 6) + 0.0 AS y FROM H",
)


@query()
def noise(spark, d) -> DataFrame:
    """White noise by frame and channel, and pink noise of a seed."""
    white = spark.range(4000).select(F.lit("white").alias("kind"), F.col("id").cast("int").alias("i"), A.white_noise(F.col("id"), F.lit(0), 7, 0.5).alias("y"))
    pink = spark.range(1).select(F.posexplode(T.pink_noise(F.lit(4000), F.lit(7), 0.1)).alias("i", "y")).select(F.lit("pink").alias("kind"), "i", "y")
    return white.unionByName(pink)


# ---- effects in closed form

_tp = f"(2 * pi() * 5.0 / {RATE})"
mapped("tremolo", lambda s: A.tremolo(s, 1, RATE, 300.0, 0.5, 0.8), one("x * 0.2 + x * (1 - 0.5 * ((sin(i * (2 * pi() * 300.0 / 8000)) + 1) / 2)) * 0.8"))
_ang = "(sin(t * (2 * pi() * 200.0 / 8000)) * 0.7 + 1) * (pi() / 4)"
stereo("auto_pan", lambda s: A.auto_pan(s, RATE, 200.0, 0.7), f"l * cos({_ang})", f"r * sin({_ang})")
_cr = "(round((least(1.0, greatest(-1.0, {0})) + 1) / 2 * 15) / 15 * 2 - 1)"
mapped("bitcrusher", lambda s: A.bitcrush(s, 1, 4, 3, 0.75), f"WITH {S} SELECT a.clip_id, a.i, round(a.x * 0.25 + {_cr.format('b.x')} * 0.75, 6) + 0.0 AS y FROM S a JOIN S b ON b.clip_id = a.clip_id AND b.i = a.i // 3 * 3")


def _swept(base: int, depth: float, hz: float, mix: float, rate: int = RATE) -> str:
    return f"""WITH {S}, D AS (SELECT clip_id, i, x, {base} + {depth!r} * ((sin(2 * pi() * (i * {hz / rate!r})) + 1) / 2) AS d FROM S)
SELECT D.clip_id, D.i, round(D.x * {1 - mix!r} + (coalesce(a.x, 0) + (coalesce(b.x, 0) - coalesce(a.x, 0)) * (d - floor(d))) * {mix!r}, 6) + 0.0 AS y
FROM D LEFT JOIN S a ON a.clip_id = D.clip_id AND a.i = D.i - floor(d) - 1 LEFT JOIN S b ON b.clip_id = D.clip_id AND b.i = D.i - floor(d) - 2"""


# A rate of 1 kHz keeps the delays within clips of 64 frames.
mapped("chorus", lambda s: A.chorus(s, 1, 1000, 20.0, 0.5, 0.5), _swept(12, 1000 * 0.03 * 0.5 * 0.6, 20.0, 0.5, 1000))
mapped("vibrato", lambda s: A.vibrato(s, 1, 1000, 30.0, 0.5, 1.0), _swept(6, 1000 * 0.004 * 0.5, 30.0, 1.0, 1000))
