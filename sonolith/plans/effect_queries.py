"""Queries over processors with memory, against recurrences in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Format
from ..operators import kernels as K
from ..operators import stateful as T
from ..sources.tables import MONO, RATE, STEREO, clips, groups, last_clip, long_signal, loud_signal, pairs
from .registry import P, S, query, recursion, rows, tidy


def X() -> Column:
    return F.col("samples")


def effect(name: str, make, sql: str | None, tail: bool = False, fmt: Format = MONO) -> None:
    def f(spark, d):
        source = clips(spark, d) if fmt.channels == 1 else groups(spark, d, 2)
        return rows(source, T.apply(X(), fmt, make, tail))

    query(sql, name)(f)


# ---- linear filters


def _biquad_state(c: tuple[float, ...]) -> dict[str, tuple[str, str]]:
    b0, b1, b2, a1, a2 = (repr(v) for v in c)
    return {"x1": ("0.0::DOUBLE", "s.x"), "x2": ("0.0::DOUBLE", "r.x1"), "y1": ("0.0::DOUBLE", f"({b0}) * s.x + ({b1}) * r.x1 + ({b2}) * r.x2 - ({a1}) * r.y1 - ({a2}) * r.y2"), "y2": ("0.0::DOUBLE", "r.y1")}


for _kind, _args in (
    ("lowpass", {"cutoff": 1000.0}), ("highpass", {"cutoff": 300.0}), ("bandpass", {"cutoff": 1000.0, "bandwidth": 500.0}), ("notch", {"cutoff": 500.0}),
    ("peaking", {"cutoff": 1500.0, "gain_db": 4.0}), ("lowshelf", {"cutoff": 400.0, "gain_db": -5.0}), ("highshelf", {"cutoff": 2000.0, "gain_db": 6.0}),
):
    effect(f"filter_{_kind}", lambda k=_kind, a=_args: [K.Filter(k, **a)], recursion(_biquad_state(K.Filter(_kind, **_args).coefficients(RATE)[0]), "y1"))

_eq = K.EQ.simple(highpass=200.0, lowpass=3000.0, presence={"cutoff": 1000.0, "q": 0.8, "gain_db": 3.0})


def _cascade(cs, source: str = "s.x") -> dict[str, tuple[str, str]]:
    out, x = {}, source
    for j, c in enumerate(cs):
        b0, b1, b2, a1, a2 = (repr(v) for v in c)
        y = f"(({b0}) * {x} + ({b1}) * r.u{j} + ({b2}) * r.v{j} - ({a1}) * r.y{j} - ({a2}) * r.z{j})"
        out |= {f"u{j}": ("0.0::DOUBLE", x), f"v{j}": ("0.0::DOUBLE", f"r.u{j}"), f"y{j}": ("0.0::DOUBLE", y), f"z{j}": ("0.0::DOUBLE", f"r.y{j}")}
        x = y
    return out


effect("eq", lambda: [K.EQ.simple(highpass=200.0, lowpass=3000.0, presence={"cutoff": 1000.0, "q": 0.8, "gain_db": 3.0})], recursion(_cascade(_eq.coefficients(RATE)), "y2"))
effect(
    "delay", lambda: [K.Delay(10 / RATE, 0.5, 0.3)],
    f"WITH {S} SELECT a.clip_id, a.i, round(a.x * 0.7 + 0.3 * coalesce(sum(power(0.5, (a.i - b.i) / 10 - 1) * b.x), 0), 6) + 0.0 AS y FROM S a LEFT JOIN S b ON b.clip_id = a.clip_id AND b.i < a.i AND (a.i - b.i) % 10 = 0 GROUP BY a.clip_id, a.i, a.x",
)
_delay_tail = K.Delay(10 / RATE, 0.5, 0.3).tail(RATE)
effect(
    "delay_with_tail", lambda: [K.Delay(10 / RATE, 0.5, 0.3)],
    f"WITH {S}, L AS (SELECT DISTINCT clip_id, t AS i FROM S, range({64 + _delay_tail}) r(t)), E AS (SELECT L.clip_id, CAST(L.i AS INTEGER) AS i, coalesce(S.x, 0.0) AS x FROM L LEFT JOIN S ON S.clip_id = L.clip_id AND S.i = L.i) "
    "SELECT a.clip_id, a.i, round(a.x * 0.7 + 0.3 * coalesce(sum(power(0.5, (a.i - b.i) / 10 - 1) * b.x), 0), 6) + 0.0 AS y FROM E a LEFT JOIN S b ON b.clip_id = a.clip_id AND b.i < a.i AND (a.i - b.i) % 10 = 0 GROUP BY a.clip_id, a.i, a.x",
    tail=True,
)
_rc = 1.0 / (2.0 * math.pi * (500.0 + 0.3 * 7500.0))
_k = (1.0 / RATE) / (_rc + 1.0 / RATE)
effect("distortion", lambda: [K.Distortion(0.5, 0.3, 0.8)], recursion({"x": ("0.0::DOUBLE", "s.x"), "low": ("0.0::DOUBLE", f"r.low + {_k!r} * (tanh(s.x * 10.5) - r.low)")}, "x * (1 - 0.8) + low * 0.8"))

# ---- dynamics


def _decay(seconds: float) -> str:
    return repr(K.decay(seconds, RATE))


_ENV = f"r.env + (1 - CASE WHEN {{0}} > r.env THEN {_decay(0.001)} ELSE {_decay(0.004)} END) * ({{0}} - r.env)"


def _gain(env: str, knee: float) -> str:
    over = f"(20 * log10({env}) + 20)"
    hard = f"CASE WHEN {over} > 0 THEN {over} / 4 - {over} ELSE 0 END"
    if knee:
        hard = f"CASE WHEN {over} <= -{knee / 2} THEN 0 WHEN {over} >= {knee / 2} THEN {over} / 4 - {over} ELSE (1 / 4.0 - 1) * ({over} + {knee / 2}) * ({over} + {knee / 2}) / (2 * {knee}) END"
    return f"power(10, ((CASE WHEN {env} > 0 THEN {hard.replace('log10(env)', 'log10(greatest(env, 1e-300))')} ELSE 0 END) + 2) / 20)"


for _name, _knee in (("compressor", 0.0), ("compressor_knee", 6.0)):
    effect(_name, lambda k=_knee: [K.Compressor(-20.0, 4.0, 0.001, 0.004, 2.0, k)], recursion({"x": ("0.0::DOUBLE", "s.x"), "env": ("0.0::DOUBLE", _ENV.format("abs(s.x)"))}, f"x * {_gain('env', _knee)}"))
effect(
    "compressor_stereo", lambda: [K.Compressor(-20.0, 4.0, 0.001, 0.004, 2.0)],
    recursion({"l": ("0.0::DOUBLE", "s.l"), "q": ("0.0::DOUBLE", "s.r"), "env": ("0.0::DOUBLE", _ENV.format("greatest(abs(s.l), abs(s.r))"))}, "0", f"{P}, Q AS (SELECT clip_id, t AS i, l, r FROM P)", "Q").split("SELECT clip_id, CAST(i")[0]
    + " SELECT clip_id, CAST(2 * i AS INTEGER) AS i, round(l * " + _gain("env", 0.0) + ", 6) + 0.0 AS y FROM R WHERE i >= 0 UNION ALL SELECT clip_id, CAST(2 * i + 1 AS INTEGER), round(q * " + _gain("env", 0.0) + ", 6) + 0.0 FROM R WHERE i >= 0",
    fmt=STEREO,
)


def _sidechain(end: str, at: str) -> None:
    """Each even clip under the first 40 frames of the odd one beside it."""

    def f(spark, d):
        side = F.slice("b", 1, 40)
        return rows(pairs(spark, d), T.compress_beside(F.col("a"), side, MONO, end, threshold=-20.0, ratio=4.0, attack=0.001, release=0.004, makeup=2.0))

    pair = f"{S}, A AS (SELECT clip_id // 2 AS clip_id, i, x FROM S WHERE clip_id % 2 = 0), B AS (SELECT clip_id // 2 AS clip_id, i, abs(x) AS v FROM S WHERE clip_id % 2 = 1 AND i < 40), "
    pair += f"Q AS (SELECT A.clip_id, A.i, A.x, coalesce(B.v, 0.0) AS v FROM A LEFT JOIN B ON B.clip_id = A.clip_id AND B.i = {at})"
    query(recursion({"x": ("0.0::DOUBLE", "s.x"), "env": ("0.0::DOUBLE", _ENV.format("s.v"))}, f"x * {_gain('env', 0.0)}", pair, "Q"), f"sidechain_{end}")(f)


_sidechain("silence", "A.i")
_sidechain("hold", "least(A.i, 39)")
_sidechain("loop", "A.i % 40")

_FOLLOW = f"CASE WHEN abs(s.x) > r.env THEN abs(s.x) + {_decay(0.0005)} * (r.env - abs(s.x)) WHEN r.held > 0 THEN r.env ELSE abs(s.x) + {_decay(0.002)} * (r.env - abs(s.x)) END"
_HELD = "CASE WHEN abs(s.x) > r.env THEN 4 WHEN r.held > 0 THEN r.held - 1 ELSE r.held END"


def _toward(target: str) -> str:
    return f"({target}) + (CASE WHEN ({target}) > r.gain THEN {_decay(0.0005)} ELSE {_decay(0.002)} END) * (r.gain - ({target}))"


def _follower(target: str, first: float) -> dict[str, tuple[str, str]]:
    return {"x": ("0.0::DOUBLE", "s.x"), "env": ("0.0::DOUBLE", _FOLLOW), "held": ("0", _HELD), "gain": (f"{first!r}::DOUBLE", _toward(target.format(f"({_FOLLOW})")))}


_times = {"attack": 0.0005, "hold": 0.0005, "release": 0.002}
effect("noise_gate", lambda: [K.NoiseGate(-12.0, -60.0, **_times)], recursion(_follower(f"CASE WHEN {{0}} < {K.amplitude(-12.0)!r} THEN {K.amplitude(-60.0)!r} ELSE 1.0 END", K.amplitude(-60.0)), "x * gain"))
_below = "(-12 - 20 * log10(greatest({0}, 1e-300)))"
effect(
    "expander", lambda: [K.Expander(-12.0, 2.5, -60.0, **_times, gain_attack=0.0005, gain_release=0.002)],
    recursion(_follower(f"CASE WHEN {{0}} <= 0 OR {_below} <= 0 THEN 1.0 ELSE greatest(power(10, -{_below} * 1.5 / 20), {K.amplitude(-60.0)!r}) END", 1.0), "x * gain"),
)
# The limiter's gain follows the loudest of the frames ahead; the first ones warm it up while nothing is put out.
_c = repr(K.amplitude(-14.0))
_AHEAD = 8
_limit = f"""{S}, L AS (SELECT clip_id, i, abs(x) AS v, x FROM S UNION ALL SELECT DISTINCT clip_id, 64 + t, 0.0, 0.0 FROM S, range({_AHEAD}) r(t)),
W AS (SELECT clip_id, i, v, x, lag(x, {_AHEAD}) OVER w AS old, abs(lag(x, {_AHEAD}) OVER w) AS own, max(v) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN {_AHEAD - 1} PRECEDING AND CURRENT ROW) AS ahead FROM L WINDOW w AS (PARTITION BY clip_id ORDER BY i))"""
_target = f"(CASE WHEN s.ahead > {_c} THEN {_c} / s.ahead ELSE 1.0 END)"
query(
    recursion(
        {"old": ("0.0::DOUBLE", "s.old"), "own": ("0.0::DOUBLE", "s.own"), "gain": ("1.0::DOUBLE", f"{_target} + (CASE WHEN {_target} < r.gain THEN {_decay(0.0005)} ELSE {_decay(0.004)} END) * (r.gain - {_target})")},
        f"greatest(-{_c}, least({_c}, old * least(gain, CASE WHEN own > 0 THEN least({_c} / own, 1.0) ELSE 1.0 END)))", _limit, "W",
    ).replace("CAST(i AS INTEGER)", f"CAST(i - {_AHEAD} AS INTEGER)").replace("WHERE i >= 0", f"WHERE i >= {_AHEAD}"),
    "limiter",
)(lambda spark, d: rows(clips(spark, d), T.limit(X(), MONO, ceiling=-14.0, attack=0.0005, release=0.004, lookahead=_AHEAD / RATE)))

# ---- modulation with feedback: a delay line as a list in SQL
_w = "((sin(2 * pi() * (s.i * (200.0 / 8000))) + 1) / 2)"
_co = f"greatest(0.02, least(0.9, 0.08 + 0.82 * 0.7 * {_w}))"


def _phaser() -> dict[str, tuple[str, str]]:
    out, x = {"x": ("0.0::DOUBLE", "s.x")}, "(s.x + r.wet * 0.2)"
    for j in range(2):
        y = f"(r.z{j} - {_co} * {x})"
        out[f"z{j}"] = ("0.0::DOUBLE", f"{x} + {_co} * {y}")
        x = y
    return out | {"wet": ("0.0::DOUBLE", x)}


effect("phaser", lambda: [K.Phaser(200.0, 0.7, 0.2, 0.5, 2)], recursion(_phaser(), "x * 0.5 + wet * 0.5"))
_fd = "(12 + 25.2 * ((sin(2 * pi() * (s.i * (100.0 / 8000))) + 1) / 2))"
_read = lambda k: f"coalesce(r.line[CAST(s.i - floor({_fd}) - {k} + 1 AS BIGINT)], 0.0)"
_safe = lambda k: f"(CASE WHEN s.i - floor({_fd}) - {k} >= 0 THEN {_read(k)} ELSE 0.0 END)"
_wet = f"({_safe(1)} + ({_safe(2)} - {_safe(1)}) * ({_fd} - floor({_fd})))"
effect("flanger", lambda: [K.flanger(100.0, 0.7, 0.35, 0.5)], recursion({"x": ("0.0::DOUBLE", "s.x"), "wet": ("0.0::DOUBLE", _wet), "line": ("CAST([] AS DOUBLE[])", f"list_append(r.line, s.x + {_wet} * 0.35)")}, "x * 0.5 + wet * 0.5"))
effect("reverb", lambda: [K.Reverb(0.5, 0.5, 0.3)], None, tail=False)
effect("reverb_stereo_tail", lambda: [K.Reverb(0.1, 0.5, 0.3, 0.001, 0.6)], None, tail=True, fmt=STEREO)
effect("mastering_chain", K.mastering_chain, None, tail=True, fmt=STEREO)
effect("podcast_chain", K.podcast_chain, None, tail=True, fmt=STEREO)

# A chain is one call, and equals its parts one after another.
_lp = K.Filter("lowpass", 1000.0).coefficients(RATE)[0]


@query(recursion(_biquad_state(_lp) | {"env": ("0.0::DOUBLE", _ENV.format("abs(" + _biquad_state(_lp)["y1"][1] + ")"))}, f"y1 * {_gain('env', 0.0)}"))
def fused_chain(spark, d) -> DataFrame:
    from .planner import Clips

    made = Clips(clips(spark, d), MONO).effect(lambda: K.Filter("lowpass", 1000.0)).effect(lambda: K.Compressor(-20.0, 4.0, 0.001, 0.004, 2.0))
    return rows(made.df(tail=False), X())


# ---- loudness of a long clip
_KW = K.k_weighting(RATE)
_LOUD = f"O AS (SELECT 0::BIGINT AS clip_id, CAST(o_orderkey AS INTEGER) AS i, o_totalprice / 500000.0 * 2 - 1 AS x FROM orders)"  # noqa: F541


def _weigh(where: str = "") -> str:
    body = recursion(_cascade(_KW), "y1", _LOUD + (f", Q AS (SELECT clip_id, CAST(i - (SELECT max(i) FROM O) + {where} - 1 AS INTEGER) AS i, x FROM O WHERE i > (SELECT max(i) FROM O) - {where})" if where else ""), "Q" if where else "O", digits=15)
    return body.split("\nSELECT clip_id, CAST(i AS")[0] + ", Y AS (SELECT i, y1 AS y FROM R WHERE i >= 0)"


@query(
    _weigh()
    + """, B AS (SELECT s, avg(y * y) AS e FROM (SELECT CAST(k * 800 AS BIGINT) AS s FROM (SELECT unnest(range((SELECT max(i) // 800 + 1 FROM O))) AS k) r WHERE k * 800 <= greatest(0, (SELECT max(i) + 1 FROM Y) - 3200)) b JOIN Y ON Y.i >= s AND Y.i < s + 3200 GROUP BY s),
A AS (SELECT e FROM B WHERE -0.691 + 10 * log10(e) >= -70), G AS (SELECT -0.691 + 10 * log10(avg(e)) - 10 AS g FROM A)
SELECT round(-0.691 + 10 * log10(avg(e)), 6) AS lufs FROM A, G WHERE -0.691 + 10 * log10(e) >= g"""
)
def lufs_integrated(spark, d) -> DataFrame:
    from ..operators.blocked import integrated

    return integrated(loud_signal(spark, d), RATE, 16_384).select(tidy(F.col("lufs")).alias("lufs"))


for _name, _f, _n in (("lufs_momentary", T.momentary, 3200), ("lufs_short_term", T.short_term, 24000)):
    # A clip shorter than the window is measured whole.
    query(_weigh(f"least({_n}, (SELECT count(*) FROM O))") + " SELECT round(-0.691 + 10 * log10(avg(y * y)), 6) AS lufs FROM Y", _name)(lambda spark, d, f=_f, n=_n: last_clip(loud_signal(spark, d), n).select(tidy(f(X(), MONO)).alias("lufs")))


@query(
    _weigh()
    + """, B AS (SELECT s, avg(y * y) AS e FROM (SELECT CAST(k * 800 AS BIGINT) AS s FROM (SELECT unnest(range((SELECT max(i) // 800 + 1 FROM O))) AS k) r WHERE k * 800 <= greatest(0, (SELECT max(i) + 1 FROM Y) - 3200)) b JOIN Y ON Y.i >= s AND Y.i < s + 3200 GROUP BY s),
A AS (SELECT e FROM B WHERE -0.691 + 10 * log10(e) >= -70), G AS (SELECT -0.691 + 10 * log10(avg(e)) - 10 AS g FROM A),
L AS (SELECT -0.691 + 10 * log10(avg(e)) AS lufs FROM A, G WHERE -0.691 + 10 * log10(e) >= g)
SELECT i, round(x * power(10, (-14 - lufs) / 20), 6) + 0.0 AS y FROM O, L"""
)
def normalize_lufs(spark, d) -> DataFrame:
    """A signal of any length: its loudness is one number, which scales each frame."""
    from ..operators.blocked import integrated

    signal = loud_signal(spark, d)
    factor = integrated(signal, RATE, 16_384).select(F.pow(F.lit(10.0), (-14.0 - F.col("lufs")) / 20.0).alias("k"))
    return signal.select(F.col("frame").cast("int").alias("i"), tidy(F.col("x") * factor.scalar()).alias("y"))


# ---- streams in blocks


@query("SELECT CAST(o_orderkey // 4096 AS BIGINT) AS seq, CAST(count(*) AS BIGINT) AS n_frames, round(max(o_totalprice / 500000.0), 9) AS peak, round(sqrt(avg((o_totalprice / 500000.0) * (o_totalprice / 500000.0))), 6) AS rms FROM orders GROUP BY 1")
def meter_chunks(spark, d) -> DataFrame:
    s = long_signal(spark, d).withColumn("seq", F.floor(F.col("frame") / 4096))
    return s.groupBy("seq").agg(F.count(F.lit(1)).alias("n_frames"), tidy(F.max(F.abs("x")), 9).alias("peak"), tidy(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms"))


@query("WITH C AS (SELECT o_orderkey // 4096 AS seq, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(seq AS BIGINT) AS seq, CAST(sum(n) OVER (ORDER BY seq) AS BIGINT) AS frames, round(least(1.0, sum(n) OVER (ORDER BY seq) / (SELECT count(*) FROM orders)), 6) AS ratio FROM C")
def progress(spark, d) -> DataFrame:
    """Cumulative frames by chunk: the window runs over a row a chunk."""
    c = long_signal(spark, d).groupBy(F.floor(F.col("frame") / 4096).alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("seq")
    c = c.withColumn("frames", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return c.select("seq", "frames", tidy(F.least(F.lit(1.0), F.col("frames") / F.col("total"))).alias("ratio"))


@query("SELECT CAST(o_orderkey - 800 AS BIGINT) AS frame, round(o_totalprice / 500000.0, 9) AS y FROM orders WHERE o_orderkey >= 800 AND o_orderkey < 800 + 4000")
def take_drop_duration(spark, d) -> DataFrame:
    """0.1 s dropped, then 0.5 s taken: a range of frames that reaches the scan."""
    return long_signal(spark, d).where(F.col("frame").between(800, 4799)).select((F.col("frame") - 800).alias("frame"), tidy(F.col("x"), 9).alias("y"))


@query("SELECT CAST(count(DISTINCT o_orderkey // 4096) AS BIGINT) AS chunks, CAST(count(*) AS BIGINT) AS frames, round(count(*) / 8000.0, 6) AS duration FROM orders")
def dry_run(spark, d) -> DataFrame:
    return long_signal(spark, d).agg(F.countDistinct(F.floor(F.col("frame") / 4096)).alias("chunks"), F.count(F.lit(1)).alias("frames"), tidy(F.count(F.lit(1)) / float(RATE)).alias("duration"))


# ---- one very long signal: a filter in blocks
@query(recursion(_biquad_state(_lp), "y1", "O AS (SELECT 0::BIGINT AS clip_id, CAST(o_orderkey AS INTEGER) AS i, o_totalprice / 500000.0 AS x FROM orders)", "O").replace("SELECT clip_id, CAST(i AS INTEGER) AS i", "SELECT CAST(i AS BIGINT) AS frame"))
def blocked_filter(spark, d) -> DataFrame:
    from ..operators.blocked import filter_rows

    return filter_rows(long_signal(spark, d), _lp, block=4096).select("frame", tidy(F.col("y")).alias("y"))
