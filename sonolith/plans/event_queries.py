"""Queries over notation, events and songs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence as Q
from ..operators import song as G
from ..sources.tables import table
from .registry import query, tidy

CLOCK = Q.Clock(tempo=90.0)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("track", "kind", "bar", "step_index", tidy(F.col("start_time"), 9).alias("start_time"), tidy(F.col("duration"), 9).alias("duration"), "start_frame", "duration_frames")


def _sql(steps: str, bars: int, bar: str, rate: int = 8000) -> str:
    """Rows (track, kind, step, at, long) over bars; ``bar`` is the bar's length."""
    return f"""
WITH T(track, kind, step, at_, long) AS (VALUES {steps}), E AS (SELECT *, CAST(b AS INTEGER) AS bar, b * ({bar}) + at_ AS s FROM T, range({bars}) r(b))
SELECT track, kind, bar, CAST(step AS INTEGER) AS step_index, round(s, 9) AS start_time, round(long, 9) AS duration,
       CAST(round(round(s * {rate}, 6)) AS BIGINT) AS start_frame, CAST(round(round(long * {rate}, 6)) AS BIGINT) AS duration_frames FROM E
"""


_BAR = "4 * 60.0 / 90"
_hits = [0, 3, 6, 8, 11, 14]


@query(_sql(", ".join(f"('kick', 'trigger', {k}, {k} * {_BAR} / 16, {_BAR} / 16)" for k in _hits), 500, _BAR))
def pattern_events(spark, d) -> DataFrame:
    return _shown(Q.events(spark, [Q.Track("kick", pattern="x--x|--x-|x--x|--X-")], 500, CLOCK, 8000))


@query(
    "WITH T(step, k, n, v, p) AS (VALUES (0, 0, 3, 0.8, 0.5), (0, 1, 3, 0.8, 0.5), (0, 2, 3, 0.8, 0.5), (1, 0, 1, 0.4, 1.0), (3, 0, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)) "
    f"SELECT CAST(b AS INTEGER) AS bar, CAST(step AS INTEGER) AS step_index, CAST(k AS INTEGER) AS ratchet_index, CAST(n AS INTEGER) AS ratchet_count, CAST(v AS DOUBLE) AS velocity, CAST(p AS DOUBLE) AS probability, round(b * {_BAR} + step * {_BAR} / 4 + k * {_BAR} / 4 / n, 9) AS start_time FROM T, range(50) r(b)"
)
def ratchet_events(spark, d) -> DataFrame:
    e = Q.events(spark, [Q.Track("hat", pattern="x?50:3 x0.4 - X:2", pattern_resolution=4)], 50, CLOCK, 8000)
    return e.select("bar", "step_index", "ratchet_index", "ratchet_count", "velocity", "probability", tidy(F.col("start_time"), 9).alias("start_time"))


_swing = lambda k: f"({k // 2 * 2} * {_BAR} / 8 + {k % 2} * 2 * {_BAR} / 8 * 0.6)"


@query(_sql(", ".join(f"('hat', 'trigger', {k}, {_swing(k)}, 2 * {_BAR} / 8 * {0.4 if k % 2 else 0.6})" for k in range(8)), 100, _BAR))
def swing_events(spark, d) -> DataFrame:
    return _shown(Q.events(spark, [Q.Track("hat", pattern="xxxxxxxx", pattern_resolution=8)], 100, Q.Clock(90.0, 4, 0.6), 8000))


@query(
    _sql(
        f"('lead', 'note', 0, 0.0, {_BAR} / 8 + {_BAR} / 8), ('lead', 'note', 2, 2 * {_BAR} / 8, {_BAR} / 8 * 1.5), ('lead', 'note', 4, 4 * {_BAR} / 8, {_BAR} / 8 * 0.6666666666666666), ('lead', 'note', 5, 5 * {_BAR} / 8, {_BAR} / 8)", 200, _BAR
    )
)
def note_events(spark, d) -> DataFrame:
    return _shown(Q.events(spark, [Q.Track("lead", notes="C4~ C4 E4/8. . G4/8t 61")], 200, CLOCK, 8000))


@query(
    "WITH C(k, chord, notes) AS (VALUES (0, 'Cm7', '48,51,55,58'), (1, 'Fmaj7', '53,57,60,64'), (2, 'G7/B', '47,55,62,65'), (3, 'Cmaj7@open', '48,55,64,71'), (4, 'Am7@drop2', '52,57,60,67')) "
    f"SELECT CAST(b AS INTEGER) AS bar, chord, notes, round(b * {_BAR}, 9) AS start_time FROM C, range(100) r(b) WHERE b % 5 = k"
)
def chord_events(spark, d) -> DataFrame:
    e = Q.events(spark, [Q.Track("pad", chords="Cm7 Fmaj7 G7/B Cmaj7@open Am7@drop2", octave=3)], 100, CLOCK, 8000)
    return e.select("bar", "chord", F.concat_ws(",", F.col("midi_notes").cast("array<string>")).alias("notes"), tidy(F.col("start_time"), 9).alias("start_time"))


@query(
    """
WITH N AS (SELECT p_partkey, 36 + p_size AS m FROM part), K(s) AS (VALUES (0), (2), (3), (5), (7), (8), (10)),
C AS (SELECT p_partkey, m, CAST(floor(m / 12.0) * 12 + s + 12 * o AS INTEGER) AS c FROM N, K, range(-1, 2) r(o)),
R AS (SELECT p_partkey, m, c, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(c - m), c) AS k FROM C)
SELECT p_partkey, CAST(m AS INTEGER) AS midi, c AS quantized FROM R WHERE k = 1
"""
)
def quantize_scale(spark, d) -> DataFrame:
    m = (F.col("p_size") + 36).cast("int")
    return table(spark, d, "part").select("p_partkey", m.alias("midi"), Q.in_scale(m, 0, "minor").alias("quantized"))


_SECTIONS = [Q.Section("intro", 2, ("kick",), markers=(("start", 0.0),)), Q.Section("verse", 4, ("kick", "lead"), repeat=2, tempo=120.0), Q.Section("end", 1, ("lead",), beats_per_bar=3)]


@query(
    """
WITH X(section, k, bars, t0, b0, bar, tempo) AS (VALUES ('intro', 0, 2, 0.0, 0, 8 / 3.0, 90), ('verse', 1, 4, 16 / 3.0, 2, 2.0, 120), ('verse_2', 2, 4, 16 / 3.0 + 8, 6, 2.0, 120), ('end', 3, 1, 16 / 3.0 + 16, 10, 2.0, 90)),
T(section, track, kind, step, at_) AS (VALUES ('intro', 'kick', 'trigger', 0, 0.0), ('intro', 'kick', 'trigger', 2, 0.5), ('verse', 'kick', 'trigger', 0, 0.0), ('verse', 'kick', 'trigger', 2, 0.5), ('verse', 'lead', 'note', 0, 0.0), ('verse', 'lead', 'note', 1, 0.125),
 ('verse_2', 'kick', 'trigger', 0, 0.0), ('verse_2', 'kick', 'trigger', 2, 0.5), ('verse_2', 'lead', 'note', 0, 0.0), ('verse_2', 'lead', 'note', 1, 0.125), ('end', 'lead', 'note', 0, 0.0), ('end', 'lead', 'note', 1, 0.125)),
E AS (SELECT section, track, kind, CAST(b0 + b AS INTEGER) AS bar, CAST(step AS INTEGER) AS step_index, round(t0 + b * X.bar + at_ * X.bar, 9) AS start_time FROM X JOIN T USING (section), range(4) r(b) WHERE b < bars)
SELECT * FROM E UNION ALL SELECT 'intro', 'arrangement', 'marker', 0, NULL, 0.0
"""
)
def arrangement_events(spark, d) -> DataFrame:
    tracks = [Q.Track("kick", pattern="x-x-", pattern_resolution=4), Q.Track("lead", notes="C4 E4")]
    e = Q.events(spark, tracks, _SECTIONS, CLOCK, 8000)
    return e.select("section", "track", "kind", "bar", "step_index", tidy(F.col("start_time"), 9).alias("start_time"))


def _saw(hz: str) -> str:
    step = f"({hz} / 8000)"
    p = f"(t * {step} - floor(t * {step}))"
    blep = f"(CASE WHEN {p} < {step} THEN 2 * ({p} / {step}) - ({p} / {step}) * ({p} / {step}) - 1 WHEN {p} > 1 - {step} THEN (({p} - 1) / {step}) * (({p} - 1) / {step}) + 2 * (({p} - 1) / {step}) + 1 ELSE 0 END)"
    return f"(2 * {p} - 1 - {blep})"


@query(
    f"""
WITH N(bar, step, long, midi, n) AS (SELECT b, s, 0.5, m, 1 FROM range(4) r(b), (VALUES (0, 60), (1, 64), (2, 67)) v(s, m) UNION ALL SELECT b, 0, 2.0, m, 3 FROM range(4) r(b), (VALUES (60), (64), (67)) v(m) WHERE b % 2 = 0 UNION ALL SELECT b, 0, 2.0, m, 3 FROM range(4) r(b), (VALUES (69), (72), (76)) v(m) WHERE b % 2 = 1),
F AS (SELECT bar * 16000 + CASE WHEN n = 1 THEN step * 4000 ELSE 0 END + t AS frame, t, n, least(1.0, greatest(-1.0, 0.3 * {_saw('(440.0 * power(2.0, (midi - 69) / 12.0))')})) / n AS y,
 CASE WHEN n = 3 THEN CASE WHEN t / 8000.0 < 2.0 THEN least(1.0, t / 8000.0 / 0.1) ELSE 1 - least(1.0, (t / 8000.0 - 2.0) / 0.25) END ELSE 1.0 END AS e
 FROM N, range(18000) r(t) WHERE t < CASE WHEN n = 1 THEN 4000 ELSE 18000 END),
G AS (SELECT CAST(frame AS BIGINT) AS frame, sum(CASE WHEN n = 1 THEN y * power(10, -6 / 20.0) ELSE y * e * cos(0.5 * pi() / 2) END) AS l, sum(CASE WHEN n = 1 THEN y * power(10, -6 / 20.0) ELSE y * e END) AS r FROM F GROUP BY frame)
SELECT frame, round(l, 6) + 0.0 AS l, round(r, 6) + 0.0 AS r FROM G
"""
)
def render_song(spark, d) -> DataFrame:
    from ..model import Format

    song = G.Song(
        [Q.Track("lead", notes="C4 E4 G4", note_resolution=4, waveform="sawtooth", level=0.3, gain_db=-6.0), Q.Track("pad", chords="C Am", waveform="sawtooth", level=0.3, pan=0.5, envelope={"attack": 0.1, "decay": 0.0, "sustain": 1.0, "release": 0.25})],
        bars=4, clock=Q.Clock(120.0), format=Format(2, 8000),
    )
    return song.frames(spark).select("frame", tidy(F.col("l")).alias("l"), tidy(F.col("r")).alias("r"))
