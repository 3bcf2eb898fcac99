"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, without a minus before zero."""
    return F.round(x, digits) + 0.0


def rows(df: DataFrame, out: Column, *keys: str, digits: int = 6) -> DataFrame:
    """An array column as rows (keys, i, y)."""
    ks = keys or ("clip_id",)
    return df.select(*ks, F.posexplode(out).alias("i", "y")).select(*ks, "i", tidy(F.col("y"), digits).alias("y"))


#: The clips, a row a sample.
S = "S AS (SELECT vec_id AS clip_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, len(embedding) AS n FROM embeddings)"
#: Pairs of clips as left and right, a row a frame.
P = f"{S}, P AS (SELECT a.clip_id // 2 AS clip_id, a.i AS t, a.n AS n, a.x AS l, b.x AS r FROM S a JOIN S b ON b.clip_id = a.clip_id + 1 AND b.i = a.i WHERE a.clip_id % 2 = 0)"


def sql_rows(y: str, source: str = "S", keys: str = "clip_id", i: str = "i", where: str = "", digits: int = 6) -> str:
    return f"SELECT {keys}, CAST({i} AS INTEGER) AS i, round({y}, {digits}) + 0.0 AS y FROM {source} {where}"


def sql_stereo(left: str, right: str, digits: int = 6) -> str:
    """Frames of P to interleaved rows."""
    return f"WITH {P} " + sql_rows(left, "P", i="2 * t", digits=digits) + " UNION ALL " + sql_rows(right, "P", i="2 * t + 1", digits=digits)


def recursion(state: dict[str, tuple[str, str]], y: str, source: str = S, table: str = "S", keys: str = "clip_id", digits: int = 6, let: str = "") -> str:
    """A recurrence over a clip: for each state name, its first value and its step.

    In a step, s.x is the sample and r.name the state before. ``y`` is told from the state after.
    """
    names = ", ".join(state)
    first = ", ".join(f"{a} AS {k}" for k, (a, _) in state.items())
    step = ", ".join(b for _, b in state.values())
    cast = f"{keys}, i, {names}"
    return f"""
WITH RECURSIVE {source}{", " + let if let else ""}, R({cast}) AS (
  SELECT {keys}, -1, {first} FROM {table} WHERE i = 0
  UNION ALL
  SELECT r.{keys}, s.i, {step} FROM R r JOIN {table} s ON s.{keys} = r.{keys} AND s.i = r.i + 1
)
SELECT {keys}, CAST(i AS INTEGER) AS i, round({y}, {digits}) + 0.0 AS y FROM R WHERE i >= 0
"""
