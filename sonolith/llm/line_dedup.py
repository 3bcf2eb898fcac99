"""Line dedup with DataFrame functions only.

Each line becomes a row of hashes, document and position. The hashes are range-partitioned and
sorted by hash, then document from the largest, then position; a window streams over each hash
and marks what is not in its first document. What returns to the documents is no text but a
compressed bitmap: the runs of dropped positions, made before the join; beside the text they
become the runs of kept lines.

Hot lines: a sample of the rows names the hashes with over 1/HOT_SHARE of the sample, or over HOT_ROWS rows by the
sample's share. They are counted by partial aggregation in place of the window, so that a window has
HOT_ROWS rows or so at most. The table of hot hashes is broadcast only if it has at most BROADCAST_ROWS rows. The
sample decides the route only; both routes see every row and give the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WHITE, stage, text_of

MIN_CHARS, MIN_DOCS = 20, 3
SAMPLED, HOT_SHARE, HOT_ROWS, BROADCAST_ROWS = 0.02, 2000, 100_000, 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Of columns doc_id and text: doc_id, text_hash and the runs (start, last) of dropped lines, for documents that lose any."""
    text = text_of("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(_lines(text)).alias("pos", "line"))
    rows = rows.select("doc_id", "th", "pos", F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER).alias("key")).where(F.char_length("key") >= min_chars)
    rows = stage(rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x9E3779B97F4A7C), "key").alias("h2"), "doc_id", "th", "pos"), "lines")

    sample = rows.sample(fraction=SAMPLED, seed=11)
    least = max(20, min(sample.count() // HOT_SHARE, int(HOT_ROWS * SAMPLED)))
    hot = stage(sample.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("h1", "h2"), "hot")
    few = F.broadcast if hot.count() <= BROADCAST_ROWS else lambda table: table
    found = rows.join(few(hot), ["h1", "h2"])
    per_doc = found.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    held = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
    hot_drops = found.join(few(held.where(F.col("docs") >= min_docs)), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))

    line = Window.partitionBy("h1", "h2")
    order = line.orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    rest = rows.join(few(hot), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    rest = rest.withColumn("new", F.when((F.row_number().over(order) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(order)), 1).otherwise(0))
    rest = rest.withColumn("at", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = rest.withColumn("docs", F.max("at").over(line)).where((F.col("docs") >= min_docs) & (F.col("at") > 1))
    drops = rest.select("doc_id", "th", "pos").unionByName(hot_drops.select("doc_id", "th", "pos"))
    return drops.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("p")).select("doc_id", "th", drop_runs(F.sort_array("p")).alias("dropped"))


def drop_runs(positions: Column) -> Column:
    """Ordered distinct positions as runs (start, last). They are bound once, for lambdas evaluate what they name for each element."""
    starts = lambda d: F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1) != x - 1))
    lasts = lambda d: F.filter(d, lambda x, i: (i == F.size(d) - 1) | (F.get(d, i + 1) != x + 1))
    return F.get(F.transform(F.array(positions), lambda d: F.zip_with(starts(d), lasts(d), lambda a, b: F.struct(a.alias("start"), b.alias("last")))), F.lit(0))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The kept lines as runs (first line, number of lines), from the runs of dropped lines."""
    start = lambda i: F.coalesce(F.get(dropped, i - 1)["last"] + 1, F.lit(0))
    gaps = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.struct(start(i).alias("start"), (F.coalesce(F.get(dropped, i)["start"], n_lines) - start(i)).alias("n")))
    return F.filter(gaps, lambda r: r["n"] > 0)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` under ``row``, and n_lines, n_dropped, keep_runs (null: all lines stay), kept_text.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points that stand in ``min_docs`` documents or more lose all their lines but
    those in the document with the largest id. A null or empty text is one empty line, which stays.
    Rows that share an id count as one document; null ids count as one document, smaller than any
    other. A document may lose all its lines: its kept text is then empty. An empty table gives an
    empty result. All columns of the input are kept apart in a struct, so no name can clash.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drops = dropped_lines(slim, min_chars, min_docs).select(F.col("doc_id").alias("k1"), F.col("th").alias("k2"), "dropped")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    both = whole.join(drops, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("k2")), "left")
    out = both.withColumn("lines", _lines(F.col("text"))).withColumn("n_lines", F.size("lines"))
    out = out.withColumn("keep_runs", F.when(F.col("dropped").isNotNull(), keep_runs(F.col("dropped"), F.col("n_lines"))))
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice("lines", r["start"] + 1, r["n"]))), "\n")
    return out.select(
        "row", "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.aggregate("dropped", F.lit(0), lambda n, r: n + r["last"] - r["start"] + 1), F.lit(0)).cast("long").alias("n_dropped"), "keep_runs",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
