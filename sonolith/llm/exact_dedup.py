"""Exact dedup by distributed MSD radix partitioning.

Documents are split by the successive bytes of their text without white space. A digit is a run
of bytes; its width grows sixteenfold a round, so the number of rounds is logarithmic in the
longest text. A group is finished when it has one row or when its digit was shorter than the
width, for then all of its texts have ended. No digest decides on equality.

Skew: a round counts a group by partial aggregation, so a hot group arrives as one row a task;
the join that hands the group's number back is a sort-merge join whose hot partitions adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, stage, text_of

FIRST_WIDTH, GROWTH = 64, 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = FIRST_WIDTH, growth: int = GROWTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts are one group. Of equal texts the one with
    the most code points stays, then the smallest id (null ids last), then one row of those that
    agree in both. Repeated ids are separate rows. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    text = text_of(text_col)
    norm = F.translate(text, WHITE, "").cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("cp"), norm.alias("norm")).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "cp", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"), F.substring("norm", 1, first_width).alias("digit")
    )
    counts = docs.select(F.substring(norm, 1, first_width).alias("digit")).groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    # Counts are stored, so that the join's two sides are plain exchanges, whose hot partitions can be split.
    rows = base.join(stage(counts, "digits"), "digit")
    rows = stage(rows.select("rid", "doc_id", "cp", "sha", "n", F.when(F.col("n") > 1, F.col("norm")).alias("norm")), "radix0")

    active = rows.where("n > 1").select("rid", F.lit(0).cast("long").alias("gid"), "norm")
    width, ended = first_width * (1 + growth), []
    while not active.isEmpty():
        keyed = active.withColumn("digit", F.substring("norm", 1, width))
        groups = keyed.groupBy("gid", "digit").agg(F.min("rid").alias("next"), F.count(F.lit(1)).alias("n"))
        over = (F.col("n") == 1) | (F.length("digit") < width)
        split = stage(
            keyed.join(stage(groups, "digits"), ["gid", "digit"]).select("rid", F.col("next").alias("gid"), over.alias("over"), F.when(~over, F.expr(f"substring(norm, {width + 1})")).alias("norm")), "radix"
        )
        ended.append(split.where("over").select("rid", F.col("gid").alias("class")))
        active = split.where("not over").select("rid", "gid", "norm")
        width *= growth

    alone = rows.where("n = 1").select("rid", "doc_id", "cp", "sha", F.col("rid").alias("class"))
    grouped = rows.where("n > 1").select("rid", "doc_id", "cp", "sha")
    classes = ended[0] if ended else alone.select("rid", "class").limit(0)
    for more in ended[1:]:
        classes = classes.unionByName(more)
    classed = stage(grouped.join(classes, "rid"), "classes") if ended else alone.limit(0)
    first = F.struct(-F.col("cp"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    chosen = stage(classed.groupBy("class").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first")), "chosen") if ended else classed.groupBy("class").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first"))
    many = classed.join(chosen, "class").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "sha")
    one = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return one.unionByName(many).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
