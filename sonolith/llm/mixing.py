"""Mixing sources to target weights by hash-threshold histograms.

A document's place is the hash of its id and text. For each source, words are summed by the hash's
top bits; the budget falls into one bucket, whose rows alone are summed again by the next bits,
until the bucket holds one hash. The budget is then a threshold: rows below it are taken. Nothing
is sorted, and each histogram has at most sources x 4,096 rows after partial aggregation, so a hot
source arrives as 4,096 sums a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stage, text_of

BITS = (12, 12, 12, 12, 16)
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to rows of (source, no_source, source_size), one for each source.

    Weights go round over the sources by code point, null last. A target stops at ``cap`` times its
    source's size; the excess is shared anew by weight. With sources by size over weight, that
    ends at the first source which isn't above: its share per weight holds for all that follow.
    """
    by_name = Window.orderBy("no_source", "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    t = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), "no_source", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    t = t.withColumn("rate", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).withColumn("turn", F.row_number().over(order))
    free = F.when(F.col("rate") * F.col("w") <= F.col("most"), F.col("turn"))
    t = t.withColumn("rate", F.min_by("rate", free).over(every))
    return t.withColumn("target", F.when(F.col("rate").isNull(), F.col("most")).otherwise(F.least("most", F.col("rate") * F.col("w")))).select("source", "no_source", "source_size", "target")


def _bits(h: Column, level: int) -> Column:
    """The hash's bits of one level."""
    low = 64 - sum(BITS[: level + 1])
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << BITS[level]) - 1))


def _path(h: Column, level: int) -> Column:
    """The hash's bits above a level."""
    return F.shiftrightunsigned(h, 64 - sum(BITS[:level])) if level else F.lit(0).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, place, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document: the whole passes that the target holds, and
    one more below the source's threshold, ``cap`` at most; ``taken`` is copies x size. The last document is taken if
    that brings the sum nearer to the target. A null text has size 0; a null source is a source of
    its own, after all others; rows alike in id and text share a fate. Sources without a word get
    target 0. An empty table gives an empty result. ``cap`` is a whole number of passes. The place (the hash) and the id find a
    row of ``docs`` again.
    """
    size = F.regexp_count(text_of(text_col), F.lit(WORD_PATTERN)).cast("long")
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(source_col).isNull().alias("no_source"), size.alias("size"),
            place(id_col, text_col).alias("h"),
        ),
        "sizes",
    )
    by = ["source", "no_source"]
    targets = stage(source_targets(rows.groupBy(*by).agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = targets.withColumn("passes", passes).select(*by, F.lit(0).cast("long").alias("path"), (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"))
    final = []
    for level in range(len(BITS)):
        inside = rows.withColumn("path", _path(F.col("h"), level)).join(edge, [*by, "path"])
        sums = inside.groupBy(*by, "path", "left", _bits(F.col("h"), level).alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("h"), (F.min("h") == F.max("h")).alias("one"))
        w = Window.partitionBy(*by).orderBy("b")
        sums = sums.withColumn("upto", F.sum("words").over(w))
        at = sums.where(F.col("upto") > F.col("left")).groupBy(*by).agg(F.min_by(F.struct("b", "path", "left", "upto", "words", "h", "one"), "b").alias("x")).select(*by, "x.*")
        left = F.col("left") - (F.col("upto") - F.col("words"))
        at = stage(at.select(*by, F.shiftleft("path", BITS[level]).bitwiseOR(F.col("b")).alias("path"), left.alias("left"), "words", "h", "one"), f"edge{level}")
        last = F.lit(level == len(BITS) - 1) | F.col("one")
        start = F.shiftleft("path", 64 - sum(BITS[: level + 1])).alias("start")
        final.append(at.where(last).select(*by, start, F.when(F.col("left") * 2 >= F.col("words"), F.col("h")).alias("also")))
        edge = at.where(~last).select(*by, "path", "left")
        if edge.isEmpty():
            break
    cuts = final[0]
    for more in final[1:]:
        cuts = cuts.unionByName(more)
    plan = targets.withColumn("passes", passes).join(cuts, by, "left")
    flip = F.lit(-(2**63))
    below = F.col("h").bitwiseXOR(flip) < F.col("start").bitwiseXOR(flip)
    extra = F.coalesce((below | F.coalesce(F.col("h") == F.col("also"), F.lit(False))).cast("long"), F.lit(0))
    out = rows.join(plan, by).withColumn("copies", F.least(F.lit(int(cap)).cast("long"), F.col("passes") + extra))
    return out.select("doc_id", F.col("h").alias("place"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def place(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))
