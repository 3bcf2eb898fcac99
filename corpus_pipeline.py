"""The corpus pipeline: quality, repeated lines, near duplicates, the mix of sources, packing.

Each stage takes (spark, docs, sf_dir) and gets all that the stage before it kept. All but the last
return the columns of ``docs``; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import line_dedup, mixing, packing, quality, simhash
from sonolith.llm.common import release, stage, table
from sonolith.llm.queries import tokenizer_path

# Near duplicates: five-word shingles, a share of 0.8 common distinct ones.
WORDS, SIMILARITY = 5, 0.8


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are more likely neither low nor toxic.

    A null text counts as empty; null sources and languages are sites of their own; rows that repeat an id are
    judged each on its own. Without labels all stay.
    """
    out = quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), carry=True)
    return out.where("kept").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars, if it is there, follows a text that changed.

    Every document stays, if only with an empty text; a null text stays null. Rows that share an id are one document.
    """
    out, changed = line_dedup.line_dedup(docs), F.col("n_dropped") > 0
    fresh = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[F.when(changed, fresh[c]).otherwise(F.col("row")[c]).alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last; of rows alike in id and text, one.

    Texts without a word (null, empty, white space) are one group.
    """
    return simhash.drop_near_duplicates(docs, WORDS, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.

    Null and empty texts have size 0; a null source is a source of its own; rows alike in id and text are taken alike often.
    """
    plan = mixing.mix(docs).select(F.col("doc_id").alias("k1"), F.col("place").alias("k2"), "copies").distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("k0"), mixing.place().alias("place"))
    took = keyed.join(plan.where("copies > 0"), F.col("k0").eqNullSafe(F.col("k1")) & (F.col("place") == F.col("k2")))
    return took.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each document's pieces go. A null or empty text is its end alone; rows that repeat an id are packed each on its own."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", classify_quality), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, step) in enumerate(STAGES[:-1]):
        made = stage(step(spark, docs, sf_dir), name)
        if at:
            release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
