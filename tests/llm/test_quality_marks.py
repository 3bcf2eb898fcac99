import random

from pyspark.sql import functions as F

from sonolith.llm import quality


def test_rare_words_of_one_stem_are_evidence_in_every_language(spark):
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzéñü"

    def word(start=""):
        return start + "".join(rnd.choice(letters) for _ in range(6))

    words = {g: [word() for _ in range(150)] for g in ("fr", "de", "es")}
    begin = {"fr": "réeux", "de": "achlich", "es": "boment"}

    def doc(lang, toxic):
        text = [rnd.choice(words[lang]) for _ in range(rnd.randint(30, 60))]
        # Clean documents hold such a word at times, too.
        text += [word(begin[lang]) for _ in range(rnd.randint(2, 4) if toxic else rnd.random() < 0.2)]
        rnd.shuffle(text)
        return " ".join(text)

    rows = []
    for i in range(1500):
        lang, toxic = rnd.choice(["fr", "de", "es"]), int(rnd.random() < 0.12)
        rows.append((i, doc(lang, toxic), "s", lang, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, truth int")
    labels = df.where("doc_id < 1000").select("doc_id", F.lit(1).alias("quality"), F.col("truth").alias("toxic"))
    got = {r.doc_id: r.kept for r in quality.classify(df, labels, F.col("source"), F.col("lang")).collect()}
    for lang in words:
        caught = [not got[r[0]] for r in rows if r[0] >= 1000 and r[3] == lang and r[4]]
        assert len(caught) > 10 and sum(caught) / len(caught) > 0.8, lang
    clean = [got[r[0]] for r in rows if r[0] >= 1000 and not r[4]]
    assert sum(clean) / len(clean) > 0.97
