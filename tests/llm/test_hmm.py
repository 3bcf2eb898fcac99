import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from sonolith.llm import hmm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def small_model(rng, classes=5, states=3):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(m, seq):
    for p in product(range(len(m.start)), repeat=len(seq)):
        yield p, m.start[p[0]] * m.emit[seq[0], p[0]] * math.prod(m.move[p[i - 1], p[i]] * m.emit[seq[i], p[i]] for i in range(1, len(seq)))


def test_forward_and_expected_counts_against_all_paths():
    rng = np.random.default_rng(1)
    m = small_model(rng)
    seqs = [np.array(s) for s in ([1, 2, 0, 4], [3], [0, 0, 1], [2, 4, 1, 1, 3])]
    want = [math.log10(sum(p for _, p in paths(m, s))) for s in seqs]
    assert np.allclose(hmm.forward(m, seqs), want)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        total = sum(p for _, p in paths(m, s))
        for path, p in paths(m, s):
            start[path[0]] += p / total
            for i, z in enumerate(path):
                emit[s[i], z] += p / total
                if i:
                    move[path[i - 1], z] += p / total
    assert np.allclose(hmm.expected(m, seqs, np.float64), np.concatenate([start, move.ravel(), emit.ravel()]))


def test_lexicon_sums_to_one():
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(hmm.OWN + 400)]
    counts = np.array(sorted((rng.randint(1, 50) for _ in words), reverse=True), float)
    rest = list(zip(words, counts, strict=True))[hmm.OWN :]
    n, v = np.zeros(hmm.BUCKETS), np.zeros(hmm.BUCKETS)
    for w, c in rest:
        n[hmm.bucket(w) - hmm.OWN] += c
        v[hmm.bucket(w) - hmm.OWN] += 1
    lex = hmm.Lexicon(words, counts, v, n)
    share = Counter()
    for i, w in enumerate(words):
        share[lex.cls[i]] += 10 ** lex.log_share[i]
    for b in range(hmm.OWN, hmm.CLASSES):
        share[b] += 0.5 * 10 ** -lex.log_size[b - hmm.OWN]
    assert all(abs(s - 1) < 1e-9 for s in share.values()) and abs(lex.unigram.sum() - 1) < 1e-9


def test_scores_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(hmm, "DICTIONARY", 30)
    monkeypatch.setattr(hmm, "SLICE", 700)
    rng = random.Random(4)
    langs = [[f"{p}{i}" for i in range(60)] for p in "abc"]
    rows = [(i, " ".join(rng.choice(langs[i % 3]) for _ in range(rng.randint(1, 120)))) for i in range(150)] + [(150, None), (151, ""), (151, " New words\tA1 a1\n "), (152, "É é\xa0x \x1cy a1\x0b"), (None, "b1 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n").repartition(3)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    got = hmm.score(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).collect()
    assert len(got) == len(rows)
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    unseen = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert hmm.score(df.where("false"), F.lit(False)).count() == 0
    assert hmm.score(df.limit(2), F.lit(True)).count() == 2


def test_commonest_words_are_all_above_a_count(spark):
    counts = spark.createDataFrame([(bytes([i]), 1 + i // 10 * 10) for i in range(100)], "word binary, n long")
    for most, want in ((100, 100), (99, 90), (35, 30), (9, 0)):
        got = hmm.commonest(counts, most).collect()
        assert len(got) == want and all(r.n > 91 - want for r in got)
