import hashlib
import random
from collections import Counter

import numpy as np

from sonolith.llm import substring_dedup as sd


def brute(rows, length):
    """doc_id, bytes, removed, runs, digest, by counting every window."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (3, 9, 15, 40)]
    rows = []
    for i in range(60):
        parts = [prose(rnd.randint(0, 25))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            if rnd.random() < 0.4:  # a part of it
                a = rnd.randint(0, len(p) // 2)
                p = p[a : rnd.randint(a, len(p))]
            parts += [p, prose(rnd.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    copy = rows[5][1]
    near = list(copy)
    for at in range(20, len(near), 90):
        near[at] = "Z"
    return [*rows, (60, copy), (61, "".join(near)), (62, None), (63, ""), (64, "x" * 500), (65, "ab" * 200), (66, "short"), (None, passages[3]), (7, rows[7][1]), (67, passages[3] * 3)]


def test_whole_operator_against_counting_all_windows(spark):
    for seed, hot in ((1, 20000), (2, 3)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS g", "2 AS th", "3 AS spans").repartition(3)
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_dedup(df, 40, 10, hot).collect()]
        assert sorted(got, key=str) == brute(rows, 40)
    assert sd.substring_dedup(df.where("false")).count() == 0


def test_length_of_the_query_with_long_texts_repeated_rows_and_a_hot_passage(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    hot, long = prose(120), prose(6000)
    rows = [(i, f"{prose(rnd.randint(0, 40))} {hot[rnd.randint(0, 60) : len(hot) - rnd.randint(0, 90)]} {prose(rnd.randint(0, 40))}") for i in range(60)]
    rows += [(100, long), (101, long[9000:21000] + prose(50)), (102, prose(20) + long[200:599] + prose(9)), (103, prose(20) + long[700:1100] + prose(9))]
    rows += [(200, f"{prose(30)} {hot}")] + [(201, rows[3][1] + prose(80))] * 150 + [(None, prose(90))] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for limit in (1500, 8):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_dedup(df, hot=limit).collect()]
        assert sorted(got, key=str) == brute(rows, 400)
    assert sum(r[2] > 0 for r in brute(rows, 400)) > 200


def test_deep_shallow_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (400, 60), dtype=np.uint8)
    rows[100:250, :50] = rows[100, :50]
    rows[300:320] = rows[300]
    group = rng.integers(0, 3, 400)
    order, common = sd.deep_shallow(group, rows)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for i in range(1, 400):
        (g, a), (h, b) = keys[i - 1], keys[i]
        want = -1 if g != h else next((j for j in range(60) if a[j] != b[j]), 60)
        assert common[i] == want


def test_anchors_of_equal_windows_agree_across_chunks(monkeypatch):
    rnd = random.Random(9)
    raw = bytes(rnd.choices(b"abcd", k=5000))
    whole = sd.anchors(raw, 60, 15)
    monkeypatch.setattr(sd, "CHUNK", 700)
    parts = sd.anchors(raw, 60, 15)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
