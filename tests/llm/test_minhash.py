import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline as cp
from pyspark.sql import functions as F

from sonolith.llm import minhash, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    """The smallest id of each component over links of 0.8 or more."""
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in combinations(sets, 2):
        if share(sets[a], sets[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return sorted(i for i in up if up[i] == i)


def near_rows():
    """Pairs from 0.7 to 1, a chain, a large group about 0.8, and texts that repeat one passage."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(9000)]
    rows = []
    for k in range(120):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 300))]
        near = list(base)
        at = rnd.randrange(len(base) - 2)
        near[at : at + max(1, len(base) * (k % 20) // 100)] = [rnd.choice(words) for _ in range(max(1, len(base) * (k % 20) // 100))]
        rows += [" ".join(base), " ".join(near)]
    base = [rnd.choice(words) for _ in range(200)]
    for k in range(8):
        base[25 * k : 25 * k + 12] = [rnd.choice(words) for _ in range(12)]
        rows.append(" ".join(base))
    base = [rnd.choice(words) for _ in range(200)]
    for _ in range(60):
        own = list(base)
        for _ in range(4):
            own[rnd.randrange(200)] = rnd.choice(words)
        rows.append(" ".join(own))
    said = "buy one now and get one free today only here " * 60
    rows += [said + " ".join(rnd.choice(words) for _ in range(9)) for _ in range(2)] + [said, "", None, "one two", "one two three four five six", "one two three four five six"]
    return list(enumerate(rows))


def test_near_duplicate_stage_against_brute_force(spark, tmp_path):
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    bands = defaultdict(int)
    for a, b in combinations(sets, 2):
        bands[min(9, int(10 * share(a, b)))] += 1
    assert bands[7] >= 5 and bands[8] >= 20 and bands[9] >= 20
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "1 AS node", "2 AS key").repartition(3)
    got = cp.drop_near_duplicates(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_equal_fingerprints_are_not_yet_one_class(spark):
    said = "a b c d e " * 400
    rows = [(1, said + "one of them ends in these few words of its own here"), (2, said + "while another goes on to say things that nobody else says")]
    prints = {simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in rows}
    assert len(prints) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.drop_near_duplicates(df, 5, 7, 0.8).count() == 2


def test_members_that_the_representative_does_not_join_are_compared(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(6):
        base = [rnd.choice(words) for _ in range(120)]
        texts += [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in rnd.sample(range(120), 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    made = minhash.classes(docs, 5).collect()
    at = {r.doc_id: r.node for r in made}
    nodes = spark.createDataFrame([(r.node, r.n, r.doc_id, r.th) for r in made], "node long, n int, k0 long, k1 long").select("node", "n", F.struct("k0", "k1").alias("k"))
    rep = min(at.values())
    shared = spark.createDataFrame([(9, r.node, r.n, rep, r.n, len(made)) for r in made], "key long, node long, n int, rep long, m int, members int")
    # Some are one class already; what is left apart has links that the roots don't tell.
    known = {at[i]: min(at[0], at[1], at[2]) for i in (0, 1, 2)}
    roots = spark.createDataFrame(list(known.items()), "node long, root long")
    sets = {at[i]: shingles(t) for i, t in enumerate(texts)}
    for members in (2, 256):
        monkeypatch.setattr(minhash, "MEMBERS", members)
        up = {x: known.get(x, x) for x in sets}
        links = [tuple(r) for r in minhash.apart_links(docs, nodes, shared, roots, 5, 0.8).collect()]
        assert len(links) == len(set(links))

        def top(x, up=up):
            return x if up[x] == x else top(up[x])

        for a, b in links:
            assert share(sets[a], sets[b]) >= 0.8 and known.get(a, a) != known.get(b, b)
            x, y = sorted((top(a), top(b)))
            up[y] = x
        groups = defaultdict(set)
        for i in at:
            groups[top(at[i])].add(i)
        assert sorted(map(sorted, groups.values())) == [list(range(k, k + 5)) for k in range(0, 30, 5)]
    one = shared.limit(0)
    assert minhash.apart_links(docs, nodes, one, roots, 5, 0.8) is None
