import random
from itertools import combinations

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from sonolith.llm import minhash, simhash
from test_minhash import brute_kept, near_rows, share, shingles


def plain_prints(hashes, count):
    out = []
    for w in range(2 * count):
        mixed = []
        for h in hashes.tolist():
            x = h * int(simhash._FACTORS[w, 0]) % 2**64
            x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 % 2**64
            mixed.append(x ^ x >> 29)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def test_set_prints_against_plain_sums():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 254, 255, 256, 700, 255 * 16 + 3):
        hashes = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert simhash.set_prints(hashes, 1 if n > 300 else 3).tolist() == plain_prints(hashes, 1 if n > 300 else 3)


def test_pairs_at_the_similarity_are_found_whatever_their_size():
    rng = np.random.default_rng(7)
    count, m = simhash.plan_prints(200_000, 0.8)
    assert simhash.plan_prints(10**7, 0.8)[0] * 8 > count * m and simhash.plan_prints(10, 1.0)[0] == 1
    for both, one, two in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (80, 10, 10), (80, 20, 0), (400, 50, 50)):
        for _ in range(150):
            h = rng.integers(0, 2**63, both + one + two, dtype=np.uint64)
            p, q = (simhash.set_prints(x, count).reshape(-1, 2) for x in (h[: both + one], np.concatenate([h[:both], h[both + one :]])))
            near = np.bitwise_count(p ^ q).sum(axis=1) <= simhash.NEAR
            assert any((near & (simhash._values(p, c) == simhash._values(q, c))).any() for c in simhash._cuts(m))


def test_table_pairs_against_all_pairs():
    rng = np.random.default_rng(3)
    e = np.zeros(3000, simhash._ENTRY)
    e["node"], e["n"], e["x"] = rng.permutation(3000) - 1500, rng.integers(50, 100, 3000), rng.integers(0, 2**63, (3000, 2))
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 2, k), dtype=np.uint64), axis=2)
    e["x"][1:3000:3] = e["x"][0:2999:3] ^ flips(1000, 3)
    # Near copies: a dense bucket, of which a star and the members are returned.
    e["x"][2000:2600], e["n"][2000:2600] = e["x"][2000] ^ flips(600, 1), 60
    for cut in simhash._cuts(10):
        v = simhash._values(e["x"], cut)
        pairs, dense = simhash.table_pairs(e, cut, 0.8)
        got = {tuple(sorted(p)) for p in pairs.tolist()}
        full = {value for value, _ in dense}
        assert len(got) == len(pairs) and full
        want, stars = set(), set()
        for value in set(v.tolist()):
            at = np.flatnonzero(v == value)
            first = min(e["node"][at])
            for i, j in combinations(at.tolist(), 2):
                n, m = sorted((int(e["n"][i]), int(e["n"][j])))
                if np.bitwise_count(e["x"][i] ^ e["x"][j]).sum() <= simhash.NEAR and n >= 0.8 * m:
                    p = tuple(sorted((int(e["node"][i]), int(e["node"][j]))))
                    if value not in full:
                        want.add(p)
                    elif first in p:
                        stars.add(p)
        assert got == want | stars and want and stars
        for value, members in dense:
            assert sorted(members["node"]) == sorted(e["node"][v == value])


def test_near_duplicate_stage_takes_simhash_candidates_whole_or_dealt(spark, tmp_path, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, made = brute_kept(rows), []
    found = simhash.candidates

    def counted(*args):
        out = found(*args)
        made.append(out.collect())
        return out

    monkeypatch.setattr(simhash, "candidates", counted)
    # One task a fingerprint; ranges of each table.
    for value in (1 << 19, 100):
        monkeypatch.setattr(simhash, "ENTRIES", value)
        assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, df, str(tmp_path)).collect()) == kept
    assert len(made) == 2
    pairs = [{(r.a, r.b) for r in x if not r.dense} for x in made]
    dense = [sum(r.dense for r in x) for x in made]
    assert pairs[0] == pairs[1] and dense[0] == dense[1] > 0


def test_members_of_dense_buckets_that_links_leave_apart(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(4):
        base = [rnd.choice(words) for _ in range(120)]
        texts += [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in rnd.sample(range(120), 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r.doc_id: r for r in minhash.classes(docs, 5, prints=1).collect()}
    e = np.zeros(len(made), simhash._ENTRY)
    for i, r in made.items():
        e[i] = (r.node, r.n, np.frombuffer(r.prints, "<u8"))
    dense = spark.createDataFrame([(7, bytearray(e.tobytes()))], "key long, members binary")
    # The first group is one class already, and so are two members of the second.
    known = {made[i].node: min(made[k].node for k in g) for g in (range(5), (5, 6)) for i in g}
    roots = spark.createDataFrame(list(known.items()), "node long, root long")
    got = simhash.left_apart(dense, roots, 0.8)
    assert {r.node for r in got.collect()} == {made[i].node for i in range(5, 20)} and got.where(F.col("members") < 3).count() == 0
    sets = [shingles(t) for t in texts]
    assert all(share(sets[i], sets[j]) >= 0.8 for g in range(4) for i, j in combinations(range(5 * g, 5 * g + 5), 2))


def joined(pairs, nodes):
    up = {x: x for x in nodes}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in nodes}


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(5)
    for n, k in ((0, 0), (2, 1), (50, 20), (50, 300), (400, 300), (400, 5000)):
        pairs = np.unique(np.sort(rng.integers(-n, n + 1, (k, 2)), axis=1), axis=0) * 10**15
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        got, nodes = simhash.forest(pairs), np.unique(pairs).tolist()
        want = joined(pairs.tolist(), nodes)
        assert joined(got.tolist(), nodes) == want and len(got) == len(nodes) - len(set(want.values()))
        assert {tuple(p) for p in got.tolist()} <= {tuple(p) for p in pairs.tolist()}


def test_grown_members_of_a_bucket():
    rng = np.random.default_rng(6)
    e = np.zeros(300, simhash._ENTRY)
    e["node"], e["n"], e["x"] = rng.permutation(300) - 150, rng.integers(80, 120, 300), rng.integers(0, 2**63, (300, 2))
    # Chains, whose ends are far from each other.
    for i in range(300):
        if i % 30:
            e["x"][i] = e["x"][i - 1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2, 6), dtype=np.uint64), axis=1)
    i, j = np.triu_indices(300, 1)
    at = simhash._alike(simhash._columns(e), i, j, 0.8)
    every = np.stack([e["node"][i[at]], e["node"][j[at]]], axis=1).tolist()
    got, nodes = simhash.grown(e, 0.8).tolist(), e["node"].tolist()
    want = joined(every, nodes)
    assert joined(got, nodes) == want and len(got) == 300 - len(set(want.values())) and 10 <= len(set(want.values())) < 250


def test_a_large_group_makes_candidates_in_proportion(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    said = [rnd.choice(words) for _ in range(70)]
    # All share a passage, and few are near copies.
    rows = [" ".join(said + [rnd.choice(words) for _ in range(rnd.randint(20, 32))]) for _ in range(400)]
    for k in range(0, 40, 2):
        rows[k + 200] = rows[k] + " and more"
    rows = list(enumerate(rows))
    sets = [shingles(t) for _, t in rows]
    assert sum(0.5 < share(a, b) < 0.8 for a, b in combinations(sets, 2)) > 50_000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count, m = simhash.plan_prints(len(rows), 0.8)
    nodes = minhash.classes(df, 5, prints=count)
    assert simhash._compared(nodes, len(rows), count, m, 0.8, False).count() < count * len(rows)
    assert simhash.candidates(nodes, len(rows), 0.8).count() < 2 * len(rows)
    kept = brute_kept(rows)
    assert len(kept) < len(rows)
    # Clusters that are compared in place; ones too large for that.
    for value in (1 << 14, 50):
        monkeypatch.setattr(simhash, "CLUSTER", value)
        assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, df, str(tmp_path)).collect()) == kept
    assert simhash.candidates(nodes, len(rows), 0.8).where("length(members) > 0").count() > 0
