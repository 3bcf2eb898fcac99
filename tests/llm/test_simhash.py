import random

import xxhash

from sonolith.llm import simhash


def brute(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint_against_plain_sum():
    rnd = random.Random(3)
    for n in (0, 1, 3, 4, 5, 300, 2000):
        t = " ".join(rnd.choice(["Ab", "éà", "c", "dd", "Zz"]) for _ in range(n))
        assert simhash.fingerprint(simhash.shingle_hashes(t)) == brute(t)


def test_links_find_all_pairs_with_any_number_of_segments(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {x ^ sum(1 << b for b in rnd.sample(range(64), k)) for x in base for k in range(8)}
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    for d, m in ((4, 2), (4, 3), (4, 5), (7, 4)):
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= d}
        got = [tuple(r) for r in simhash.links(df, d, m).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r.node: r.root for r in simhash.linked(df, d, m).collect()} == smallest(want)


def smallest(pairs):
    """The smallest node that each linked node reaches."""
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


def test_random_corpora_against_brute_force(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        words = [f"w{i}" for i in range(60)]
        rows = []
        for i in range(60):
            base = rows[rnd.randrange(len(rows))][1].split() if rows and rnd.random() < 0.7 else [rnd.choice(words) for _ in range(rnd.randint(0, 120))]
            if base:
                base[rnd.randrange(len(base))] = rnd.choice(words)
            rows.append((100 - i, " ".join(base)))
        prints = {i: brute(t) for i, t in rows}
        pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
        want = {i: i for i in prints} | smallest(pairs)
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.fp % 2**64 for r in got} == prints
        assert len(set(want.values())) < 60


def test_a_dense_ball_makes_no_square(spark):
    rnd = random.Random(1)
    base = rnd.getrandbits(63)
    fps = {base ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)) for _ in range(900)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = simhash.linked(df, 4).collect()
    assert len(got) == len(fps) and {r.root for r in got} == {min(fps)}


def test_components_and_edge_cases(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (9, None), (8, ""), (8, " \n"), (None, "one two"), (1, "x" * 100000), (2, "p q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(5, 3), (3, 3), (9, 8), (8, 8), (1, 1), (2, 2), (None, None)} == got
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_drop_keeps_one_of_each_group_and_sketches_tell_similarity(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = [rnd.choice(words) for _ in range(400)]
    near, far = list(base), list(base)
    near[7] = "changed"
    far[::3] = ["other"] * len(far[::3])
    rows = [(4, " ".join(base)), (2, " ".join(near)), (9, " ".join(far)), (9, " ".join(far)), (None, "a b c d e f g"), (None, "a b c d e f g"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS row", "2 AS th", "3 AS k0")
    got = simhash.drop_near_duplicates(df, words=5, max_bits=7, similarity=0.8)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [2, 7, 9, None]
    a, b, c = (simhash.sketch(simhash.shingle_hashes(" ".join(x), 5)) for x in (base, near, far))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    held = spark.createDataFrame([(1, bytearray(a)), (2, bytearray(b)), (3, bytearray(c))], "fp long, sketch binary")
    assert [tuple(r) for r in simhash.similar(pairs, held, 0.8).collect()] == [(1, 2)]
