import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.llm import ann, mixing, quality, warc


def water_fill(sizes, weights, share, cap):
    target = {}
    free, budget = dict(zip(sizes, weights, strict=True)), share * sum(sizes.values())
    while free:
        rate = budget / sum(free.values())
        over = [k for k, w in free.items() if rate * w > cap * sizes[k]]
        if not over:
            return target | {k: rate * w for k, w in free.items()}
        for k in over:
            target[k] = cap * sizes[k]
            budget -= target[k]
            del free[k]
    return target


def test_mixing(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(1500):
        s = rnd.choice(["a"] * 8 + ["b", "c", "Z", None, "é"])
        rows.append((i, " ".join("w" for _ in range(rnd.randint(0, 60))), s))
    rows += [(2000, None, "a"), (2001, "x", "empty-ish"), (2002, "", "none"), (None, "w w w", None), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS h").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill({s: sizes[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    by_size = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by_size[r.source_size].append(r)
    for s, size in sizes.items():
        if list(sizes.values()).count(size) == 1:
            own = by_size[size]
            assert own[0].target == pytest.approx(want[s])
            assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-6
    assert mixing.mix(df.where("false")).count() == 0
    # Empty documents of a source whose target is the cap aren't taken beyond it.
    capped = spark.createDataFrame([(i, "" if i % 3 else "w w", "small") for i in range(300)] + [(1000 + i, "w " * 900, "large") for i in range(40)], "doc_id long, text string, source string")
    small = mixing.mix(capped, weights=(1.0, 50.0)).where("doc_id < 1000").collect()
    assert {r.copies for r in small} == {2} and small[0].target == 2 * small[0].source_size


def test_warc_round_trip_and_transactions(spark, tmp_path):
    big = "<html>" + "x" * 1200 + "\r\n\r\né WARC/1.1\r\n</html>"
    rows = [(1, "http://a", big), (9, "http://b", big), (4, None, big), (5, "http://c\r\nX: y", "small"), (6, "http://d", "small"), (7, "http://e", None), (7, "http://e", None), (9, "http://b", big), (None, "http://f", "z" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first_id", "3 AS size").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_index(df).collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and i is not None and i != 9
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None)] += 1
    assert got == want
    warc.write(df, f"file://{tmp_path}/w")
    records = warc.read(spark, f"file://{tmp_path}/w")
    assert Counter(r.type for r in records.collect()) == {"request": 9, "metadata": 9, "response": 7, "revisit": 2}
    names = {r.record_id for r in records.collect()}
    assert len(names) == 27 and {r.refers_to for r in records.where("type = 'revisit'").collect()} == {None}  # two rows are the page that holds the payload
    warc.write(df.dropDuplicates(), f"file://{tmp_path}/v")
    once = warc.read(spark, f"file://{tmp_path}/v").collect()
    named = {r.refers_to for r in once if r.type == "revisit"}
    assert len(named) == 1 and named <= {r.record_id for r in once if r.type == "response"} and len({r.record_id for r in once}) == len(once)
    urls = Counter(r.request_uri for r in warc.page_index(df).collect())
    assert urls == Counter({"http://a": 1, "http://b": 2, "about:blank": 1, "http://c%0D%0AX: y": 1, "http://d": 1, "http://e": 2, "http://f": 1})
    alone = records.where("type <> 'request'")
    assert warc.assemble(alone).where("request is null and metadata is not null").count() == 9
    assert warc.page_index(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\n\r\nabc\r\n\r\n"))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1200, 24))
    base[300:700] = base[300]  # one very common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] + [1.0] * 23), (5300, [None] + [1.0] * 23), (5400, [1.0, 2.0]), (5500, [float("inf")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS p", "2 AS cell", "3 AS score").repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block_rows=150).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 50))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((base - base[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1200), d))[:10]
        assert [r for r, _, _ in found] == list(range(1, 11)) and [v for _, v, _ in found] == [v for _, v, _ in sorted(found, key=lambda x: (x[2], x[1]))]
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    assert hits / (10 * len(got)) >= 0.9
    # Rows that repeat a query's id are candidates, and are answered each on its own.
    again = ann.nearest(df.where("vec_id < 4").unionByName(df.where("vec_id = 0")), F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id if r.rank == 1 else 0) for r in again) == sorted([(0, i, 0) for i in (1, 2, 3, 4)] * 2) and {r.score for r in again if r.rank == 1} == {0.0}
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted((r.rank, r.query_id) for r in few) == [(1, 0), (2, 0), (3, 0)]
    assert ann.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_search_stops_where_the_data_allow(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32)) * 10
    base = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 40 == 0, block_rows=500, with_work=True).collect()
    work = {r.query_id: r.verified for r in got}
    assert len(work) == 100 and sum(work.values()) / 100 < 0.2 * 4000
    hits = 0
    for q in work:
        d = np.sqrt(((base - base[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 900


def test_chi_square():
    # Known quantiles for 8 degrees of freedom.
    assert ann.chi_square(np.array([15.507, 20.090])) == pytest.approx([0.95, 0.99], abs=1e-4)


def test_quality_on_held_out_documents(spark):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(300)]

    def doc(kind):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        if kind == "low":
            text = [w.upper() + "!!" for w in text]
        if kind == "toxic":
            text[rnd.randint(0, len(text) - 1)] = rnd.choice(["vile", "nasty"])
        return " ".join(text)

    kinds = [rnd.choice(["good"] * 6 + ["low", "toxic"]) for _ in range(900)]
    rows = [(i, doc(k), rnd.choice(["h1", "h2", "h3", None]), rnd.choice(["p", None])) for i, k in enumerate(kinds)] + [(5000, None, "h1", "p"), (5001, "", None, None), (1, doc("good"), "h1", "p"), (5002, "word1 " * 20000, "h2", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS host", "2 AS none", "3 AS low").repartition(3)
    labels = spark.createDataFrame([(i, int(k != "low"), int(k == "toxic")) for i, k in enumerate(kinds[:500])] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows)
    unseen = [(r.kept, kinds[r.doc_id]) for r in got if r.doc_id is not None and 500 <= r.doc_id < 900]
    right = sum(kept == (k == "good") for kept, k in unseen) / len(unseen)
    clean = [kept for kept, k in unseen if k == "good"]
    assert right > 0.95 and sum(clean) / len(clean) > 0.97
    assert all(r.kept for r in quality.classify(df, labels.where("false"), F.col("source"), F.col("lang")).collect())
    # Alone on its path and host, a document is judged by its evidence and the global prior, not by its own posterior again.
    lone = df.unionByName(spark.createDataFrame([(7000, rows[kinds.index("low")][1], "solo", "solo", 1, 2, 3)], "doc_id long, text string, source string, lang string, host int, none int, low int"))
    one, same = (quality.classify(lone, labels, F.lit(h) if h else F.col("source"), F.lit(h) if h else F.col("lang")).where("doc_id = 7000").first() for h in (None, "all"))
    assert one.p_low == pytest.approx(same.p_low, rel=0.05)
    carried = quality.classify(df, labels, F.col("source"), F.col("lang"), carry=True)
    assert carried.select("row.*").columns == df.columns
    assert quality.classify(df.where("false"), labels, F.col("source"), F.col("lang")).count() == 0
