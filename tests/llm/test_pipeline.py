import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonolith.llm import quality
from sonolith.llm.queries import tokenizer_path
from test_minhash import brute_kept

COLUMNS = ["doc_id", "text", "lang", "source"]


def corpus():
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(900)]
    bad = [f"vile{i}" for i in range(6)]
    line = lambda: " ".join(rnd.choice(words) for _ in range(9))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(160):
        lines = [line() for _ in range(rnd.randint(1, 12))] + rnd.sample(shared, rnd.randint(0, 2))
        rnd.shuffle(lines)
        if i % 9 == 0:
            lines.append(" ".join(rnd.sample(bad, 4)))
        rows.append((i, "\n".join(lines), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s2", None])))
    near = rows[2][1].split(" ")
    near[len(near) // 2] = "other"
    rows += [(200, " ".join(near), "en", "s1"), (201, None, None, None), (202, "", "en", "s2"), (203, rows[1][1], "en", "s1"), (203, rows[1][1], "en", "s1"), (None, line(), "en", "s2"), (204, "word1 " * 30000, "en", "s1"), (4, line(), "de", "s2")]
    return rows


def bag(rows):
    return Counter(tuple(r) for r in rows)


def judged(spark, rows, labels):
    """Ids and texts that stay, by plain sums over each document's site without the document."""
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    model = quality.fit(df, labels)
    e = model.evidence([r[1] for r in rows])
    out = np.ones(len(rows), bool)
    for t in range(2):
        own = 1 / (1 + np.exp(-(e[:, t] + model.prior[t])))
        path, host = [(r[3], r[2]) for r in rows], [r[3] for r in rows]
        sums = {k: [0, 0.0] for k in [*path, *[("host", h) for h in host]]}
        for p, h, o in zip(path, host, own, strict=True):
            for k in (p, ("host", h)):
                sums[k][0] += 1
                sums[k][1] += o
        n, whole = len(rows), own.mean()

        def strength(keys, toward):
            total = sum(sums[k][0] * toward(k) * (1 - toward(k)) for k in keys)
            between = sum(sums[k][0] * (sums[k][1] / sums[k][0] - toward(k)) ** 2 for k in keys)
            chance = sum(toward(k) * (1 - toward(k)) for k in keys)
            return min(1e6, max(1.0, total / n / max(1e-9, (between - chance) / n) - 1))

        hosts, paths = {("host", h) for h in host}, set(path)
        k1 = strength(hosts, lambda k: whole)
        mean = lambda h: (sums["host", h][1] + k1 * whole) / (sums["host", h][0] + k1)
        k2 = strength(paths, lambda k: mean(k[0]))
        for i, (p, h, o) in enumerate(zip(path, host, own, strict=True)):
            top = (own.sum() + 1 / (1 + np.exp(-model.prior[t])) - o) / n
            at_host = (sums["host", h][1] - o + k1 * top) / (sums["host", h][0] - 1 + k1)
            prior = (sums[p][1] - o + k2 * at_host) / (sums[p][0] - 1 + k2)
            out[i] &= e[i, t] + np.log(prior / (1 - prior)) <= 0
    return bag(r for r, k in zip(rows, out, strict=True) if k)


def without_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(-1 if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t, *more in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if gone.get(key(x), -1 if i is None else i) == (-1 if i is None else i)]
        out.append((i, t if len(left) == len(lines) else "\n".join(left), *more))
    return bag(out)


def test_stages_against_plain_versions(spark, tmp_path):
    rows = corpus()
    labels = spark.createDataFrame([(r[0], 1, int("vile" in (r[1] or ""))) for r in rows[:120]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string"
    frame = lambda rs: spark.createDataFrame(list(rs), schema).selectExpr("*", "1 AS row", "2 AS th", "3 AS n_dropped", "4 AS kept_text", "5 AS place").repartition(3)
    stages = dict(cp.STAGES)

    def step(name, rs):
        df = frame(rs)
        out = stages[name](spark, df, str(tmp_path))
        assert out.columns == df.columns
        return [tuple(r) for r in out.select(COLUMNS).collect()]

    kept = step("quality", rows)
    assert bag(kept) == judged(spark, rows, labels)
    toxic = lambda rs: sum("vile" in (r[1] or "") for r in rs)
    assert 2 * toxic(kept) < toxic(rows) and len(kept) - toxic(kept) == len(rows) - toxic(rows)
    lined = step("lines", kept)
    assert bag(lined) == without_lines(kept) and bag(lined) != bag(kept)
    ids = {i: t for i, t, *_ in sorted(lined, key=str) if i is not None}
    once = [(i, t) for i, t in ids.items()]
    unique = step("near_duplicates", [r for r in lined if r[0] is not None and ids[r[0]] == r[1]])
    assert sorted(r[0] for r in unique) == brute_kept(sorted(once))
    mixed = step("mix", unique)
    times = Counter(mixed)
    assert set(times) <= set(unique) and max(times.values()) <= 2
    size = lambda r: len((r[1] or "").split())
    for s in {r[3] for r in unique}:
        words, taken = sum(size(r) for r in unique if r[3] == s), sum(size(r) * n for r, n in times.items() if r[3] == s)
        assert taken <= 2 * words
    assert abs(sum(size(r) for r in mixed) - 1.5 * sum(size(r) for r in unique)) <= 1.5 * max(map(size, unique))
    packed = stages["pack"](spark, frame(mixed), str(tmp_path)).collect()
    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t, *_ in mixed:
        ids_ = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((i, k, at, len(ids_[at : at + 4096]), zlib.crc32(np.array(ids_[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids_), 4096)))
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    filled = defaultdict(list)
    for r in packed:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert all(b == a + n for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 4096


@pytest.mark.parametrize("empty", [False, True])
def test_run_writes_and_rereads_every_stage(spark, tmp_path, empty):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    (df.where("false") if empty else df).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert not got if empty else got and all(r.length <= 4096 for r in got)
