import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sonolith.llm import exact_dedup, line_dedup

ROWS = [
    (5, "a b\tc"), (3, "abc"), (9, "ab c"), (7, "abd"), (2, None), (8, ""), (6, " \n "), (None, "abc"), (4, "x" * 70), (1, "x" * 70 + " "), (10, "x" * 71), (11, "é" * 2000), (12, "é" * 2000 + "\x0b"), (13, "é" * 1999), (13, "abc"),
]


def test_exact_dedup_against_grouping(spark):
    rnd = random.Random(1)
    rows = ROWS + [(100 + i, " ".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 3, 80, 1200])))) for i in range(200)] + [(400 + i, "hot text") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS norm", "3 AS digit").repartition(4)
    got = exact_dedup.exact_dedup(df, first_width=4, growth=3).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    last = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_against_counting_lines(spark, monkeypatch):
    rnd = random.Random(2)
    pool = [f"Line number {i} is long enough é" for i in range(12)] + ["short", "", "x" * 19, "x" * 20]
    rows = [(i, "\n".join(rnd.choice(["", "\t "]) + rnd.choice(pool).upper() if rnd.random() < 0.2 else rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, pool[0]), (5, rows[5][1]), (73, "\n".join(pool * 400)), (74, pool[1] + "\r\n" + pool[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS th", "2 AS pos", "3 AS row").repartition(3)
    for share in (2000, 1000000):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        out = line_dedup.line_dedup(df)
        got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("h")).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)
    runs = {r.doc_id: r for r in out.collect()}
    assert runs[72].keep_runs is None and runs[72].row.pos == 2
    assert line_dedup.line_dedup(df.where("false")).count() == 0
    df.sparkSession.sparkContext  # native: no Python in the plan
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
