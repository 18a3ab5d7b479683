import hashlib
import re

import edge
from filelens.llm import paragraph_sketch as S


def units(t):
    return {x for x in re.split(r"\n+|(?<=[.!?])\x20+", t) if x.strip(" ")}


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for (i, t, *_), (_, nxt, *_) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        e = t[:len(t) - k] + nxt[:k]
        like = lambda x, y: 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), like(units(t), units(e)), like(units(t), units(nxt)))
    return out


def check(spark, rows):
    got = S.op9(edge.frame(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == w[:2]
        assert abs(r["near_edited"] - w[2]) < 1e-9 and abs(r["near_next"] - w[3]) < 1e-9
    return {r["doc_id"]: r for r in got}


def test_equals_exact_difference(spark, rows):
    got = check(spark, rows)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) > 0.9 * len(by)


def test_cases(spark):
    check(spark, edge.CASES)
    assert S.op9(edge.empty(spark)).collect() == []
    one = S.op9(edge.frame(spark, [(5, "alone here. yes", "en", "s")])).collect()
    assert one[0]["near_next"] == 1.0
    both = S.op9(edge.cases(spark)).collect()
    assert len(both) == len(edge.CASES) + 2 and [r["doc_id"] for r in both].count(5) == 2


def test_stuck_pairs_are_sketched_larger(spark):
    a = [f"only a {i}." for i in range(300)]
    b = [f"only b {i}." for i in range(50)] + a[:200]
    df = spark.createDataFrame([(1, " ".join(a), " ".join(b))], "k long, x string, y string")
    d = S.differing(df.select("k", S.paragraphs(df.x).alias("a"), S.paragraphs(df.y).alias("b")), ["k"]).collect()[0]
    assert len(set(d["plus"])) == 100 and len(set(d["minus"])) == 50
