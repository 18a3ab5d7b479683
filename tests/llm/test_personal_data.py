import hashlib
import random
import re

import edge
from filelens.llm import personal_data as P

RE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d),
            "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k in P.KINDS for m in re.finditer(RE[k], text or "") if valid(k, m[0])]


def run(spark, rows):
    return P.op7(edge.frame(spark, rows)).collect()


def same(got, rows):
    want = {r[0]: base(r[1]) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        b = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in b) for k in P.KINDS]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["spans"] + ",").startswith(text + "," if text else "")
    return {r["doc_id"]: r for r in got}


def test_base_equals_plain_patterns(spark, rows):
    rnd = random.Random(11)
    parts = ["a@b.c", "_d@e.f", "x", "1.2.3.4", "255.1.1.256", "0255.1.2.3", ".5", "4041894974608795", "4041 8949-7460 8795", " ", "-", "+", "+1 (988) 555-2485",
             "+12", "((", "é\U0001f600", "@", ".", "9", "12 34", "..", "%+-", "4 0 4 1 8 9 4 9 7 4 6 0 8 7 9 5", "\n", "00000000000000000000"]
    made = [(10_000 + i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))), "en", "s") for i in range(1500)]
    got = same(run(spark, rows + made), rows + made)
    assert sum(r["n_card"] for r in got.values()) > 50 and sum(r["n_email"] for r in got.values()) > 200


def test_added_spans_are_secrets(spark, rows):
    hexes = [f"{random.Random(i).getrandbits(160):040x}" for i in range(30)]
    made = [(50_000 + i, f'und the of token = "{h}" and chapter2009 of, the year2001x4 on 12345678 it', "en", "s") for i, h in enumerate(hexes)]
    got = same(run(spark, rows + made), rows + made)
    for (i, t, *_), h in zip(made, hexes):
        assert got[i]["spans"].split(",")[-1] == f"secret:{t.index(h)}:{t.index(h) + 40}" and got[i]["spans"].count("secret") == 1


def test_long_runs_and_cases(spark):
    def long(n):  # the plain patterns take quadratic time on these, so they are compared on short ones
        return [(20, "a" * n + "@", "en", "s"), (21, "1" * n, "en", "s"), (22, "1 " * n, "en", "s"), (23, "+1" * n, "en", "s"),
                (24, "x@" + "y." * n, "en", "s"), (25, "+1" + "(" * n, "en", "s")]

    rows = [c for c in edge.CASES if len(c[1] or "") < 10_000] + long(1500)
    short = same(run(spark, rows), rows)
    got = {r["doc_id"]: r for r in run(spark, long(100_000))}
    assert all(got[i][f"n_{k}"] == short[i][f"n_{k}"] for i in got for k in P.KINDS)
    assert run(spark, []) == []
    assert len(P.op7(edge.cases(spark)).collect()) == len(edge.CASES) + 2


def test_em_finds_reliable_labelers():
    rnd = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = rnd.random() < 0.3
        v = tuple(int(rnd.random() < (q if y else 1 - q)) if rnd.random() < 0.8 else -1 for q in (0.95, 0.9, 0.6))
        counts[v] = counts.get(v, 0) + 1
    p, rates = P.estimate(counts)
    assert p[1, 1, -1] > 0.9 and p[0, 0, 1] < 0.2
    assert rates[0][1][1] > rates[2][1][1]


def test_redaction(spark):
    docs = edge.frame(spark, [(1, "é mail a.b@c.de, +1 (988) 555-2485 and 1.2.3.4", "en", "s"), (2, "nothing", "en", "s"), (3, None, "en", "s"),
                              (3, "é mail a.b@c.de, +1 (988) 555-2485 and 1.2.3.4", "en", "s"), (4, "+4041894974608795x 9.9.9.9", "en", "s")])
    out = P.stage(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    text = "é mail <email>, <phone> and <ip>"
    assert got == sorted([(1, text, len(text)), (2, "nothing", 7), (3, None, None), (3, text, len(text)), (4, "+<card>x <ip>", 13)], key=str)
