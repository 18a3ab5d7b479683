import re
from collections import Counter, defaultdict

import edge
import pytest
from pyspark.sql import functions as F

from filelens.llm import divergence_cube as D
from filelens.llm.queries import ORACLE, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, top=200, min_docs=3):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, s in rows:
        found = TERM.findall((t or "").translate(LOWER))
        groups.add((lang or "", s or ""))
        n[lang or "", s or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        mine = sorted(s for x, s in groups if x == lang)
        v = len(kept)

        def p(count, total):
            return 1 + 10 ** 9 * (count + 1) // (total + v)

        whole = {t: sum(n[lang, s][t] for s in mine) for t in kept}
        every = sum(whole.values())
        q = {t: p(c, every) for t, c in whole.items()}
        total = {s: sum(n[lang, s][t] for t in kept) for s in mine}
        share = {s: {t: p(n[lang, s][t], total[s]) for t in kept} for s in mine}

        def gain(x, y):
            return (x - y) ** 2 // y

        for s in mine:
            pairs = sorted((-sum(gain(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(pairs)]
            terms = sorted((-gain(share[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and share[s][t] > q[t])
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(terms[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_op13_on_documents(spark, rows, docs_dir):
    assert got(QUERIES["op13_divergence_cube"](spark, docs_dir)) == plain(rows)


@pytest.mark.parametrize("groups, terms", [(1, 50), (3, 100_000), (4, 333), (100, 7)])
def test_any_blocks_give_the_same(spark, rows, groups, terms):
    audit = D.Audit(edge.frame(spark, rows), groups=groups, terms=terms)
    want = [(a, s, item, v, r) for a, s, part, item, v, r in plain(rows) if part == "pair"]
    assert got(audit.pairs()) == want
    cells = audit.slices().groupBy("lang", "i", "j", "k").agg(F.count_distinct("grp").alias("n")).collect()
    assert max(r["n"] for r in cells) <= 2 * groups and all(r["i"] <= r["j"] for r in cells)


def test_counts_handed_on_early(spark, rows, monkeypatch):
    n = {}
    for held in (10, 10 ** 6):
        monkeypatch.setattr(D, "HELD", held)
        import pyarrow as pa
        batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), pa.array([r[1] for r in rows])], names=["l", "s", "t"])
        total = Counter()
        for b in D._counted([batch, batch]):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"]] += r["n"] * 1000 + r["docs"]
        n[held] = total
    assert n[10] == n[10 ** 6]


def test_hot_source_and_many_sources(spark):
    rows = [(i, f"Common word{i % 7} word{i % 11} own{i % 40}", "en", "hot" if i % 3 == 0 else f"s{i % 45}") for i in range(400)]
    assert got(D.op13(edge.frame(spark, rows))) == plain(rows)


def test_top_terms_are_cut(spark):
    rows = [(i, " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}x{'abcd'[i % 4]}" for k in range(260)), "en", f"s{i % 4}") for i in range(16)]
    out = got(D.op13(edge.frame(spark, rows)))
    assert out == plain(rows)
    assert max(r[5] for r in out if r[2] == "term") == 200


def test_defined_cases(spark):
    rows = edge.CASES + [edge.CASES[4], (None, "one two three", "en", "s0"), (20, None, "xx", "a"), (21, "", "xx", "b"), (22, "İstanbul É ÀB", None, None),
                         (23, "É ÀB İstanbul", None, "z"), (24, "É ÀB", None, "z"), (25, "alone", "yy", "only")]
    assert got(D.op13(edge.frame(spark, rows))) == plain(rows)
    assert got(D.op13(edge.empty(spark))) == []


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(D.share(F.lit(8 * 10 ** 14), F.lit(10 ** 16 + 7)).alias("p")).first()
    assert row["p"] == 1 + 10 ** 9 * (8 * 10 ** 14 + 1) // (10 ** 16 + 7)


def test_oracle(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(ORACLE["op13_divergence_cube"])
    df = QUERIES["op13_divergence_cube"](spark, "/root/testdata/sf0.01")
    assert sorted(df.columns) == sorted(want.columns)
    assert got(df.select(*want.columns)) == sorted(want.fetchall()) != []
