import hashlib
import random
from collections import defaultdict

import edge
import numpy as np
import pytest

from filelens.llm import line_index as L
from filelens.llm.queries import ORACLE, QUERIES

LAST = (1 << 63) - 1


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def plain(rows):
    """doc_id, n_lines, n_dropped, kept text of every row, from the rule itself."""
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(LAST if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) != (LAST if i is None else i))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


def lines_corpus(seed, n=120):
    rng = random.Random(seed)
    pool = [f"shared line number {k} of all" for k in range(30)] + ["short", "", "  ", "ÄÖÜäöüßñéà", "Ünïcode line that is long", "x" * 9]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(8))]
        if i % 3 == 0:
            lines.append(rng.choice(["A footer that a third of all documents hold", "\ta footer that a third OF all documents hold \r"]))
        rows.append((i, "\n".join(lines), "en", "s0"))
    return rows


def state(index):
    refs = sorted(tuple(r) for r in index.refs.select("hi", "lo", "n_refs", "first_doc", "last_doc").collect())
    items = {r["kind"]: r["n"] for r in index.filters.groupBy("kind").agg({"n_items": "sum"}).withColumnRenamed("sum(n_items)", "n").collect()}
    return refs, items.get("seen", 0), items.get("shared", 0)


@pytest.mark.parametrize("n", [1, 50, 5000, 60_000])
def test_filter_inserts_finds_and_deletes(n):
    rng = np.random.default_rng(n)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, n)
    g = L.Generations()
    g.insert(hashes[: n // 3])
    g.insert(hashes[n // 3:])
    assert g.has(hashes).all()
    assert g.has(rng.integers(-(1 << 63), (1 << 63) - 1, 100_000)).mean() < 0.002
    g.delete(hashes[::2])
    assert g.has(hashes[1::2]).all()
    assert g.has(hashes[::2]).mean() < 0.01 + (n < 50)
    g.delete(hashes[1::2])
    assert g.parts == [] and not g.has(hashes).any()


def test_filter_keeps_copies_of_one_fingerprint():
    c = L.Cuckoo(64)
    same = np.full(6, 1 << 50, dtype=np.int64)
    c.insert(same)
    c.delete(same[:5])
    assert c.has(same).all()
    c.delete(same[:1])
    assert not c.has(same).any() and c.items == 0
    with pytest.raises(KeyError):
        c.delete(same[:1])


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_rule(spark, seed):
    rows = lines_corpus(seed)
    docs = edge.frame(spark, rows).repartition(5)
    assert got(L.clean(L.build(docs), docs)) == plain(rows)


def test_without_broadcast_filters(spark):
    rows = lines_corpus(3)
    docs = edge.frame(spark, rows)
    index = L.build(docs)
    a = {(r["doc"], frozenset(map(bytes, r["lost"]))) for r in index.drops(index.docs).collect()}
    b = {(r["doc"], frozenset(map(bytes, r["lost"]))) for r in index.drops(index.docs, filter_bytes=0).collect()}
    assert a == b != set()


def test_insertions_and_deletions_are_reversible(spark):
    rows = lines_corpus(4)
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    keys = [L.document_keys(edge.frame(spark, p)) for p in parts]
    one = L.LineIndex.begin(spark).insert(keys[0])
    two = one.insert(keys[1])
    three = two.insert(keys[2])
    whole = L.build(edge.frame(spark, rows))
    assert state(three) == state(whole)
    back = three.delete(edge.frame(spark, parts[2]))
    assert state(back) == state(two)
    # the first holder of a line goes: the next one keeps it
    left = rows[40:]
    after = three.delete(edge.frame(spark, rows[:40]))
    assert got(L.clean(after, edge.frame(spark, left))) == plain(left)
    assert state(after) == state(L.build(edge.frame(spark, left)))
    again = after.insert(L.document_keys(edge.frame(spark, rows[:40])))
    assert got(L.clean(again, edge.frame(spark, rows))) == plain(rows)
    nothing = after.delete(edge.frame(spark, left))
    assert state(nothing) == ([], 0, 0)


def test_saved_index_reads_back(spark, tmp_path):
    rows = lines_corpus(5, 30)
    index = L.build(edge.frame(spark, rows))
    index.save(str(tmp_path / "i"))
    back = L.LineIndex.load(spark, str(tmp_path / "i"))
    assert state(back) == state(index) and back.shards == index.shards
    assert got(L.clean(back, edge.frame(spark, rows))) == plain(rows)


def test_defined_cases(spark):
    rows = edge.CASES + [edge.CASES[4], (None, "a line without an id\nx", "en", "s0"), (13, "a line without an id", "en", "s0"),
                         (14, "twice in one text\ntwice in one text", "en", None)]
    docs = edge.frame(spark, rows)
    assert got(L.clean(L.build(docs), docs)) == plain(rows)
    none = edge.empty(spark)
    assert got(L.clean(L.build(none), none)) == []


def test_op12_on_documents(spark, rows, docs_dir):
    out = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_line_index"](spark, docs_dir).collect()}
    assert out == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain(rows)}
    assert any(x[1] for x in out.values())


def test_oracle(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(ORACLE["op12_line_index"])
    df = QUERIES["op12_line_index"](spark, "/root/testdata/sf0.01")
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall()) != []
