import math
from collections import Counter, defaultdict

import edge
import pytest
from filelens.llm import source_mixing as M


def words(t):
    import re
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shares(rows):
    tokens = defaultdict(int)
    for _, t, _, s in rows:
        tokens[s or ""] += words(t)
    return tokens


def skewed(rows):
    return [(i, t, lang, "big" if i % 3 else s) for i, t, lang, s in rows]


@pytest.mark.parametrize("target", [{"max_repeats": 1.7}, {"max_repeats": 100.0}, {"target_entropy": 2.2}, {"budget_tokens": 30_000, "max_repeats": 3.0}])
def test_weights_and_budgets(spark, rows, target):
    rows = skewed(rows)
    out = M.mix(edge.frame(spark, rows), blocks=16, **target).collect()
    tokens = shares(rows)
    total = sum(tokens.values())
    lo, hi = 0.0, 1.0
    for _ in range(60):  # plain bisection
        a = (lo + hi) / 2
        z = sum((t / total) ** a for t in tokens.values())
        w = {s: (t / total) ** a / z for s, t in tokens.items()}
        entropy = -sum(x * math.log(x) for x in w.values())
        most = max(w[s] / tokens[s] for s in w) / min(w[s] / tokens[s] for s in w)
        good = entropy <= target["target_entropy"] if "target_entropy" in target else most <= target["max_repeats"]
        lo, hi = (lo, a) if good else (a, hi)
    budget = target.get("budget_tokens") or max(tokens[s] / w[s] for s in w)
    got, block = defaultdict(int), defaultdict(int)
    for r in M.keyed(edge.frame(spark, rows), blocks=16).collect():
        block[r["mix_source"], r["mix_block"]] += r["mix_tokens"]
    for r in out:
        assert abs(r["mix_weight"] - w[r["source"]]) < 1e-5 and 0 <= r["mix_order"] < 1
        got[r["source"]] += r["mix_tokens"]
    for s in tokens:
        largest = max(v for k, v in block.items() if k[0] == s)
        assert w[s] * budget - largest < got[s] <= w[s] * budget * (1 + 1e-6)
    if "budget_tokens" not in target:
        assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    # an epoch shows a row once, and complete epochs come first
    seen = Counter((r["doc_id"], r["mix_epoch"]) for r in out)
    assert set(seen.values()) == {1}


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", " a\t\nb  c ", "a b", "\x85 b"]
    got = edge.frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).select("doc_id", M.word_count("text")).collect()
    assert {r[0]: r[1] for r in got} == {i: words(t) for i, t in enumerate(texts)}


def test_cases(spark):
    docs = edge.cases(spark)
    out = M.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert set(got) == {r[0] for r in edge.CASES} | {None}
    assert M.op10(edge.empty(spark)).collect() == []
    alone = M.op10(edge.frame(spark, [(1, None, "en", "s"), (2, "", "en", "t")])).collect()
    assert sorted(r["doc_id"] for r in alone) == [1, 2]
    assert M.stage(docs).columns == docs.columns
