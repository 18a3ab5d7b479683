import random

import edge
import numpy as np
import pytest
from filelens.llm import piece_lattice as P

TEXTS = ["", " ", "   ", "hello world", " a  b ", "\n\n x", "▁ x▁y", "é漢\U0001f600", "", "tab\there", "and and and"]


@pytest.fixture(scope="module")
def lat():
    return P.Lattice(P.vocabulary_path(), 3)


def every(lat, s):
    """Scores of all segmentations of a prepared string."""
    edges = lat._edges(s)
    sums = [[0.0]] + [[] for _ in s]
    for j in range(1, len(s) + 1):
        sums[j] = sorted((x + w for i, _, w in edges[j] for x in sums[i]), reverse=True)[:50]
    return sums[-1]


def test_n_best_equals_enumeration(lat):
    rnd = random.Random(3)
    for _ in range(60):
        s = P.prepared("".join(rnd.choice("thersanod e,.é漢") for _ in range(rnd.randrange(1, 11))))
        assert np.allclose([g[0] for g in lat.search(s)], every(lat, s)[:3])
    for t in ("the thing and the other thing is here. and there", "thereandthen" * 12, "a b"):
        ids, scores = lat.encode(t)
        assert np.allclose(scores, every(lat, P.prepared(t))[:3])
        got = [g for g in lat.search(P.prepared(t))] if " " not in t else []
        for score, other in got:
            assert lat.decode(other) == t


def test_many_cuts_at_once_equal_the_search(lat, rows):
    cuts = sorted({c for _, t, *_ in rows for c in P._CUT.findall(P.prepared(t or ""))} | {P.prepared(x) for x in ("aaaa", "the", "   ", "abababab")})[:4000]
    fresh = P.Lattice(P.vocabulary_path(), 3)
    fresh._learn(cuts)
    for c in cuts:
        row, got = fresh.memo[c], lat.search(c)
        assert abs(fresh.scores[row, 0] - got[0][0]) < 1e-9
        assert np.isinf(fresh.scores[row, 1]) if len(got) == 1 else abs(fresh.scores[row, 1] - (got[0][0] - got[1][0])) < 1e-9
        ids = np.frombuffer(fresh.best[row], "<i4").tolist()
        assert ids == list(got[0][1]) or abs(got[0][0] - got[1][0]) < 1e-9


def test_exact_round_trip(lat, rows):
    for t in TEXTS + [t for _, t, *_ in rows]:
        ids, scores = lat.encode(t)
        assert lat.decode(np.frombuffer(ids, "<i4").tolist()) == t
        assert scores == sorted(scores, reverse=True) and 1 <= len(scores) <= 3


def test_query(spark, rows):
    for docs, n in ((edge.frame(spark, rows), len(rows)), (edge.cases(spark), len(edge.CASES) + 2), (edge.empty(spark), 0)):
        got = P.op8(docs).collect()
        assert len(got) == n and all(r["round_trip"] for r in got)
    by = {r["doc_id"]: r for r in P.op8(edge.cases(spark)).collect()}
    assert by[1]["n_pieces"] == by[2]["n_pieces"] == 0 and by[1]["score"] == 0 and by[1]["n_best"] == 1
    assert by[6]["ids_hash"] == by[7]["ids_hash"]
