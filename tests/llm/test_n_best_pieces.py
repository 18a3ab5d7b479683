"""The N best segmentations themselves, not their scores alone."""

import random

import edge
import numpy as np
import pytest
from filelens.llm import piece_lattice as P


@pytest.fixture(scope="module")
def lat():
    return P.Lattice(P.vocabulary_path(), 3)


def every(lat, s):
    """The best of all (score, ids) of a prepared string by enumeration."""
    edges = lat._edges(s)
    sums = [[(0.0, ())]] + [[] for _ in s]
    for j in range(1, len(s) + 1):
        found = [(x + w, ids + (p if isinstance(p, tuple) else (p,))) for i, p, w in edges[j] for x, ids in sums[i]]
        sums[j] = sorted(found, reverse=True)[:50]
    return sums[-1]


def test_segmentations_equal_enumeration(lat):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("thersanod e,.é漢") for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    for t in [*texts, "the thing and the other thing is here. and there", "a b", "aa aa aa", ""]:
        got, want = lat.segmentations(t), every(lat, P.prepared(t))
        assert np.allclose([x for x, _ in got], [x for x, _ in want[:3]])
        assert len({tuple(ids) for _, ids in got}) == len(got)
        scores = {ids: x for x, ids in want}
        assert all(lat.decode(ids) == t and abs(scores[tuple(ids)] - x) < 1e-9 for x, ids in got)


def test_all_are_returned(spark, rows):
    out = P.encode(edge.frame(spark, rows[:100])).collect()
    lat = P.lattice(P.vocabulary_path(), P.N_BEST)
    assert sum(len(r["others"]) for r in out) > 150
    for r in out:
        assert len(r["others"]) == len(r["scores"]) - 1
        assert all(lat.decode(ids) == (r["text"] or "") and list(ids) != list(r["ids"]) for ids in r["others"])
    assert "others_hash" in P.op8(edge.frame(spark, rows[:5])).columns
