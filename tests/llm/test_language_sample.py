"""The training sample holds every language, and texts that the model knows nothing of are not judged by 1 / languages."""

import random
import zlib

import edge
import pytest
from filelens.llm import language_id as G


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def texts(letters, n, start, lang):
    rnd = random.Random(start)
    words = ["".join(rnd.choices(letters, k=5)) for _ in range(40)]
    return [(start + i, " ".join(rnd.choices(words, k=12)), lang, "s") for i in range(n)]


@pytest.fixture
def uneven():
    """Three large languages and one with a script of its own and 40 rows."""
    return (texts("abcdef", 900, 0, "xa") + texts("ghijkl", 900, 1000, "xb") + texts("mnopqr", 900, 2000, "xc")
            + texts("あいうえおか", 40, 3000, "ja"))


def test_small_language_is_learned(spark, uneven):
    docs = edge.frame(spark, uneven)
    model = G.fit(docs.where(G.remainder("doc_id", 4) != 2), 60)
    assert model.langs == ["ja", "xa", "xb", "xc"]
    small = [(i, t) for i, t, lang, _ in uneven if lang == "ja"]
    assert any(held(i) for i, _ in small)
    assert all(model.predict(t)[0] == "ja" for i, t in small if held(i))
    # all 30 or so of its training rows, not 60 / 2,000 of them
    known = {w for w in model.rows[0] if w[0] >= "あ"}
    assert known >= {w for i, t in small if not held(i) for w in t.split() if sum(w in x.split() for j, x in small if not held(j)) > 1}


def test_text_without_known_grams_stays(spark, uneven):
    odd = (9000, "привет мир", None, "s")
    out = {r["doc_id"] for r in G.stage(edge.frame(spark, [*uneven, odd, (9001, "12 34", None, "s"), (9002, None, "xa", "s")])).collect()}
    assert 9000 in out and not out & {9001, 9002}


def test_quota():
    assert G.quota([5, 5, 5], 100, 10) >= 5 and G.quota([], 100, 10) == 10
    assert G.quota([40, 5000, 5000], 1000, 10) == 480  # 40 + 480 + 480
    assert G.quota([1000] * 1000, 1000, 10) == 10
    assert G.quota([6000], 6000, 100) >= 6000 and G.quota([2000, 4000], 6000, 100) >= 4000
