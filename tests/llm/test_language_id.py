import zlib

import edge
from filelens.llm import language_id as G


def test_held_out_accuracy(spark, rows):
    got = {r["doc_id"]: r for r in G.op6(edge.frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    right = total = 0
    for i, _, lang, _ in rows:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i]["held_out"] == held and 0 <= got[i]["score"] <= 1
        if held:
            total += 1
            right += got[i]["lang_pred"] == lang
    assert total > 20 and right / total >= 0.95


def test_backoff_is_word_first():
    m = G.Model([("a", 0, "xyz", 5), ("b", 0, "xyq", 5), ("a", 3, "xyz", 1), ("b", 2, "xy", 9), ("a", 1, "x", 1), ("b", 1, "q", 4)])
    assert m.predict("XYZ")[0] == "a" and m.predict("xyq")[0] == "b"
    assert m.predict("xyzw")[0] == "a"  # by its 3-gram
    assert m.predict("xyw")[0] == "b"  # no 3-gram known: by the 2-gram
    assert m.predict("x")[0] == "a" and m.predict("q")[0] == "b"
    assert m.predict("")[0] == m.predict(None)[0] == m.predict("12 -- ½")[0] == "und"


def test_cases(spark):
    rows = [*edge.CASES, edge.CASES[4], (None, "one two three four five", "en", "s0")]
    got = G.op6(edge.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 12))
    assert by[6]["lang_pred"] == by[7]["lang_pred"] in ("en", "de", "fr")
    assert G.op6(edge.empty(spark)).collect() == []
    alone = G.op6(edge.frame(spark, [(1, "text", None, "s")])).collect()
    assert [r["lang_pred"] for r in alone] == ["und"]


def test_stage_keeps_columns(spark, rows):
    docs = edge.frame(spark, rows)
    out = G.stage(docs)
    assert out.columns == docs.columns and out.count() > 0.97 * len(rows)
