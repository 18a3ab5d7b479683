"""The near-dedup stage on rows that share a doc_id."""

import edge
from filelens.llm import near_dedup as N


def test_unrelated_texts_of_one_id_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = edge.frame(spark, [(1, a, "en", "s"), (1, b, "en", "s"), (1, b, "en", "s"), (2, "c " + a, "en", "s"), (3, None, "en", "s"), (3, None, "en", "s")])
    out = N.stage(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(1, a), (1, b), (3, None)]


def test_columns_may_have_any_name(spark):
    docs = edge.frame(spark, [(1, "one two three four five six", "en", "s"), (2, "one two three four five six", "en", "s")])
    docs = docs.withColumnRenamed("label", "kept_id").withColumnRenamed("n_words", "component_id")
    assert [(r["doc_id"], r["kept_id"]) for r in N.stage(docs).collect()] == [(1, 7)]


def test_stage_takes_five_words(spark):
    words = [f"w{k}" for k in range(90)]
    other = list(words)
    other[20] = other[60] = "changed"  # 79 of 95 four-word shingles are shared, 76 of 96 five-word ones
    docs = edge.frame(spark, [(1, " ".join(words), "en", "s"), (2, " ".join(other), "en", "s")])
    assert {r["doc_id"] for r in N.stage(docs).collect()} == {1, 2}
    assert {r["doc_id"] for r in N.stage(docs, width=4).collect()} == {1}
