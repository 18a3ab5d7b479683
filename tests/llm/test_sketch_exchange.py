"""op9's two joins by document share one exchange of the texts."""

import edge
from filelens.llm import paragraph_sketch as P


def test_texts_are_shuffled_once(spark, rows, monkeypatch):
    plans = []

    def noted(df, write=P.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(P, "materialize", noted)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert P.op9(edge.frame(spark, rows[:200])).count() == 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    joined = next(p for p in plans if p.count("SortMergeJoin") >= 2)
    assert any("ReusedExchange [text" in line for line in joined.split("\n"))
