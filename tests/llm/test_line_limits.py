"""op1 with its own limits: hosts of every size lose lines that stand on many pages."""

import edge
from filelens.llm import line_frequency as L
from pyspark.sql import functions as F


def test_small_host_loses_its_footer(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(60)) + "\nAll rights reserved" + ("\nrare line" if i < 5 else ""), "en", "h") for i in range(50)]
    out = L.op1(edge.frame(spark, rows)).collect()
    assert len(out) == 50 and all(r["removed_words"] == 3 and r["kept"] for r in out)  # the line in five documents stays


def test_allowance_stops_growing(spark):
    n = 150_000
    text = F.when(F.col("id") < 1200, F.concat_ws("\n", F.concat(F.lit("t"), "id"), F.lit("the footer"))).when(
        F.col("id") < 2200, F.concat_ws("\n", F.concat(F.lit("t"), "id"), F.lit("less common"))).otherwise(F.concat(F.lit("t"), "id"))
    docs = spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("hot").alias("source"))
    got = {r["removed_words"]: r["n"] for r in L.op1(docs).groupBy("removed_words").agg(F.count("*").alias("n")).collect()}
    assert got == {0: n - 1200, 2: 1200}
