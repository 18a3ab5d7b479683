"""Parts of a larger sketch: only those with digests are sketched, and places are bits of one number."""

import random

from filelens.llm import paragraph_sketch as S
from pyspark.sql import functions as F


def test_places_are_one_cell_a_region(spark):
    df = spark.range(200).select(F.xxhash64("id").alias("u"))
    for cells in (S.CELLS, S.RETRY_CELLS):
        region = cells // S.HASHES
        for r in df.select(S._places(F.col("u"), cells, 3).alias("at")).collect():
            bits = [i for i in range(64) if r["at"] >> i & 1]
            assert [b // region for b in bits] == list(range(S.HASHES))


def test_differences_of_every_size(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(60):
        common = [rnd.getrandbits(62) for _ in range(rnd.randrange(40))]
        rows.append((k, common + [rnd.getrandbits(62) for _ in range(rnd.randrange(30))], common + [rnd.getrandbits(62) for _ in range(rnd.randrange(30))]))
    rows += [(60, [], []), (61, [5], []), (62, [], [5]), (63, [5], [5])]
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>")
    got = {r["k"]: r for r in S.differing(df, ["k"]).collect()}
    for k, a, b in rows:
        assert sorted(got[k]["plus"]) == sorted(set(a) - set(b)) and sorted(got[k]["minus"]) == sorted(set(b) - set(a)), k
