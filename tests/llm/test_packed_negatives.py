import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.llm import packed_negatives as P
from filelens.llm.queries import ORACLE, QUERIES

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.LongType()), T.StructField("slab", T.StringType()), T.StructField("pack", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)


def plain(rows):
    """The contract, row by row."""
    use = []
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab))
    out = []
    for i, v, lab in use:
        if i % 50:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, other == lab) for j, w, other in use if j != i]
        best = sorted((s for s in score if s[2]), key=lambda s: (-s[0], s[1]))[:5]
        for ps, pid, _ in best:
            neg = sorted((s for s in score if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps), key=lambda s: (-s[0], s[1]))[:3]
            out += [(i, pid, k + 1, s[1], ps, s[0]) for k, s in enumerate(neg)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("spread", [1, 90, 4000, 10 ** 7, 10 ** 12])
def test_packed_products_are_exact(spread):
    rng = random.Random(spread)
    a = np.array([[rng.randint(-spread, spread) for _ in range(37)] for _ in range(9)])
    b = np.array([[rng.randint(-spread // 3 - 5, spread) for _ in range(37)] for _ in range(23)])
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert [[int(x) for x in row] for row in P.packed_scores(a, b)] == want


def test_several_candidates_share_a_multiplication():
    assert P.EXACT_BITS // P.field_bits(64, 290, 290) == 2
    assert P.EXACT_BITS // P.field_bits(8, 60, 60) >= 3


def test_floor_of_any_double():
    xs = np.array([0.0, -0.001, 1 / 256, -1 / 256, 0.999, 1e300, -1e300, 2.0 ** 60 + 512])
    want = [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in xs]
    assert [int(x) for x in P.quantise(xs, np.array([len(xs)]))[0]] == want


def small(seed, n=400, dim=6, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.choice([rng.uniform(-1, 1), 0.25]) for _ in range(dim)], rng.choice([0, 0, 1, rng.randrange(labels)])) for i in range(n)]


@pytest.mark.parametrize("cells", [{}, {"slab_numbers": 12, "cell_numbers": 200}])
def test_equal_to_brute_force(spark, cells):
    rows = small(1)
    valid = P.valid_rows(frame(spark, rows).repartition(5))
    valid = valid.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    out = P.mine(valid, valid.where("vec_id % 50 = 0"), **cells)
    assert got(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) == plain(rows)
    assert {r["pos_rank"] for r in out.collect()} <= set(range(1, 6))


def test_ties_and_a_hot_vector(spark):
    same = [0.5, -0.25, 0.125]
    near = [0.45, -0.2, 0.1]
    rows = [(i, same if i % 3 else near, 1 if i % 4 else 2) for i in range(300)]
    assert got(P.op11(frame(spark, rows).repartition(7))) == plain(rows) != []


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = small(2, 120) + [(500, None, 1), (550, [nan, 1.0], 1), (600, [inf] * 6, 1), (650, [1.0, None], 1), (None, [1.0] * 6, 1), (700, [1.0] * 6, None),
                            (750, [], 1), (800, [0.7], 1), (850, [0.5] * 9, 2), (900, [0.0] * 6, 3), (950, [-0.9] * 6, 2), (1000, [0.3] * 6, 77)]
    assert got(P.op11(frame(spark, rows))) == plain(rows)
    assert got(P.op11(frame(spark, []))) == []


def test_wide_components_use_wider_integers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(5)], i % 3) for i in range(150)] + [(200, [3e5, 1e-9, -2.5e5, 0.0, 1.0], 1)]
    assert got(P.op11(frame(spark, rows))) == plain(rows) != []


def test_repeated_rows_of_one_id(spark):
    rows = small(3, 101, labels=2)
    out = got(P.op11(frame(spark, rows + [rows[7]])))
    groups = defaultdict(list)
    for r in out:
        groups[r[0], r[1]].append(r)
    assert out and all(len(g) <= 6 for g in groups.values())


def test_oracle(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.sql(ORACLE["op11_packed_negatives"])
    df = QUERIES["op11_packed_negatives"](spark, "/root/testdata/sf0.01")
    assert df.columns == want.columns
    assert got(df) == sorted(want.fetchall()) != []
