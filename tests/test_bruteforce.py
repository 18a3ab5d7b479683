"""Operators without a SQL form, checked against plain Python on small fixtures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from filelens.operators.ranking import counted_before, rank_within
from filelens.operators.stats import median_size
from filelens.plans.relocation import assign_targets


def sequential_plan(rows, existing):
    """The reference's loop: files in path order, first free stem_k.ext, names without case."""
    taken = {e.lower() for e in existing}
    out = {}
    for full_path, name, tdir in sorted(rows):
        dot = name.rfind(".")
        ext = name[dot:] if dot >= 0 and dot < len(name) - 1 else ""
        stem = name[: len(name) - len(ext)]
        cand = f"{tdir}/{name}"
        k = 1
        while cand.lower() in taken:
            cand = f"{tdir}/{stem}_{k}{ext}"
            k += 1
        taken.add(cand.lower())
        out[full_path] = cand
    return out


def test_relocation_matches_sequential_loop(spark):
    rng = random.Random(7)
    stems = ["a", "a_1", "a_2", "a_1_1", "b", "B", "b_10", "c_01", "d"]
    exts = [".txt", ".TXT", "", ".md"]
    cases = []
    for case in range(6):
        rows, existing = [], []
        for i in range(rng.randint(5, 40)):
            name = rng.choice(stems) + rng.choice(exts)
            tdir = rng.choice(["/t", "/T2"] if case % 2 else ["/t"])
            rows.append((f"/src/{i:03d}/{name}", name, tdir))
        for _ in range(rng.randint(0, 6)):
            existing.append(f"/t/{rng.choice(stems)}_{rng.randint(1, 3)}{rng.choice(exts)}")
            existing.append(f"/t/{rng.choice(stems)}{rng.choice(exts)}")
        cases.append((rows, existing))
    got, want = _plan_of_cases(spark, cases)
    assert got == want


def test_rank_within_skewed_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 20)}", f"p{rng.random():.12f}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, p string")
    got = {(r["k"], r["p"]): r["rank0"] for r in rank_within(df, ["k"], ["p"], partitions=7).collect()}
    expect = {}
    for k in {k for k, _ in rows}:
        for i, p in enumerate(sorted(p for kk, p in rows if kk == k)):
            expect[(k, p)] = i
    assert got == expect


def test_median_two_levels_exact(spark):
    rng = random.Random(11)
    for n in (0, 1, 2, 7, 1000, 1001):
        sizes = [rng.choice([rng.randint(0, 50), rng.randint(0, 5000)]) for _ in range(n)]
        df = spark.createDataFrame([(s,) for s in sizes], "size long")
        want = 0 if not sizes else (int(statistics.median_low(sizes)) if n % 2 else
                                    (sorted(sizes)[n // 2 - 1] + sorted(sizes)[n // 2]) // 2)
        # a tiny shift forces many coarse buckets and a boundary between the two middle values
        assert median_size(df, shift=3).first()[0] == want, n
        assert median_size(df, shift=2, group_bits=2).first()[0] == want, n
        assert median_size(df).first()[0] == want, n


def test_median_golden(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,)], "size long")
    assert median_size(df).first()[0] == 3
    assert median_size(df.where(F.col("size") < 9)).first()[0] == 2


def test_duplicates_with_a_hot_group(spark):
    """A third of all rows share one content: results stay exact and no window sorts the group."""
    from filelens.operators import duplicates as D
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        text = "same content" if i % 3 == 0 else f"text {rng.randint(0, 400)}"
        rows.append((f"/d{i % 17}/f{i:05d}.txt", len(text.encode()), text, i))
    df = spark.createDataFrame(rows, "full_path string, size long, content string, k long") \
        .withColumn("created", F.expr("timestampadd(SECOND, cast(k as int), timestamp_ntz'2024-01-01 00:00:00')"))
    members = D.group_members(D.digest_candidates(df))
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    hot = members.where(F.col("file_count") == 1000).select("full_path", "is_primary").collect()
    assert len(hot) == 1000 and sum(r["is_primary"] for r in hot) == 1
    assert [r["full_path"] for r in hot if r["is_primary"]] == ["/d0/f00000.txt"]
    expect = {}
    for p, s, t, _ in rows:
        expect.setdefault((s, t), []).append(p)
    n_groups = sum(1 for v in expect.values() if len(v) > 1)
    assert members.select("duplicate_group_id").distinct().count() == n_groups


def _plan_of_cases(spark, cases, partitions=None, few=64):
    """All cases in one plan: every case has target folders of its own. Also the wanted targets, by the sequential loop."""
    files, existing, want = [], [], {}
    for at, (rows, ex) in enumerate(cases):
        rows = [(f"/case{at}{p}", n, f"/case{at}{d}") for p, n, d in rows]
        ex = [f"/case{at}{e}" for e in ex]
        want.update(sequential_plan(rows, ex))
        files += [(p, n, 1, d) for p, n, d in rows]
        existing += ex
    df = spark.createDataFrame(files, "full_path string, name string, size long, target_dir string")
    ex = spark.createDataFrame([(e,) for e in existing], "full_path string")
    return {r["source"]: r["target"] for r in assign_targets(df, ex, partitions=partitions, few=few).collect()}, want


def test_related_names_match_sequential_loop_many_cases(spark):
    rng = random.Random(2024)
    stems = ["a", "a_1", "a_2", "a_3", "a_1_1", "a_1_2", "a_2_1", "a_1_1_1", "A_1", "b", "b_1", "c_01", "c_1"]
    exts = [".txt", ".TXT", ""]
    cases = []
    for _ in range(1500):
        rows, existing = [], []
        for i in range(rng.randint(1, 30)):
            name = rng.choice(stems) + rng.choice(exts)
            rows.append((f"/s/{rng.randint(0, 10 ** 6):07d}-{i}", name, rng.choice(["/t", "/t", "/u"])))
        for _ in range(rng.randint(0, 5)):
            existing.append(f"{rng.choice(['/t', '/u'])}/{rng.choice(stems)}{rng.choice(exts)}")
        cases.append((rows, existing))
    for few in (0, 64):
        got, want = _plan_of_cases(spark, cases, few=few)
        assert got == want


def _contest(rng, n_parent, n_child, taken):
    """One parent name with many files and many children, whose paths arrive in a random or a contrary order."""
    rows = [(f"/s/{rng.random():.9f}-p{i}", "r.bin", "/t") for i in range(n_parent)]
    counters = rng.sample(range(1, 2 * n_child + 2), n_child)
    slope = rng.choice([-1, 0, 1])
    for k in counters:
        place = (k / (2 * n_child + 2)) * slope % 1 * 0.7 + rng.random() * 0.3 if slope else rng.random()
        rows += [(f"/s/{place:.9f}-{k}-{i}", f"r_{k}.bin", "/t") for i in range(rng.choice([1, 1, 1, 2]))]
    return rows, [f"/t/r_{rng.randint(1, 2 * n_child + 2)}.bin" for _ in range(taken)]


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_a_contested_parent_in_many_partitions(spark, partitions):
    rng = random.Random(partitions)
    cases = [_contest(rng, n, m, t) for n, m, t in [(1, 400, 0), (40, 300, 10), (300, 300, 30), (300, 40, 5), (3, 3, 1)]]
    got, want = _plan_of_cases(spark, cases, partitions, few=3 if partitions == 5 else 64)
    assert got == want


def test_contest_steps_are_spread(spark):
    """A parent with many children: no task gets more than its share of the children."""
    from filelens.plans import relocation as R
    seen = []
    kept, R.stored_pieces = R.stored_pieces, lambda df: seen.append(kept(df)) or seen[-1]
    try:
        rows, _ = _contest(random.Random(4), 50, 2000, 0)
        got, want = _plan_of_cases(spark, [(rows, [])], 8)
    finally:
        R.stored_pieces = kept
    assert got == want
    sizes = [r["n"] for r in seen[0].groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 2000 / 7


def test_counted_before(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "a"]), rng.randrange(60)) for _ in range(900)]
    probes = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(70), i) for i in range(700)]
    r = spark.createDataFrame(rows, "k string, x int")
    p = spark.createDataFrame(probes, "k string, x int, i int")
    for ties in (False, True):
        got = {x["i"]: x["n"] for x in counted_before(r, p, ["k"], ["x"], "n", ties=ties, partitions=9).collect()}
        assert got == {i: sum(kk == k and (v < x or (ties and v == x)) for kk, v in rows) for k, x, i in probes}


def test_release_materialized(spark):
    from filelens.operators.common import materialize, release_materialized
    df = materialize(spark.range(10))
    assert df.count() == 10
    assert release_materialized(spark) >= 1


def test_related_names_many_files_per_name(spark):
    rng = random.Random(77)
    stems = ["r", "r_1", "r_2", "r_5", "r_1_1", "r_1_2", "r_2_1", "q", "q_3"]
    cases = []
    for _ in range(120):
        rows = []
        weights = [rng.random() ** 3 for _ in stems]
        for i in range(rng.randint(50, 300)):
            name = rng.choices(stems, weights)[0] + ".bin"
            rows.append((f"/s/{rng.random():.9f}-{i}", name, "/t"))
        cases.append((rows, [f"/t/{rng.choice(stems)}_{rng.randint(1, 6)}.bin" for _ in range(rng.randint(0, 8))]))
    got, want = _plan_of_cases(spark, cases, 6)
    assert got == want


def test_empty_inputs(spark):
    from filelens.operators import duplicates as D
    from filelens.operators import stats as S
    from filelens.plans.relocation import assign_targets
    files = spark.createDataFrame([], "full_path string, name string, size long, target_dir string")
    assert assign_targets(files).count() == 0
    inv = spark.createDataFrame([], "full_path string, size long, content string, created timestamp_ntz, "
                                    "modified timestamp_ntz, directory string, extension string")
    assert D.duplicate_summary(D.duplicate_groups(D.digest_candidates(inv))).first()[0] == 0
    assert S.median_size(inv).first()[0] == 0
    assert S.totals(inv).first()["average_size"] == 0
    assert [r["file_count"] for r in S.size_histogram(inv).collect()] == [0] * 6


def test_rank_within_default_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), f"p{i:05d}") for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, p string")
    got = {(r["k"], r["p"]): r["rank0"] for r in rank_within(df, ["k"], ["p"]).collect()}
    for k in {"hot", "a", "b"}:
        ps = sorted(p for kk, p in rows if kk == k)
        assert [got[(k, p)] for p in ps] == list(range(len(ps)))
