"""Properties of the operators on the driver's tables (survey §5 layer 4)."""

import pytest
from pyspark.sql import functions as F

from filelens import catalog as K
from filelens import fixtures as X
from filelens.operators import duplicates as D
from filelens.operators import hierarchy as H
from filelens.operators import stats as S
from filelens.plans import safety as SAFE

SF = "/root/testdata/sf0.01"


def _groups(df):
    return {(r["duplicate_group_id"], r["size"], r["file_count"]) for r in df.collect()}


def test_prefilter_does_not_change_groups(spark, sf_small):
    docs = X.inv_docs(spark, sf_small)
    a = D.duplicate_groups(D.digest_candidates(docs, "accurate"))
    b = D.duplicate_groups(D.digest_candidates(docs, "full"))
    assert _groups(a) == _groups(b)


def test_accurate_groups_lie_inside_fast_groups(spark):
    docs = X.inv_docs(spark, SF)
    acc = D.group_members(D.digest_candidates(docs, "accurate"))
    partial = D.digest_candidates(docs, "fast", chunk=16, threshold=256)
    fast = D.group_members(partial)
    pairs = (acc.select("full_path", F.col("duplicate_group_id").alias("a"))
             .join(fast.select("full_path", F.col("duplicate_group_id").alias("f")), "full_path", "left"))
    assert pairs.where(F.col("f").isNull()).count() == 0
    assert pairs.groupBy("a").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0


def test_one_primary_per_group_and_oldest(spark):
    docs = X.inv_docs(spark, SF)
    m = D.group_members(D.digest_candidates(docs))
    per = m.groupBy("duplicate_group_id").agg(F.count_if("is_primary").alias("p")).collect()
    assert per and all(r["p"] == 1 for r in per)
    created = docs.select("full_path", "created")
    j = m.join(created, "full_path")
    oldest = j.groupBy("duplicate_group_id").agg(F.min("created").alias("c"))
    prim = j.where("is_primary").select("duplicate_group_id", F.col("created").alias("pc"))
    assert prim.join(oldest, "duplicate_group_id").where("pc <> c").count() == 0


def test_sf001_expected_numbers(spark):
    row = K.registry()["duplicate_summary"](spark, SF).first()
    assert (row["duplicate_groups"], row["duplicate_files"], row["wasted_bytes"]) == (62, 135, 163961)
    assert K.registry()["hash_candidates"](spark, SF).count() == 323


def test_histogram_sums_to_count(spark):
    inv = X.inv_orders(spark, SF)
    h = [r["file_count"] for r in S.size_histogram(inv).orderBy("bucket_ord").collect()]
    assert h == [2682, 2639, 2519, 2522, 2501, 2137]
    assert sum(h) == inv.count()


def test_root_directory_size_is_total(spark):
    inv = X.inv_orders(spark, SF)
    sizes = H.directory_sizes(inv)
    total = inv.agg(F.sum("size")).first()[0]
    assert sizes.where("directory = '/'").first()["total_size"] == total == 768186172771
    assert sizes.where("directory = '/lake/orders'").first()["file_count"] == 15000


def test_safe_selection_keeps_a_member_of_every_group(spark):
    docs = X.inv_docs(spark, SF)
    m = D.group_members(D.digest_candidates(docs))
    sel = X.selection(spark, SF)
    assert SAFE.unsafe_groups(m, sel).count() == 22
    safe = SAFE.safe_selection(m, sel)
    kept = m.join(safe, "full_path", "left_anti").select("duplicate_group_id").distinct().count()
    assert kept == m.select("duplicate_group_id").distinct().count()


def test_plan_targets_unique_and_free(spark):
    plan = K.registry()["staging_plan"](spark, SF)
    existing = {r[0].lower() for r in K._staging_existing(spark, SF).collect()}
    targets = [r["target"].lower() for r in plan.collect()]
    assert len(targets) == len(set(targets))
    assert not set(targets) & existing


def test_fast_mode_verify_removes_false_positives(spark):
    docs = X.inv_docs(spark, SF)
    fast = D.digest_candidates(docs, "fast", chunk=8, threshold=64)
    verified = D.verify_groups(fast, docs)
    acc = D.duplicate_groups(D.digest_candidates(docs, "accurate"))
    assert _groups(D.duplicate_groups(verified)) == _groups(acc)


def test_approx_options(spark, sf_small):
    inv = X.inv_orders(spark, sf_small)
    exact = S.totals(inv).first()["total_directories"]
    approx = S.totals(inv, approx_directories=True).first()["total_directories"]
    assert abs(approx - exact) <= max(3, exact * 0.1)
    assert S.median_size_approx(inv).first()[0] >= 0


def test_plan_selection_reports_missing_sources(spark, sf_small):
    from filelens.plans import relocation as R
    docs = X.inv_docs(spark, sf_small, with_content=False)
    sel = docs.select("full_path").unionByName(spark.createDataFrame([("/lake/missing.txt",)], "full_path string"))
    plan = R.plan_selection(docs, sel, "copy", destination="/backup")
    summary = R.plan_summary(plan).first()
    assert summary["failed_files"] == 1 and summary["planned_files"] == docs.count()
    assert summary["planned_bytes"] == docs.agg(F.sum("size")).first()[0]


def test_no_exchange_carries_content(spark, sf_small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = X.inv_docs(spark, sf_small)
        digested = D.digest_candidates(docs)
        for df in (D.duplicate_groups(D.column_digests(docs)), D.group_members(digested),
                   D.verify_groups(D.digest_candidates(docs, "fast", chunk=8, threshold=64), docs)):
            plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()
            tree = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
            joins = [i for i, line in enumerate(tree) if "Join" in line or "Aggregate" in line]
            digests = [i for i, line in enumerate(tree) if "md5(" in line]
            assert digests and joins and min(digests) > min(joins) and "Join" not in "".join(tree[max(digests):]), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_size_and_hot_group_are_salted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(6000).selectExpr("concat('/f', id) AS full_path", "if(id % 3 = 0, 7, id) AS size", "'h' AS hash",
                                            "timestamp_ntz'2024-01-01 00:00:00' AS created")
        for df in (D.hash_candidates(rows), D.with_group(rows)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            keys = [line for line in plan.splitlines() if "hashpartitioning" in line and "_salt" in line]
            assert len(keys) >= 2, plan
        assert D.hash_candidates(rows).where("size = 7").count() == 2001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_files_and_unknown_ages(spark):
    """No upper bound for hashing; a file of unknown age is never the one to keep."""
    rows = spark.createDataFrame([("/b", 1 << 40, "H", None), ("/c", 1 << 40, "H", "2020-01-01 00:00:00"), ("/a", 5, "S", None), ("/d", 5, "S", None)],
                                 "full_path string, size long, hash string, created string").withColumn("created", F.col("created").cast("timestamp_ntz"))
    assert D.hash_candidates(rows).count() == 4 and D.hash_candidates(rows, max_size=100).count() == 2
    got = {r["full_path"]: r["is_primary"] for r in D.group_members(rows).collect()}
    assert got == {"/b": False, "/c": True, "/a": True, "/d": False}


def test_plans_do_not_overwrite(spark):
    from filelens.plans import relocation as R
    inv = spark.createDataFrame([("/a/x.txt", "x.txt", "/a", 1), ("/backup/x.txt", "x.txt", "/backup", 2), ("/backup/x_1.txt", "x_1.txt", "/backup", 3)],
                                "full_path string, name string, directory string, size long")
    plan = R.plan_selection(inv, inv.where("size = 1").select("full_path"), "copy", destination="/backup").collect()
    assert [r["target"] for r in plan] == ["/backup/x_2.txt"]


def test_shared_folder_is_needed_off_one_machine(monkeypatch):
    from types import SimpleNamespace

    from filelens.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda key, default=None: default, set=None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        sc = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_pages_follow_each_other(spark, sf_small):
    from filelens.operators import filters as FL
    inv = X.inv_orders(spark, sf_small)
    first = FL.grid_page(inv, limit=700).collect()
    second = FL.grid_page(inv, limit=700, after=first[-1]["full_path"]).collect()
    paths = sorted(r["full_path"] for r in inv.select("full_path").collect())
    assert [r["full_path"] for r in first + second] == paths[:1400] and first[0]["total_matches"] == len(paths)


def test_search_is_literal_not_a_pattern(spark):
    from filelens.operators import filters as FL
    inv = spark.createDataFrame([("/a/axb.txt", "axb.txt", ".txt", "/a"), ("/a/a_b.txt", "a_b.txt", ".txt", "/a"),
                                 ("/a/a%b.TXT", "a%b.TXT", ".txt", "/a")],
                                "full_path string, name string, extension string, directory string")
    assert [r[0] for r in FL.find_files(inv, "A_B", "name").select("full_path").collect()] == ["/a/a_b.txt"]
    assert [r[0] for r in FL.find_files(inv, "%B", "name").select("full_path").collect()] == ["/a/a%b.TXT"]
    assert FL.search(inv, "  \t ").count() == 3


def test_stored_inventory_is_path_ordered_and_complete(spark, sf_small):
    import tempfile
    from filelens.sinks.inventory_table import read_inventory, write_inventory
    inv = X.inv_orders(spark, sf_small)
    path = write_inventory(inv, tempfile.mkdtemp(prefix="filelens-inv-") + "/inv", partitions=4)
    back = read_inventory(spark, path)
    assert back.count() == inv.count() and "content" not in back.columns
    # each file covers a path range: the per-file ranges do not overlap
    ranges = sorted((r["lo"], r["hi"]) for r in back.groupBy(F.input_file_name().alias("f"))
                    .agg(F.min("full_path").alias("lo"), F.max("full_path").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_inventory_after_moves(spark, sf_small):
    from filelens.plans import relocation as R
    docs = X.inv_docs(spark, sf_small, with_content=False).select("full_path", "name", "directory", "size")
    plan = R.move_plan(docs.where(F.col("size") > 3000), "/moved", R.files_below(docs, "/moved"))
    after = R.inventory_after_moves(docs, plan)
    assert after.count() == docs.count()
    moved = after.where(F.col("directory") == "/moved").count()
    assert moved == docs.where(F.col("size") > 3000).count()
    assert after.select("full_path").distinct().count() == docs.count()
