"""How much the digest steps read, hash and repeat."""

import codecs
import random

import pytest
from pyspark.sql import functions as F

from filelens.operators import duplicates as D
from filelens.operators.membership import bits_for, may_hold, membership
from filelens.sources import content as CT


def _texts(spark, n=2000):
    """Large texts of equal size whose partial digests mostly differ; some share the partial digest only, some all of it."""
    def text(i):
        kind = i % 50
        head = {0: "same head", 1: "near head"}.get(kind, f"own head {i:06d}")
        middle = f"{i:06d}" if kind == 1 else "000000"
        return head.ljust(40, ".") + "x" * 50 + middle + "x" * 150 + "y" * 200
    rows = [(f"/f{i:05d}", text(i), i) for i in range(n)] + [(f"/s{i}", f"tiny{i % 7}", i) for i in range(40)]
    return (spark.createDataFrame(rows, "full_path string, content string, i int")
            .selectExpr("full_path", "content", "cast(octet_length(content) as long) as size",
                        "timestampadd(SECOND, i, timestamp_ntz'2024-01-01 00:00:00') as created"))


def test_only_suspected_content_is_hashed_in_full(spark):
    inv = _texts(spark)
    fast = D.digest_candidates(inv, "fast", chunk=32, threshold=100, checkpoint=True)
    asked = D.content_suspects(fast, inv)
    total, hashed = (df.agg(F.sum("size")).first()[0] for df in (inv, asked))
    must = inv.where("full_path like '/f%' and (cast(substr(full_path, 3) as int) % 50) < 2").agg(F.sum("size")).first()[0]
    assert must <= hashed <= must + 0.1 * total  # the rest passes by chance only
    got = {tuple(r) for r in D.duplicate_groups(D.verify_groups(fast, inv)).collect()}
    want = {tuple(r) for r in D.duplicate_groups(D.digest_candidates(inv, "full")).collect()}
    assert got == want and len(want) == 8
    assert D.fast_parameters(fast) == (32, 100)
    # full digests have nothing to verify
    full = D.digest_candidates(inv, "full")
    assert {tuple(r) for r in D.duplicate_groups(D.verify_groups(full, inv)).collect()} == want


def test_only_suspected_files_are_read_in_full(spark, tmp_path):
    rng = random.Random(3)
    for i in range(30):
        body = bytes(rng.randrange(256) for _ in range(3000)) if i % 3 else b"h" * 1000 + bytes([i % 2]) * 200 + b"t" * 1800
        (tmp_path / f"f{i}").write_bytes(body)
    files = spark.createDataFrame([(str(p), p.stat().st_size) for p in tmp_path.iterdir()], "full_path string, size long") \
        .withColumn("created", F.lit(None).cast("timestamp_ntz"))
    fast = CT.file_digests(files, mode="fast", chunk=100, threshold=1000).persist()
    members = D.suspected_members(fast)
    assert {r["full_path"].rsplit("f", 1)[1] for r in members.collect()} == {str(i) for i in range(0, 30, 3)}
    groups = D.duplicate_groups(D.verify_groups(fast, digests=CT.file_digests(members))).collect()
    assert sorted(r["file_count"] for r in groups) == [5, 5]
    fast.unpersist()


@pytest.mark.parametrize("n", [0, 1, 700, 20_000])
def test_membership_holds_every_key(spark, n):
    keys = spark.range(n).select(F.col("id").alias("a"), F.concat(F.lit("k"), "id").alias("b"))
    bits = bits_for(n)
    others = spark.range(50_000).select((F.col("id") + 10 ** 9).alias("a"), F.lit("z").alias("b"))
    test = may_hold(membership(keys, ["a", "b"], bits), ["a", "b"], bits)
    assert keys.where(test).count() == n
    assert others.where(test).count() < 0.1 * 50_000


def test_only_hot_keys_are_repeated(spark):
    rows = spark.range(60_000).selectExpr("concat('/f', id) AS full_path", "if(id % 3 = 0, 7, 100 + id div 6) AS size", "'h' AS hash",
                                          "timestamp_ntz'2024-01-01 00:00:00' AS created")
    stats = D._with_heat(D.group_stats(rows), "file_count")
    assert stats.where("_hot").count() == 1 and stats.count() > 9000
    assert D._per_salt(stats).count() == stats.count() + D.SALTS - 1
    salts = D._salted(rows, stats, ["size", "hash"]).groupBy("size").agg(F.count_distinct("_salt").alias("n"))
    assert {(r["size"] == 7, r["n"]) for r in salts.collect()} == {(True, D.SALTS), (False, 1)}
    assert D.group_members(rows).count() == rows.join(stats, ["size", "hash"], "left_semi").count()


def test_digest_tasks_are_balanced_by_bytes(spark):
    """One file of 1 GB among 100,000 small ones, and sizes of every magnitude: a task has its share plus one file."""
    share = 64 << 20
    one = spark.range(100_000).selectExpr("concat('/f', id) AS full_path", "if(id = 77, 1L << 30, 3000 + id % 100) AS size")
    rng = random.Random(1)
    many = spark.createDataFrame([(f"/m{i}", int(2 ** rng.uniform(0, 31))) for i in range(3000)], "full_path string, size long")
    for files in (one, many):
        dealt = CT.byte_balanced(files, task_bytes=share)
        cost = F.col("size") + CT.FILE_COST
        tasks = dealt.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum(cost).alias("bytes"), F.max(cost).alias("most"))
        total = files.agg(F.sum(cost)).first()[0]
        got = tasks.collect()
        assert dealt.count() == files.count()
        assert all(r["bytes"] <= share + r["most"] for r in got)
        assert total / share / 2 < dealt.rdd.getNumPartitions() <= total / share + 1


def test_task_count_follows_bytes(spark):
    small = spark.range(1000).selectExpr("concat('/f', id) AS full_path", "1000 AS size")
    few, more = (CT.byte_balanced(small, task_bytes=b).rdd.getNumPartitions() for b in (1 << 40, 1 << 20))
    assert few <= 2 * spark.sparkContext.defaultParallelism and more > 50


@pytest.mark.parametrize("encoding, mark", [("utf-8", b""), ("utf-8", codecs.BOM_UTF8), ("utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", codecs.BOM_UTF16_BE),
                                            ("utf-32-le", codecs.BOM_UTF32_LE), ("utf-32-be", codecs.BOM_UTF32_BE)])
def test_preview_of_every_encoding(spark, tmp_path, encoding, mark):
    text = "Zeile ä 漢字 \U0001f600 end\n" * 40
    (tmp_path / "a.txt").write_bytes(mark + text.encode(encoding))
    path = str(tmp_path / "a.txt")
    assert CT.read_head(path, len(text)) == (text, False)
    assert CT.read_head(path, len(text) - 1) == (text[:-1], True)
    assert CT.read_head(path, 9) == (text[:9], True)


def test_preview_of_a_large_file_reads_its_head(spark, tmp_path):
    big, empty, odd = tmp_path / "big.txt", tmp_path / "empty.txt", tmp_path / "odd.txt"
    with open(big, "wb") as f:
        f.write("ß".encode() * 30_000)
        f.truncate(3 << 30)  # sparse: read whole, it would not fit a preview task
    empty.write_bytes(b"")
    odd.write_bytes(b"ok \xff\xfe\xfa tail")
    files = spark.createDataFrame([(str(p), p.stat().st_size, ".txt") for p in (big, empty, odd)], "full_path string, size long, extension string")
    got = {r["full_path"]: r["preview"] for r in CT.text_previews(files, limit_bytes=None, chars=25_000).collect()}
    assert got[str(big)].startswith("ß" * 25_000) and len(got[str(big)]) < 25_200
    assert got[str(empty)] == "" and got[str(odd)] == "ok ��� tail"
    limited = {r["full_path"]: r["preview"] for r in CT.text_previews(files, chars=5).collect()}
    assert "ß" not in limited[str(big)] and limited[str(odd)].startswith("ok ��")
