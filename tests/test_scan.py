"""Scratch tree (FIXTURES.md §4): the inventory source, file digests, empty folders, sinks, metrics."""

import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from filelens.operators import duplicates as D
from filelens.operators import hierarchy as H
from filelens.operators import stats as S
from filelens.sinks import report as B
from filelens.sources import content as A8
from filelens.sources import inventory_source as A
from filelens.streaming import progress as P


@pytest.fixture(scope="module")
def tree():
    root = tempfile.mkdtemp(prefix="filelens-tree-")

    def write(rel, data):
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
        return p

    write("a/x.txt", b"hello")
    write("a/b/y.TXT", b"hello")
    write("c/z.md", b"HELLO")
    write("c/zero.log", b"")
    write("_under.txt", b"under")
    write(".hid/k.txt", b"hidden!")
    write(".dotfile", b"dot")
    write("noext", b"no extension")
    rng = random.Random(5)
    big = bytes(rng.getrandbits(8) for _ in range(1_200_000))
    write("big.bin", big)
    write("copy/big copy.bin", big)
    changed = bytearray(big)
    changed[200_000] ^= 0xFF
    write("copy/big changed.bin", bytes(changed))
    os.makedirs(os.path.join(root, "empty"))
    os.makedirs(os.path.join(root, "only_dirs", "sub"))
    os.symlink(os.path.join(root, "a"), os.path.join(root, "link_to_a"))
    long_dir = os.path.join("deep", *(["d" * 40] * 6))
    write(os.path.join(long_dir, "long name, with 'quotes' and é.txt"), b"long")
    locked = write("locked/secret.txt", b"secret")
    os.chmod(os.path.dirname(locked), 0)
    yield root
    os.chmod(os.path.dirname(locked), 0o755)


def test_scan_lists_files_directories_and_rejects(spark, tree):
    entries, rejects = A.scan(spark, tree, split_depth=1, target_partitions=3)
    rows = {r["full_path"][len(tree):]: r for r in entries.collect()}
    assert rows[""]["is_dir"]  # root counted
    for rel in ["/a/x.txt", "/a/b/y.TXT", "/c/zero.log", "/_under.txt", "/.hid/k.txt", "/noext", "/big.bin"]:
        assert rel in rows and not rows[rel]["is_dir"], rel
    assert rows["/c/zero.log"]["size"] == 0
    assert rows["/a/b/y.TXT"]["extension"] == ".txt" and rows["/noext"]["extension"] == ""
    # hidden is an attribute of the entry itself (a dot name here), not inherited
    assert rows["/.hid"]["is_hidden"] and not rows["/.hid/k.txt"]["is_hidden"] and rows["/.dotfile"]["is_hidden"]
    assert rows["/empty"]["is_dir"] and rows["/only_dirs/sub"]["is_dir"]
    # the linked directory is listed but not entered
    assert rows["/link_to_a"]["is_link"] and not any(k.startswith("/link_to_a/") for k in rows)
    assert any(len(k) > 260 for k in rows)
    if os.geteuid() != 0:
        assert rejects.count() >= 1


def test_variants(spark, tree):
    entries, _ = A.scan(spark, tree)
    files = A.files_of(entries)
    assert A.visible_only(files).where(F.col("name") == ".dotfile").count() == 0
    assert A.visible_only(files).where(F.col("name") == "k.txt").count() == 1
    assert A.directories(entries, include_root=False, root=tree).where(F.col("full_path") == tree).count() == 0
    probes = spark.createDataFrame([(os.path.join(tree, "a/x.txt"),), (os.path.join(tree, "nope"),),
                                    (os.path.join(tree, "empty"),)], "path string")
    got = {r["path"][len(tree):]: r["is_valid"] for r in A.valid_paths(probes, entries).collect()}
    assert got == {"/a/x.txt": True, "/nope": False, "/empty": True}


def test_file_digests_and_duplicates(spark, tree):
    entries, _ = A.scan(spark, tree)
    files = A.files_of(entries)
    cands = D.hash_candidates(files)
    dig = A8.file_digests(cands)
    got = {r["full_path"][len(tree):]: r["hash"] for r in dig.collect()}
    with open(os.path.join(tree, "big.bin"), "rb") as f:
        assert got["/big.bin"] == hashlib.md5(f.read()).hexdigest().upper()
    assert got["/a/x.txt"] == got["/a/b/y.TXT"] != got["/c/z.md"]
    groups = D.duplicate_groups(D.digest_candidates(files, digests=dig))
    sizes = sorted(r["size"] for r in groups.collect())
    assert sizes == [5, 1_200_000]
    fast = A8.file_digests(cands, mode="fast")
    f = {r["full_path"][len(tree):]: r["hash"] for r in fast.collect()}
    assert f["/big.bin"] == f["/copy/big changed.bin"] == f["/copy/big copy.bin"]
    assert got["/big.bin"] != got["/copy/big changed.bin"]


def test_empty_folders_on_tree(spark, tree):
    entries, _ = A.scan(spark, tree)
    dirs = A.directories(entries).select(F.col("full_path").alias("directory"))
    parents = entries.select("directory")
    empty = {r["directory"][len(tree):] for r in H.empty_folders(dirs, parents, tree).collect()}
    assert "/empty" in empty and "/only_dirs/sub" in empty and "/only_dirs" not in empty


def test_report_writes_and_progress(spark, tree):
    entries, _ = A.scan(spark, tree)
    observed, obs = P.observe_scan(entries)
    files = A.files_of(observed)
    marked = D.mark_inventory(files, D.digest_candidates(files, digests=A8.file_digests(D.hash_candidates(files))))
    out = B.run_folder(tempfile.mkdtemp(prefix="filelens-report-"), "test")
    paths = B.write_report({"summary": B.summary_rows(marked), "all_files": B.export_rows(marked),
                            "extensions": S.extension_breakdown(files)}, out, "csv")
    assert len(paths) == 3
    back = spark.read.option("header", True).csv(paths[1])
    assert back.columns == B.EXPORT_HEADERS
    metrics = obs.get
    assert metrics["files_found"] >= 10 and metrics["directories_found"] >= 8
    B.write_table(S.size_histogram(files), out + "/hist_parquet", "parquet")
    assert spark.read.parquet(out + "/hist_parquet").count() == 6
    assert B.format_for("r.JSON") == "json" and B.format_for("r.csv") == "csv"


def test_accurate_totals_count_every_directory(spark, tree):
    entries, _ = A.scan(spark, tree)
    row = S.entry_totals(entries).first()
    dirs = sum(1 for _, ds, _ in os.walk(tree, followlinks=False) for _ in ds) + 1  # + root
    locked_unlisted = 0 if os.geteuid() == 0 else 0
    assert row["total_directories"] >= dirs - 1 - locked_unlisted
    assert row["empty_files"] == 1 and row["total_files"] >= 12


def test_text_previews_and_open_check(spark, tree):
    entries, _ = A.scan(spark, tree)
    files = A.files_of(entries)
    prev = {r["full_path"][len(tree):]: r["preview"] for r in A8.text_previews(files).collect()}
    assert prev["/a/x.txt"] == "hello" and prev["/c/z.md"] == "HELLO"
    assert "/big.bin" not in prev
    can = {r["full_path"][len(tree):]: r["can_open"] for r in A8.open_check(files).collect()}
    assert can["/a/x.txt"] and can["/big.bin"]


@pytest.mark.parametrize("depth,target,flat", [(0, 4, 50000), (1, 2, 50000), (2, 3, 2), (3, 50, 3), (1, 8, 1)])
def test_scan_equals_walk_for_any_split(spark, tree, depth, target, flat):
    expect = {tree}
    for d, dirs, files in os.walk(tree, followlinks=False):
        for n in dirs + files:
            expect.add(os.path.join(d, n))
    if os.geteuid() != 0:
        expect = {p for p in expect if not p.startswith(os.path.join(tree, "locked") + "/")}
    entries, _ = A.scan(spark, tree, split_depth=depth, target_partitions=target, flat_split_entries=flat)
    got = [r["full_path"] for r in entries.select("full_path").collect()]
    assert len(got) == len(set(got))
    assert set(got) == expect


@pytest.mark.parametrize("depth,flat", [(0, 50000), (1, 2), (2, 1)])
def test_balanced_scan_equals_walk(spark, tree, depth, flat):
    expect = {tree}
    for d, dirs, files in os.walk(tree, followlinks=False):
        for n in dirs + files:
            expect.add(os.path.join(d, n))
    if os.geteuid() != 0:
        expect = {p for p in expect if not p.startswith(os.path.join(tree, "locked") + "/")}
    entries, rejects = A.scan_balanced(spark, tree, split_depth=depth, target_partitions=4, flat_split_entries=flat)
    got = [r["full_path"] for r in entries.select("full_path").collect()]
    assert len(got) == len(set(got))
    assert set(got) == expect
    plain, _ = A.scan(spark, tree)
    cols = ["full_path", "is_dir", "size", "extension", "is_link"]
    assert sorted(map(tuple, entries.select(*cols).collect())) == sorted(map(tuple, plain.select(*cols).collect()))


def test_deep_chain_and_flat_folder(spark, tmp_path):
    """A chain deeper than the split and a folder of many entries: the same rows as a walk, in either scan."""
    import os
    deep = tmp_path
    for i in range(60):
        deep = deep / f"d{i}"
    os.makedirs(deep)
    (deep / "last.txt").write_text("x")
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(3000):
        (flat / f"f{i}").touch()
    want = {os.path.join(d, n) for d, dirs, files in os.walk(tmp_path) for n in dirs + files} | {str(tmp_path)}
    for scan in (A.scan, A.scan_balanced):
        entries, rejects = scan(spark, str(tmp_path), flat_split_entries=500)
        assert {r["full_path"] for r in entries.select("full_path").collect()} == want and rejects.count() == 0


def test_driver_keeps_no_file_entries(tmp_path):
    for i in range(500):
        (tmp_path / f"f{i}").touch()
    (tmp_path / "sub").mkdir()
    assert A._subdirectories(str(tmp_path)) == ([str(tmp_path / "sub")], 501)
    parts = A.FileInventoryReader({"path": str(tmp_path)}, None).partitions()
    assert {d for p in parts for d in p.dirs} <= {str(tmp_path), str(tmp_path / "sub")}


def test_unlistable_folders_are_rejects_for_any_user(spark, tmp_path):
    """A folder that goes away between its parent's listing and its own (holds for root too)."""
    rows = list(A._walk(str(tmp_path / "gone")))
    assert len(rows) == 1 and not rows[0][14] and "FileNotFound" in rows[0][13]


def test_system_folders_are_pruned(spark):
    rows = [("/r/a", "/r", True, False), ("/r/s", "/r", True, True), ("/r/s/x", "/r/s", True, False), ("/r/s/x/f", "/r/s/x", False, False),
            ("/r/a/f", "/r/a", False, False), ("/r/a/g", "/r/a", False, True)]
    df = spark.createDataFrame(rows, "full_path string, directory string, is_dir boolean, is_system boolean")
    assert {r[0] for r in A.without_system(df).select("full_path").collect()} == {"/r/a", "/r/a/f"}
    assert {r[0] for r in A.directories(df, include_system=False).select("full_path").collect()} == {"/r/a"}
