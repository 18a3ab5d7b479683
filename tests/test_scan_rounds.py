"""The scan in rounds, pushed filters and live counts."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from filelens.sources import content as CT
from filelens.sources import inventory_source as A
from filelens.streaming.progress import Progress


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("rounds")
    deep = root
    for i in range(500):
        deep = deep / "d"
    os.makedirs(deep, exist_ok=True)
    (deep / "last.txt").write_text("x")
    flat = root / "a" / "flat"
    flat.mkdir(parents=True)
    for i in range(6000):
        (flat / f"f{i}").touch()
    for i in range(40):
        (root / "b" / f"s{i}" / ".hid").mkdir(parents=True)
        (root / "b" / f"s{i}" / "x.txt").write_text("y" * i)
        (root / "b" / f"s{i}" / ".hid" / "k.txt").write_text("k")
    return str(root)


def walk(root):
    return {os.path.join(d, n) for d, dirs, files in os.walk(root) for n in dirs + files} | {root}


@pytest.mark.parametrize("budget, flat", [(50_000, 50_000), (700, 500), (5000, 1000)])
def test_rounds_equal_a_walk(spark, tree, budget, flat):
    entries, rejects = A.scan(spark, tree, flat_split_entries=flat, budget=budget, target_partitions=16)
    got = [r[0] for r in entries.select("full_path").collect()]
    assert len(got) == len(set(got)) and set(got) == walk(tree) and rejects.count() == 0


def test_no_task_lists_beyond_its_budget(tree):
    """Work is handed back: a huge folder in shards, the rest as folders; a chain is followed within the budget."""
    units, rounds, seen = [(tree, -1, 1)], 0, set()
    while units:
        left = []
        for unit in units:
            rows = list(A.Walk(flat_split=500).rows([unit], budget=300))
            mine = [r[0] for r, _ in rows if r is not None]
            assert len(mine) < 300 + 1000  # the budget, and the folder or shard that crossed it
            seen.update(mine)
            left += [u for _, u in rows if u is not None]
        units, rounds = left, rounds + 1
        assert not any(of > 1 and not d.endswith("flat") for d, _, of in units)
    assert seen == walk(tree) and rounds < 20


def test_one_listing_serves_entries_and_rejects(spark, tmp_path, monkeypatch):
    (tmp_path / "x").write_text("1")
    entries, rejects = A.scan(spark, str(tmp_path))
    (tmp_path / "x").unlink()  # both frames come from the stored rounds
    assert entries.count() == 2 and rejects.count() == 0


def test_names_that_are_no_text_are_rejects(spark, tmp_path):
    try:
        open(os.path.join(os.fsencode(str(tmp_path)), b"bad\xff.txt"), "w").close()
    except OSError:
        pytest.skip("the file system takes text names only")
    (tmp_path / "good.txt").write_text("1")
    entries, rejects = A.scan(spark, str(tmp_path))
    assert {r["name"] for r in entries.where(~F.col("is_dir")).collect()} == {"good.txt"}
    assert [r["reason"] for r in rejects.collect()] == ["the name is not text"]


def source(spark, tree):
    A.register(spark)
    return spark.read.format("file_inventory").load(tree)


@pytest.mark.parametrize("condition", ["is_dir", "not is_dir", "not is_hidden", "not (is_hidden or is_system)", "startswith(full_path, '{root}/b/s1')",
                                       "startswith(full_path, '{root}/b') and is_dir and not is_hidden", "is_hidden", "size > 5 and not is_hidden"])
def test_pushed_filters_give_the_same_rows(spark, tree, condition):
    condition = condition.format(root=tree)
    got = sorted(r[0] for r in source(spark, tree).where(condition).select("full_path").collect())
    entries, _ = A.scan(spark, tree)
    assert got == sorted(r[0] for r in entries.where(condition).select("full_path").collect()) != []


def test_filters_reach_the_walk(spark, tree):
    plan = source(spark, tree).where(f"is_dir and startswith(full_path, '{tree}/b')")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan, plan


def visited(root, **options):
    w = A.Walk(**options)
    rows = [r for r, _ in w.rows([(root, -1, 1)]) if r is not None]
    return w.visited, {r[0] for r in rows}


def test_prefix_and_system_folders_are_not_walked(tree, monkeypatch):
    everywhere, _ = visited(tree)
    n, rows = visited(tree, prefix=f"{tree}/b/s7")
    assert n == 4 and rows == {p for p in walk(tree) if p.startswith(f"{tree}/b/s7")} and everywhere > 500
    monkeypatch.setattr(A, "_is_system", lambda name, st: name in ("d", "s3"))
    n, rows = visited(tree, skip_system=True)
    system = (f"{tree}/d", f"{tree}/b/s3")
    assert rows == {p for p in walk(tree) if not p.startswith(tuple(x + "/" for x in system)) and p not in system}
    assert n == everywhere - 500 - 2
    kept, rows = visited(tree, no_system=True)  # a filter on rows: what lies below is entered
    assert kept == everywhere and f"{tree}/b/s3/x.txt" in rows and f"{tree}/b/s3" not in rows


def test_folders_only_examines_no_file(tree, monkeypatch):
    examined = []
    plain = A._entry
    monkeypatch.setattr(A, "_entry", lambda ent: examined.append(ent.name) or plain(ent))
    _, rows = visited(tree, only_dirs=True)
    assert rows == {d for d, _, _ in os.walk(tree)} and not any(x[0] == "f" and x[1:].isdigit() for x in examined)


def test_counts_rise_while_jobs_run(spark, tree):
    p = Progress(spark)
    seen, done = [], threading.Event()

    def poll():
        while not done.is_set():
            seen.append(p.snapshot())
            time.sleep(0.05)

    watcher = threading.Thread(target=poll)
    watcher.start()
    try:
        entries, _ = A.scan(spark, tree, flat_split_entries=500, budget=500, progress=p)
        files = entries.where(~F.col("is_dir")).select("full_path", "size")
        CT.file_digests(files, partitions=24, progress=p).write.format("noop").mode("overwrite").save()
    finally:
        done.set()
        watcher.join()
    last = p.snapshot()
    assert last["files_found"] == files.count() == last["files_hashed"] and last["files_failed"] == last["rejects"] == 0
    assert last["directories_found"] == sum(1 for _ in os.walk(tree))
    for name in ("files_found", "files_hashed"):
        assert any(0 < s[name] < last[name] for s in seen), name
        assert [s[name] for s in seen] == sorted(s[name] for s in seen)
