"""Interval labels against a plain walk, on deep and odd trees."""

import random
from collections import defaultdict

import pytest

from filelens.operators import hierarchy as H
from filelens.operators import intervals as IV


def ancestors(d):
    parts = d.split("/")
    return [p or "/" for p in ("/".join(parts[:i]) for i in range(1, len(parts) + 1))]


def tree(seed):
    rng = random.Random(seed)
    names = ["a", "a b", "a.b", "a-", "A", "ab", "a\x01", "ä", "漢", "z", "!"]
    return ["/" + "/".join(rng.choice(names) for _ in range(rng.randrange(1, 7))) for _ in range(150)] + ["/", ""]


@pytest.mark.parametrize("partitions", [1, 6, 40])
def test_labels_and_totals_equal_a_walk(spark, partitions):
    rows = [(d, random.Random(i).randrange(1000)) for i, d in enumerate(tree(partitions) * 2)]
    inv = spark.createDataFrame(rows, "directory string, size long")
    size, n, nodes = defaultdict(int), defaultdict(int), set()
    for d, s in rows:
        for a in set(ancestors(d)):
            size[a] += s
            n[a] += 1
            nodes.add(a)
    got = {r["directory"]: (r["total_size"], r["file_count"]) for r in IV.subtree_totals(inv, partitions).collect()}
    assert got == {d: (size[d], n[d]) for d in nodes}
    labels = IV.label_folders(inv, partitions).collect()
    assert sorted(r["first"] for r in labels) == list(range(len(nodes)))
    span = {r["directory"]: (r["first"], r["last"]) for r in labels}
    for d, (first, last) in span.items():
        assert {x for x, (f, _) in span.items() if first <= f <= last} == {x for x in nodes if d in ancestors(x)}


def test_rows_grow_with_folders_not_depth(spark):
    """A chain 500 deep: each folder is one row, and totals are those of the roll-up by ancestors."""
    chain = ["/".join([""] + [f"d{i}" for i in range(k)]) for k in range(1, 501)]
    inv = spark.createDataFrame([(d, 1) for d in chain], "directory string, size long")
    nodes = IV.folder_nodes(inv, 8)
    assert nodes.count() == 501  # and the root
    got = {r["directory"]: r["total_size"] for r in IV.subtree_totals(inv, 8).collect()}
    assert got == {r["directory"]: r["total_size"] for r in H.directory_sizes(inv).collect()}
    only_leaf = IV.folder_nodes(inv.where(f"directory = '{chain[-1]}'"), 8)
    assert only_leaf.count() == len(set(ancestors(chain[-1])))


def test_in_or_below(spark):
    folders = sorted(set(tree(9)) - {""})
    tops = ["/a", "/a/z", "/ab/a.b", "/nowhere"]
    df = spark.createDataFrame([(d,) for d in folders], "directory string")
    t = spark.createDataFrame([(d,) for d in tops + tops], "directory string")
    got = {r["directory"]: r["below"] for r in IV.in_or_below(df, t, 5).collect()}
    assert got == {d: any(x in tops for x in ancestors(d)) for d in folders}
    every = IV.in_or_below(df, spark.createDataFrame([("/",)], "directory string"), 5)
    assert all(r["below"] for r in every.collect())
