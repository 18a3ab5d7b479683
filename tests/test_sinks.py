"""Reports that are whole or not there, and inventories that follow a plan."""

import os

import pytest
from pyspark.sql import functions as F

from filelens.operators import stats as S
from filelens.sinks import inventory_table as IT
from filelens.sinks import report as RP

ODD = ['plain', 'say "hi"', 'a,b', 'line\nbreak', 'tail"', '""', ' spaced ', 'ü漢', "it's; done"]


def odd(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "id int, value string")


@pytest.mark.parametrize("fmt", RP.FORMATS)
def test_report_values_come_back(spark, tmp_path, fmt):
    out = f"{tmp_path}/r"
    paths = RP.write_report({"odd": odd(spark), "more": odd(spark).where("id < 2")}, out, fmt)
    back = RP.read_report(spark, out)
    assert list(back) == ["odd", "more"] and all(os.path.isdir(p) for p in paths)
    assert [(int(r["id"]), r["value"]) for r in back["odd"].orderBy(F.col("id").cast("int")).collect()] == list(enumerate(ODD))
    assert RP.read_manifest(spark, out)["tables"] == {"odd": {"rows": len(ODD)}, "more": {"rows": 2}}


def test_a_failing_table_leaves_no_report(spark, tmp_path):
    out = f"{tmp_path}/r"
    bad = odd(spark).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        RP.write_report({"one": odd(spark), "two": odd(spark), "bad": bad}, out)
    assert RP.read_manifest(spark, out) is None and not [x for x in os.listdir(out) if not x.startswith(".")] if os.path.exists(out) else True
    with pytest.raises(FileNotFoundError):
        RP.read_report(spark, out)
    RP.write_report({"one": odd(spark)}, out)
    with pytest.raises(FileExistsError):
        RP.write_report({"one": odd(spark)}, out)
    with pytest.raises(Exception):  # the report before stays
        RP.write_report({"bad": bad}, out, mode="overwrite")
    assert RP.read_report(spark, out)["one"].count() == len(ODD)
    RP.write_report({"one": odd(spark).limit(1)}, out, "parquet", mode="overwrite")
    assert RP.read_report(spark, out)["one"].count() == 1
    assert len([x for x in os.listdir(out) if x.startswith("run-")]) == 1


def inventory(spark, n=4000):
    return spark.range(n).selectExpr("concat('/r/d', lpad(cast(id % 40 as string), 2, '0'), '/f', id, '.txt') as full_path", "concat('f', id, '.txt') as name",
                                     "'.txt' as extension", "concat('/r/d', lpad(cast(id % 40 as string), 2, '0')) as directory", "id as size")


def files_below(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, ns in os.walk(folder) for n in ns if n.endswith(".parquet")}


def test_an_update_rewrites_its_ranges_only(spark, tmp_path):
    path = f"{tmp_path}/inv"
    IT.write_versioned(inventory(spark), path, ranges=10)
    before, reader = files_below(path), IT.read_versioned(spark, path)
    assert len(IT.manifest_of(spark, path)["ranges"]) == 10
    moves = [(f"/r/d03/f{3 + 40 * k}.txt", f"/r/d04/moved{k}.MD", "move", 1) for k in range(10)]
    plan = spark.createDataFrame(moves + [("/r/d03/gone.txt", None, "failed", None)], "source string, target string, action string, size long")
    assert IT.apply_plan(spark, path, plan) == 2
    after = files_below(path)
    assert all(after[f] == t for f, t in before.items())  # nothing old is touched
    data = [x for x in os.listdir(path) if x.startswith("data-")]
    new = {f.split("path_range=")[1].split("/")[0] for f in after if f not in before}
    assert len(data) == 2 and 1 <= len(new) <= 3  # d03 and d04 lie in two or three of ten ranges
    assert reader.count() == 4000 and reader.where("full_path like '%moved%'").count() == 0  # the version that was read
    now = IT.read_versioned(spark, path)
    want = {(s, t) for s, t, *_ in moves}
    assert now.count() == 4000 and now.select("full_path").distinct().count() == 4000
    got = now.where("full_path like '%moved%'").collect()
    assert {(f"/r/d03/f{r['size']}.txt", r["full_path"]) for r in got} == want
    assert {(r["name"][-3:], r["extension"], r["directory"]) for r in got} == {(".MD", ".md", "/r/d04")}
    assert IT.read_versioned(spark, path, 1).count() == reader.count()


def test_stage_copy_and_dropped_versions(spark, tmp_path):
    path = f"{tmp_path}/inv"
    IT.write_versioned(inventory(spark, 400), path, ranges=4)
    plan = spark.createDataFrame([("/r/d00/f0.txt", "/zz/new.txt", "copy", 0), ("/r/d01/f1.txt", "/r/S/f1.txt", "stage", 1), ("/r/d02/f2.txt", "/a/first.txt", "move", 2)],
                                 "source string, target string, action string, size long")
    IT.apply_plan(spark, path, plan)
    paths = {r[0] for r in IT.read_versioned(spark, path).select("full_path").collect()}
    assert len(paths) == 400 and {"/r/d00/f0.txt", "/zz/new.txt", "/a/first.txt"} <= paths and not {"/r/d01/f1.txt", "/r/S/f1.txt", "/r/d02/f2.txt"} & paths
    # a second update finds what the first one moved, also beyond the first and last range
    again = spark.createDataFrame([("/zz/new.txt", "/r/d00/back.txt", "move", 0)], "source string, target string, action string, size long")
    assert IT.apply_plan(spark, path, again) == 3
    assert IT.apply_plan(spark, path, again.where("action = 'copy'")) == 3  # nothing to do
    whole = {r[0] for r in IT.read_versioned(spark, path).select("full_path").collect()}
    assert whole == paths - {"/zz/new.txt"} | {"/r/d00/back.txt"}
    IT.drop_versions(spark, path)
    assert {r[0] for r in IT.read_versioned(spark, path).select("full_path").collect()} == whole
    with pytest.raises(Exception):
        IT.read_versioned(spark, path, 1)


def test_unknown_times_are_neither_oldest_nor_newest(spark):
    rows = spark.createDataFrame([("/a", 1, None), ("/b", 2, "2020-01-01 00:00:00"), ("/c", 3, "2021-01-01 00:00:00")], "full_path string, size long, modified string") \
        .withColumn("modified", F.col("modified").cast("timestamp_ntz"))
    got = {r["kind"]: r["full_path"] for r in S.extremes(rows).collect()}
    assert got == {"largest": "/c", "smallest": "/a", "oldest": "/b", "newest": "/c"}
    assert [r["full_path"] for r in S.oldest(rows, 3).collect()] == ["/b", "/c", "/a"]
    assert [r["full_path"] for r in S.newest(rows, 3).collect()] == ["/c", "/b", "/a"]


def test_derived_columns_are_those_of_the_listing(spark, sf_small, tmp_path):
    from filelens import fixtures as X
    inv = X.inv_orders(spark, sf_small)
    for derive in (False, True):
        IT.write_inventory(inv, f"{tmp_path}/{derive}", derive=derive)
    a, b = (IT.read_inventory(spark, f"{tmp_path}/{d}") for d in (False, True))
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
