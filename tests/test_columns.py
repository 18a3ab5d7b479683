"""Golden vectors for the scalar functions (survey §5 layer 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filelens.functions import columns as C


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


@pytest.mark.parametrize("size,text", [
    (0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1152, "1.13 KB"), (1048575, "1024 KB"),
    (1048576, "1 MB"), (1536, "1.5 KB"), (2 ** 51, "2048 TB"), (-5, "-5 B"), (104857600, "100 MB"),
    (1073741824 * 3 // 2, "1.5 GB"),
])
def test_format_bytes(spark, size, text):
    assert one(spark, C.format_bytes("s"), [(size,)], "s long") == [text]


@pytest.mark.parametrize("path,name,directory,ext,key,stem", [
    ("/a/b/x.TXT", "x.TXT", "/a/b", ".txt", "txt", "x"),
    ("/a/.gitignore", ".gitignore", "/a", ".gitignore", "gitignore", ""),
    ("/a/noext", "noext", "/a", "", "No Extension", "noext"),
    ("/a/arch.tar.gz", "arch.tar.gz", "/a", ".gz", "gz", "arch.tar"),
    ("/a/trailing.", "trailing.", "/a", "", "No Extension", "trailing."),
    ("C:\\dir\\f.Md", "f.Md", "C:\\dir", ".md", "md", "f"),
    ("/web/x/", "", "/web/x", "", "No Extension", ""),
])
def test_path_parts(spark, path, name, directory, ext, key, stem):
    df = spark.createDataFrame([(path,)], "p string").select(
        C.file_name("p").alias("n"), C.parent_directory("p").alias("d"))
    df = df.select("n", "d", C.extension_of("n").alias("e"))
    df = df.select("n", "d", "e", C.extension_key("e").alias("k"), C.stem_of("n").alias("s"))
    assert tuple(df.first()) == (name, directory, ext, key, stem)


@pytest.mark.parametrize("raw,safe", [("<a::b?.txt", "a_b_.txt"), ("ok.txt", "ok.txt"), ('x"y|z*', "x_y_z"),
                                      ("a\tb", "a_b"), ("::", "")])
def test_safe_file_name(spark, raw, safe):
    assert one(spark, C.safe_file_name("n"), [(raw,)], "n string") == [safe]


def test_file_age_days_toward_zero(spark):
    rows = [(dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 3, 9, 0)),
            (dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 3, 10, 0)),
            (dt.datetime(2024, 1, 5, 0, 0), dt.datetime(2024, 1, 3, 12, 0))]
    df = spark.createDataFrame(rows, "m timestamp_ntz, a timestamp_ntz")
    assert [r[0] for r in df.select(C.file_age_days("m", "a")).collect()] == [1, 2, -1]


def test_status_display(spark):
    rows = [(True, True, 0, True), (False, True, 200 * 1024 * 1024, False), (False, False, 5, False),
            (False, False, 104857600, False)]
    df = spark.createDataFrame(rows, "p boolean, d boolean, s long, r boolean")
    got = [r[0] for r in df.select(C.status_display("p", "d", "s", "r")).collect()]
    assert got == ["★ PRIMARY | 📄 Empty | 🔒 Read-Only", "🔄 Duplicate | 💎 Large", "", ""]


def test_filetime_roundtrip_and_unsigned_low_word(spark):
    ts = dt.datetime(2001, 8, 1, 11, 59, 30)
    ticks = int((ts - dt.datetime(1601, 1, 1)).total_seconds()) * 10_000_000
    hi, lo = ticks >> 32, ticks & 0xFFFFFFFF
    lo_signed = lo - (1 << 32) if lo >= (1 << 31) else lo
    df = spark.createDataFrame([(hi, lo_signed)], "hi int, lo int")
    assert df.select(C.filetime_to_timestamp("hi", "lo")).first()[0] == ts


def test_shorten_and_label(spark):
    p = "/" + "x" * 70
    df = spark.createDataFrame([(p, "ABCDEF0123456789")], "p string, g string")
    r = df.select(C.shorten_path("p"), C.group_label("g")).first()
    assert r[0] == "..." + p[-57:] and len(r[0]) == 60
    assert r[1] == "ABCDEF01..."


def test_kind_and_preview(spark):
    rows = [(".txt", 10), (".TXT", 2 * 1024 * 1024), (".png", 5), (".png", 11 * 1024 * 1024), (".exe", 1)]
    df = spark.createDataFrame(rows, "e string, s long")
    got = [tuple(r) for r in df.select(C.file_kind("e"), C.preview_mode("e", "s")).collect()]
    assert got == [("text", "text"), ("text", "properties"), ("image", "image"), ("image", "properties"),
                   ("other", "properties")]


def test_text_head(spark):
    long = "a" * 10001
    df = spark.createDataFrame([(long, 10001), ("short", 5), ("x", 2 * 1024 * 1024)], "c string, s long")
    got = [r[0] for r in df.select(C.text_head("c", "s")).collect()]
    assert got[0] == "a" * 10000 + "\n\n... (content truncated for preview)"
    assert got[1] == "short"
    assert got[2] == "x"
    noted = [r[0] for r in df.select(C.text_head("c", "s", chars=3, max_size=1024 * 1024)).collect()]
    assert noted[0].startswith("aaa\n") and noted[2].startswith("File too large to preview")


def test_whole_number_conversions_are_exact(spark):
    """Beyond 2^53 a division as double is off by one."""
    import datetime as dt
    times = [dt.datetime(2024, 5, 6, 7, 8, 9, us) for us in (1, 999999, 123457)] + [dt.datetime(1601, 1, 1, 0, 0, 0, 1), dt.datetime(1650, 2, 3)]
    rows = []
    for t in times:
        ticks = ((t - dt.datetime(1601, 1, 1)) // dt.timedelta(microseconds=1)) * 10 + 7
        lo = ticks & 0xFFFFFFFF
        rows.append((ticks >> 32, lo - (1 << 32) if lo >> 31 else lo, t))
    df = spark.createDataFrame(rows, "hi int, lo int, t timestamp_ntz")
    assert [r[0] for r in df.select(C.filetime_to_timestamp("hi", "lo")).collect()] == times
    now = dt.datetime(2024, 1, 1)
    ages = [r[0] for r in df.select(C.file_age_days("t", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))).collect()]
    assert ages == [int((now - t) / dt.timedelta(days=1)) for t in times[:3]] + [154496, (now - times[4]).days]


def test_partial_md5_matches_hashlib(spark):
    import hashlib
    data = bytes(range(256)) * 10
    n, c = len(data), 64
    expect = hashlib.md5(data[:c] + data[n // 2:n // 2 + c] + data[n - c:]).hexdigest().upper()
    df = spark.createDataFrame([(bytearray(data), n)], "b binary, s long")
    assert df.select(C.partial_md5("b", "s", c)).first()[0] == expect
    assert df.select(C.md5_upper(F.col("b"))).first()[0] == hashlib.md5(data).hexdigest().upper()


def test_time_zone_does_not_change_results(spark):
    from filelens import catalog as K
    sf = "/root/testdata/sf0.001"
    before = sorted(tuple(r) for r in K.registry()["filetime_to_ts"](spark, sf).collect())
    ext_before = sorted(tuple(r) for r in K.registry()["extreme_files"](spark, sf).collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert sorted(tuple(r) for r in K.registry()["filetime_to_ts"](spark, sf).collect()) == before
        assert sorted(tuple(r) for r in K.registry()["extreme_files"](spark, sf).collect()) == ext_before
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert all(0 <= (r[4] - r[1]).total_seconds() < 1 for r in before)  # modified and the ticks added to it


def _format_bytes_model(n: int) -> str:
    """Plain-Python model: divide while ≥ 1024 up to TB, round half away from zero on the exact
    binary value, at most two decimals, trailing zeros dropped."""
    from decimal import ROUND_HALF_UP, Decimal
    units = ["B", "KB", "MB", "GB", "TB"]
    value, order = float(n), 0
    while value >= 1024 and order < len(units) - 1:
        value /= 1024
        order += 1
    if order == 0:
        return f"{n} B"
    q = Decimal(value).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    text = format(q, "f").rstrip("0").rstrip(".")
    return f"{text} {units[order]}"


def test_format_bytes_matches_model_on_random_sizes(spark):
    import random
    rng = random.Random(99)
    sizes = [rng.randint(-10, 2 ** rng.randint(1, 52)) for _ in range(4000)]
    sizes += [1024 * k + d for k in range(1, 40) for d in (-1, 0, 1, 5, 10, 512)]
    sizes += [int(1024 ** p * (1 + k / 200)) for p in (1, 2, 3, 4) for k in range(0, 200, 5)]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    got = [r[0] for r in df.select(C.format_bytes("s")).collect()]
    assert got == [_format_bytes_model(s) for s in sizes]
