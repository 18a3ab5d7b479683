"""Small documents with the cases that every operator has to stand, and real ones to compare on."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("kept", T.StringType()), T.StructField("label", T.LongType()), T.StructField("n_words", T.LongType()),
])

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
WORD = "a" * 70_000

CASES = [
    (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \n\t ", None, "s0"), (4, "one", "de", None),
    (5, "one", "de", None), (6, LONG, "en", "s1"), (7, LONG, "en", "s1"), (8, WORD, "fr", "s1"),
    (9, "Ünïcode 漢字 \U0001f600 teßt\nline two\n\nline two", "de", "s2"), (10, "a\x00b \x85 c d", "en", "s2"),
    (11, "The quick brown fox jumps over the lazy dog. " * 3, "en", "s2"), (12, "12345 67890 --- !!!", None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 7, 9) for i, t, lang, s in rows], SCHEMA)


def cases(spark, repeat=True):
    """The cases; with ``repeat`` the row 5 stands twice, and one row has no doc_id."""
    return frame(spark, CASES + ([CASES[4], (None, "one two three four five", "en", "s0")] if repeat else []))


def empty(spark):
    return frame(spark, [])


def texts(rows):
    return {i: t or "" for i, t, *_ in rows}
