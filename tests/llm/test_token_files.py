import zlib

import edge
import numpy as np
import pytest
from filelens.llm import token_files as T

ODD = ["", " ", "a", "a ", " a", "a  b", "a \nb", "a\n b", "it's 's 't x's", "x . , y.,!", "1 2 33 a1 1a", "tab\t x", "nb\xa0 x \xa0y",
       "\x1c a \x85 b", "a ' b's", "é. ç, ß!", "<|endoftext|> x <|endoftext|>", "漢 字 \U0001f600 !", "x᠎ y", "word... next", "a.' b"]


def plain(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(T.vocabulary_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_encode_like_whole_texts(rows):
    texts = ODD + [t for _, t, *_ in rows]
    enc = T.Encoder(T.vocabulary_path())
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == plain(texts)


@pytest.mark.parametrize("which", ["real", "cases"])
def test_files_hold_every_token_in_order(spark, rows, which):
    rows = sorted(rows if which == "real" else edge.CASES)
    got = {r["doc_id"]: r for r in T.op4(edge.frame(spark, rows[::-1])).collect()}
    start = 0
    for (i, *_), ids in zip(rows, plain([r[1] or "" for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_repeats_nulls_and_no_rows(spark):
    got = T.op4(edge.cases(spark)).collect()
    assert len(got) == len(edge.CASES) + 2 and len({r["start"] for r in got}) == len(got)
    assert next(r for r in got if r["doc_id"] is None)["start"] == 0
    assert T.op4(edge.empty(spark)).collect() == []


def test_layout(spark, rows, tmp_path):
    import glob

    import pyarrow.parquet as pq
    T.write(edge.frame(spark, rows), f"{tmp_path}/t", page_rows=16)
    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/t/part-*"))[0]).metadata.row_group(0)
    by = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and "DELTA_BINARY_PACKED" in by["n_tokens"].encodings
    ids = next(v for k, v in by.items() if k.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and by["doc_id"].has_offset_index and by["doc_id"].has_column_index
