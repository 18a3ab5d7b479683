"""op4 against the library as it is loaded: an added token in a text gets its id."""

import zlib

import edge
import numpy as np
from filelens.llm import token_files as T

TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b, c", "no mark", "  <|endoftext|>\n<|endoftext|>  z", "<|endoftext |>", "", "plain again",
         "ends <|endoftext|>"]


def plain(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(T.vocabulary_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_library_gives_the_id():
    assert plain(TEXTS[:1]) == [[87, 220, 50256, 331]]


def test_op4_equals_whole_texts(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in T.op4(edge.frame(spark, rows)).collect()}
    start = 0
    for (i, *_), ids in zip(rows, plain(TEXTS)):
        ids = np.array([*ids, T.END_ID], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_marked_texts_keep_their_place(rows):
    texts = [t or "" for _, t, *_ in rows[:40]]
    texts[3] = texts[3] + " <|endoftext|> " + texts[4]
    texts[0] = texts[-1] = "<|endoftext|>"
    enc = T.Encoder(T.vocabulary_path(), added=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == plain(texts)
