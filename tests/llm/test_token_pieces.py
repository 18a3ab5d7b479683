"""op4 encodes each distinct word once, whatever stands between words, and as the library does."""

import random

import numpy as np
import pyarrow as pa
from filelens.llm import token_files as T

PARTS = ["a", "Bc", "it's", "x", "1", "22", " ", " ", " ", "  ", "\n", "\n", "\r\n", "\t", ".", ",", "...", "!", "|", "'s", "é", "漢", "\xa0", " ", "᠎",
         "　", "\x1c", "\x85", "\x00", "\x7f", "—", "\U0001f600", "-", "don't,", "end.", "<|endoftext|>", "<|endof"]


def plain(enc, texts):
    enc.encode_special_tokens = False
    return [e.ids for e in enc.encode_batch(texts, add_special_tokens=False)]


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(T.vocabulary_path())


def test_library_gets_each_word_once():
    words = [f"word{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "\n", ", ", ".\n", "! "]) for _ in range(400)) + "end" for _ in range(40)]
    enc, given = T.Encoder(T.vocabulary_path(), added=True), []

    class Noted:
        encode_special_tokens = True

        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, batch, **more):
            given.extend(batch)
            return self.inner.encode_batch_fast(batch, **more)

    enc.tokenizer, tokenizer = Noted(enc.tokenizer), enc.tokenizer
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == plain(tokenizer, texts)
    assert sum(map(len, given)) < 3 * sum(len(w) + 1 for w in words)  # after a space, after a line end, first of a text


def test_any_mix_equals_whole_texts():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randrange(14))) for _ in range(6000)]
    enc = T.Encoder(T.vocabulary_path(), added=True)
    want = plain(library(), texts)
    for step in (1, 7, 6000):
        got = [np.frombuffer(x, "<u4").tolist() for i in range(0, 6000 if step > 1 else 300, step) for x in enc.encode(texts[i:i + step])]
        assert got == want[:len(got)]


def test_forgotten_pieces_are_learned_again(monkeypatch, rows):
    monkeypatch.setattr(T, "MEMO_PIECES", 500)
    texts = [t or "" for _, t, *_ in rows[:120]]
    enc = T.Encoder(T.vocabulary_path(), added=True)
    want = plain(library(), texts)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for i in range(0, 120, 5) for x in enc.encode(texts[i:i + 5])] == want
    assert enc.known < 5000


def test_columns_with_nulls_and_slices():
    texts = [None, "a b", "", None, "c <|endoftext|> d", " ", "e\nf", ""]
    want = plain(library(), [t or "" for t in texts])
    enc = T.Encoder(T.vocabulary_path(), added=True)
    for i in range(len(texts)):
        for j in range(i, len(texts) + 1):
            ids, n = enc.encode_column(pa.array(texts, pa.string()).slice(i, j - i))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == want[i:j]
