"""Token-ID files: Parquet list columns with dictionary and delta encoding.

``write`` range-partitions the documents by id (texts, before encoding), encodes each partition in order and
writes it as one file: ids as a dictionary-encoded list column, doc_id and n_tokens delta-encoded, zstd, small
row groups and pages of a fixed row count with page indexes (Parquet writer version 2). A reader that wants lengths
reads only that column's pages; one that wants a document's tokens prunes row groups and pages by doc_id.

Encoding: a text is cut at single spaces and line ends between two other characters and between a letter and a closing mark,
where no token of a byte-level vocabulary with this splitting rule can cross. Pieces are cut and numbered for many texts at a
time as arrays, each distinct piece is encoded once per worker by the tokenizers library (memo of bounded size), and texts
are put together from their pieces' ids. Equal to encoding whole texts; tests compare. A text that holds
an added token of the vocabulary (``<|endoftext|>``) goes through the library whole and gets that token's id, as
``add_special_tokens=False`` alone leaves it.

``offsets`` adds each document's place in the token stream from the length column: running sums within a file,
and one total per file.

Defined cases: a null text is empty and has only the end id; null ids come first; repeated doc_ids follow each other
in the order of a text hash; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 512
MEMO_PIECES = 600_000
TOGETHER_BYTES = 4 << 20  # of texts encoded at a time

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(b".,!?;:|")] = True
_WHITE = np.zeros(256, dtype=bool)
_WHITE[list(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")] = True
# white space of several bytes
_RARE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, bool]:
    """Where pieces begin in the bytes of texts that begin at ``texts`` (none of them empty): at each text, at single spaces, at and
    after single line ends (both between two characters other than white space), and at closing marks after a letter. Also
    whether there is white space of several bytes."""
    white = _WHITE[data]
    rare = False
    if len(data) and data.max() > 127:
        for m in _RARE.finditer(data):
            white[m.start():m.end()] = rare = True
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = _TAIL[data[1:]] & _LETTER[data[:-1]]
    edge = np.zeros(len(data), dtype=bool)  # a text's first and last byte
    edge[texts] = edge[texts - 1] = True
    alone = white[1:-1] & ~(white[:-2] | white[2:] | edge[1:-1])
    cut[1:-1] |= alone & ((data[1:-1] == 32) | (data[1:-1] == 10))
    cut[2:] |= alone & (data[1:-1] == 10)
    cut[texts] = True
    return np.flatnonzero(cut), rare


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's place in them (one more at the end); null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, places, data = column.buffers()
    places = np.frombuffer(places, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)[places[0]:places[-1]]
    return data, places - places[0]


class Encoder:
    """Encodes texts to 32-bit ids, remembering pieces: each has a number, and its ids stand one after the other in ``ids``.
    ``added``: added tokens in a text get their ids; else they are ordinary text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        # bytes of each id: a byte-level vocabulary spells one byte as one character
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self._remember({})

    def _remember(self, pieces: dict[bytes, int]) -> None:
        """Pieces whose numbers count from 0; what comes next gets the next numbers."""
        self.number = defaultdict(itertools.count(len(pieces)).__next__, pieces)
        if not pieces:
            self.ids, self.ends = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64)
        self.known = len(pieces)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the next pieces."""
        start = int(self.ends[self.known - 1]) if self.known else 0
        while start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(lengths) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[start:start + len(ids)] = ids
        self.ends[self.known:self.known + len(lengths)] = start + np.cumsum(lengths)
        self.known += len(lengths)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in got], dtype=np.int64)
        return np.fromiter(itertools.chain.from_iterable(got), dtype=np.int32, count=int(lengths.sum())), lengths

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words with their space before them, many a call: the ids are cut where the words' bytes end."""
        ids, _ = self._encode([b"".join(words[i:i + 1000]).decode() for i in range(0, len(words), 1000)])
        at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w) for w in words])) + 1
        return ids, np.diff(at, prepend=0)

    def _learn(self, new: list[bytes], rare: bool) -> None:
        """New pieces in the order of their numbers."""
        joins = [p[0] == 32 and len(p) > 1 and p[1] > 32 and p[-1] > 32 and not (rare and _RARE.search(p)) for p in new]
        words = list(itertools.compress(new, joins))
        if len(words) == len(new):
            return self._add(*self._encode_words(words))
        others = [p for p, x in zip(new, joins) if not x]
        parts = [self._encode_words(words), self._encode([p.decode() for p in others])] if words else [self._encode([p.decode() for p in others])]
        ids, lengths = (np.concatenate(x) for x in zip(*parts))
        # back to the order of their numbers
        place = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~np.array(joins))]) if words else np.arange(len(new))
        order = np.empty(len(new), dtype=np.int64)
        order[place] = np.arange(len(new))
        begin = np.cumsum(lengths) - lengths
        self._add(ids[_spread(begin[order], lengths[order])], lengths[order])

    def _numbers(self, pieces: pa.Array, rare: bool) -> np.ndarray:
        """Each piece's number; distinct ones are looked up once."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.known > MEMO_PIECES:  # keeps what came first, which is the most frequent part
            half = MEMO_PIECES // 2
            self._remember(dict(itertools.islice(self.number.items(), half)))
        numbers = np.fromiter(map(self.number.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(numbers >= self.known)
        if len(new):
            self._learn([distinct[i] for i in new.tolist()], rare)
        return numbers[coded.indices.to_numpy()]

    def _encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, places = _bytes_of(column)
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(column), dtype=np.int64)
        starts, rare = piece_starts(data, places[:-1][np.diff(places) > 0])
        bounds = np.append(starts, len(data)).astype(np.int32)
        numbers = self._numbers(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]), rare)
        begin = np.concatenate(([0], self.ends[:self.known - 1]))
        lengths = (self.ends[:self.known] - begin)[numbers]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[_spread(begin[numbers], lengths)], np.diff(total[np.searchsorted(starts, places)])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column in a row, and how many each has."""
        marked = np.zeros(len(column), dtype=bool)
        for token in self.added:
            marked |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode_pieces(column)
        ids, lengths = self._encode_pieces(column.filter(pa.array(~marked)))
        self.tokenizer.encode_special_tokens = False
        whole, whole_lengths = self._encode(column.filter(pa.array(marked)).to_pylist())
        self.tokenizer.encode_special_tokens = True
        n = np.empty(len(column), dtype=np.int64)
        n[~marked], n[marked] = lengths, whole_lengths
        begin = np.empty_like(n)
        begin[~marked], begin[marked] = np.cumsum(lengths) - lengths, len(ids) + np.cumsum(whole_lengths) - whole_lengths
        return np.concatenate([ids, whole])[_spread(begin, n)], n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, little-endian."""
        ids, lengths = self.encode_column(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


def _spread(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of stretches of the given lengths, one after the other."""
    return np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path, added=True)


def _encoded(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            start = 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER_BYTES, side="right")))
                ids, n = enc.encode_column(batch.column(1).slice(start, stop - start))
                flat = pa.array(np.insert(ids, np.cumsum(n), end_id))  # after each text
                n = n + 1
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(n), lists],
                                                 names=["doc_id", "n_tokens", "ids"])
                start = stop
    return run


def write(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", vocabulary: str | None = None,
          end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
          page_rows: int = PAGE_ROWS) -> str:
    """Writes one file per range of ids, files and rows in ascending order."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    repeated = rows.select("doc_id").groupBy("doc_id").count().where("count > 1").limit(1).count()
    order = ["doc_id", *([F.xxhash64("text")] if repeated else [])]  # texts are read for the order of rows that share an id only
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (rows.mapInArrow(_encoded(vocabulary or vocabulary_path(), end_id), "doc_id long, n_tokens long, ids array<int>")
     .write.option("compression", "zstd").option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .parquet(folder))
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids with each row's file number and place in the file."""
    df = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(folder)
    return df.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file_no"),
                     F.col("_metadata.row_index").alias("row_no"))


def offsets(table: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids in all rows before, by file number and row number. ``lengths`` is the
    table as read, of which only the length column is."""
    files = lengths.groupBy("file_no").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("file_no", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return table.join(files, "file_no").withColumn(
        "start", F.col("file_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("file_start")


def _checksums(batches):
    for batch in batches:
        lists = batch.column(2)
        at = lists.offsets.to_numpy()
        data = lists.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(data[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(at).astype(np.int64)),
                                          pa.array(sums, pa.int64()), *batch.columns[3:]],
                                         names=["doc_id", "n_tokens", "n_ids", "ids_crc32", "file_no", "row_no"])


def op4(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    table = read(spark, write(docs, folder))
    sums = table.select("doc_id", "n_tokens", "ids", "file_no", "row_no").mapInArrow(
        _checksums, "doc_id long, n_tokens long, n_ids long, ids_crc32 long, file_no long, row_no long")
    return offsets(sums, table).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
