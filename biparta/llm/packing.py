"""Packing: power-of-two decomposition of documents into fixed-length buckets.

A document of n tokens is cut into n // L pieces of the full length L and, for the
rest, one piece per set bit of the rest, longest first. A piece is a whole sequence:
its length is a power of two, so nothing is padded and no sequence crosses documents.
Training batches are drawn per bucket (pieces of one length).

Defined cases: a null or empty text packs to the end token alone; repeated rows are
packed each on its own; a null id is kept; an empty table gives no pieces; columns
other than the id and the text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE_LENGTH = 4096
END_ID = 2
# Entries of the word and token memos of one worker, and the longest word they keep.
MEMO_ENTRIES = 400_000
MEMO_WORD = 64
# Tokens per Arrow batch that a task hands back.
FLUSH_TOKENS = 4_000_000

# Below U+0180 every text is in NFC already and lower-casing is char by char, so words can be
# cut here exactly as the tokenizer's own pre-tokenizer cuts them.
_UNSAFE = re.compile("[^\x00-ſ]")
_LETTERS = "a-zªµºß-öø-ſ"
_DIGITS = "0-9²³¹¼½¾"
_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_DIGITS}]+")


def piece_lengths(n: int, length: int = SEQUENCE_LENGTH) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in document order."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= MEMO_WORD:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins across it, so a text is the
    concatenation of its words, and words repeat.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.chars = _byte_chars()
        self.tokens = _Memo(self._token)
        self.words = _Memo(self._word)

    def _token(self, token: str) -> bytes:
        mapped = "".join([self.chars[b] for b in token.encode()])
        return np.array([t.id for t in self.full.model.tokenize(mapped)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if _UNSAFE.search(word) or "<|" in word:
            return np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.tokens.__getitem__, _TOKENS.findall(word.lower())))

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary, so that its memo lives across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def _cut(path: str, length: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def batch(rows: list[tuple], blobs: list[bytes]) -> pa.RecordBatch:
        doc, start, size, crc, total = zip(*rows, strict=True) if rows else ((),) * 5
        lengths = np.array(size, np.int64)
        if keep_ids:
            values = np.frombuffer(b"".join(blobs), "<i4")
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values))
        else:
            ids = pa.nulls(len(rows), pa.list_(pa.int32()))
        columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(np.log2(np.maximum(lengths, 1)).astype(np.int32)), ids, pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=PIECES.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        rows, blobs, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blob = encode(text.as_py()) + end
                n, at = len(blob) // 4, 0
                for size in piece_lengths(n, length):
                    part = blob[4 * at : 4 * (at + size)]
                    rows.append((doc, at, size, zlib.crc32(part), n))
                    if keep_ids:
                        blobs.append(part)
                    at += size
                    held += size if keep_ids else 40
                    if held >= FLUSH_TOKENS:
                        yield batch(rows, blobs)
                        rows, blobs, held = [], [], 0
        yield batch(rows, blobs)

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = SEQUENCE_LENGTH, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: ``doc_id, start, length, bucket, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    ``bucket`` is the binary logarithm of the length. Each piece is a sequence of its
    own, so ``offset`` is 0 and ``sequence_id`` numbers pieces by task and place: unique
    in one run. No shuffle takes place; ``keep_ids=False`` leaves the ids null.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    pairs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = pairs.mapInArrow(_cut(tokenizer, length, end_id, keep_ids), PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per bucket: every file holds sequences of one length only."""
    pieces.write.mode("errorifexists").partitionBy("bucket").parquet(path)
