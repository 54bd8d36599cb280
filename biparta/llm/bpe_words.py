"""Byte-level BPE by a table of distinct words: encode each word once, place its ids where it stands, decode by id.

1. Split: a task cuts its texts into words and numbers them. About ``CHUNK_BYTES`` of texts make a
   chunk; it leaves the positions of its words (numbers, document by document) and its distinct words,
   dealt into buckets by their hash.
2. Encode: the words of a bucket meet in one task, whichever chunk they come from, and each distinct
   word is encoded once. Ids go back under the chunk and bucket that asked for them.
3. Decode: the distinct ids of a chunk join the table of pieces (id, bytes). The vocabulary bounds that
   table, so it may be broadcast.
4. Place: a chunk's ids and pieces meet its positions, and texts are put together again.

Words are cut where the tokenizer itself always cuts (at white space, and between plain letters and a
closing mark), never inside one of its own words, so ids of words add up to ids of texts. Special tokens
are cut out first, as the tokenizer does. A frequent word comes once per chunk, not once per occurrence.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows are
rows each on its own; a null id is kept; an empty table gives no rows; a text longer than a chunk is a
chunk of its own; columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biparta.llm.packing import _byte_chars
from biparta.session import materialize, shuffle_width

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Texts of one chunk; a task holds the distinct words of one chunk.
CHUNK_BYTES = 64_000_000
# Words that a task of the encoding step remembers; beyond it a word may be encoded again.
MEMO_WORDS = 1_000_000

# The tokenizer's white space (fixed values of the Unicode property), and letters and closing marks of one kind each.
SPACE = "\t-\r \x85\xa0  -     　"
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?"
WORD = re.compile(f" ?[{_LETTER}]+(?=[{_MARK}]*(?:[{SPACE}]|\\Z))|[{_MARK}]+(?=[{SPACE}]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

ROWS = "chunk bigint, part int, docs array<bigint>, a binary, b binary, c binary, d binary"
LAST_PART = 1 << 30


_CODEC = pa.Codec("zstd", compression_level=6)


def press(data: bytes) -> bytes:
    """Compressed bytes after their plain length."""
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def unpress(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True) if len(data) > 8 else b""


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    return press(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def squeeze_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of which small ones are frequent: one byte each, and the rest apart."""
    return press(np.minimum(codes, 255).astype(np.uint8).tobytes()), squeeze(codes[codes >= 255] - 255)


def unsqueeze_codes(low: bytes, high: bytes) -> np.ndarray:
    codes = np.frombuffer(unpress(low), np.uint8).astype(np.int64)
    codes[codes == 255] += unsqueeze(high)
    return codes


def most_used(counts: np.ndarray) -> np.ndarray:
    """Numbers from the most to the least used one; ties by number."""
    return np.argsort(-counts, kind="stable")


class Numbers(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def id_width(full) -> str:
    """Ids of equal stems lie side by side, so they are kept whole; two bytes are enough for most vocabularies."""
    return "<u2" if max(full.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def special_tokens(path: str) -> list[str]:
    """Added tokens that stand in a text as they are; others would change how words are cut."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
        raise ValueError("not a plain byte-level vocabulary")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return [t["content"] for t in spec["added_tokens"]]


def word_splitter(specials: list[str]):
    """Words of a text; special tokens are words of their own."""
    find = WORD.findall
    if not specials:
        return find
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")

    def words(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return find(text)
        out = []
        for i, part in enumerate(cut.split(text)):
            out += [part] if i % 2 else find(part)
        return out

    return words


def _split(specials: list[str], buckets: int, chunk_bytes: int):
    def rows(chunk: int, docs: list, codes: list[np.ndarray], words: list[str]) -> Iterator[pa.RecordBatch]:
        raw = [w.encode() for w in words]
        bucket = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
        # sorted inside their bucket, words and their ids compress better
        by_word = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
        order = by_word[np.argsort(bucket[by_word], kind="stable")]
        place = np.empty(len(raw), np.int64)
        place[order] = np.arange(len(raw))
        # frequent words get small numbers; the counts, by place, tell the reader which
        at = place[np.concatenate(codes)]
        counts = np.bincount(at, minlength=len(raw))
        rank = np.empty(len(raw), np.int64)
        rank[most_used(counts)] = np.arange(len(raw))
        low, high = squeeze_codes(rank[at])
        columns: list[list] = [[LAST_PART], [docs], [squeeze(np.array([len(c) for c in codes]))], [squeeze(counts)], [low], [high]]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            mine = [raw[i] for i in order[bounds[part] : bounds[part + 1]].tolist()]
            row = [part, None, squeeze(np.array([len(w) for w in mine])), press(b"".join(mine)), None, None]
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        types = [pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        arrays = [pa.array([chunk] * len(columns[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "part", "docs", "a", "b", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_splitter(specials)
        chunk = TaskContext.get().partitionId() << 32
        numbers, docs, codes, held = Numbers(), [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = words(text.as_py() or "")
                codes.append(np.array(list(map(numbers.__getitem__, found)), np.int32))
                docs.append(doc)
                held += len(text.as_py() or "") + 1
                if held >= chunk_bytes:
                    yield from rows(chunk, docs, codes, list(numbers))
                    numbers, docs, codes, held, chunk = Numbers(), [], [], 0, chunk + 1
        if docs:
            yield from rows(chunk, docs, codes, list(numbers))

    return run


def split_words(docs: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of texts: distinct words by bucket, and the row of positions as the last part."""
    pairs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = 2 * shuffle_width(docs.sparkSession)
    return materialize(pairs.mapInArrow(_split(special_tokens(path), buckets, chunk_bytes), ROWS), "words")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        full = Tokenizer.from_file(path)
        full.no_truncation()
        full.no_padding()
        width = id_width(full)
        known: dict[bytes, np.ndarray] = {}
        last = None
        for b in batches:
            for i in range(b.num_rows):
                chunk, part, sizes, data = (b.column(n)[i].as_py() for n in ("chunk", "part", "a", "b"))
                if part != last or len(known) > MEMO_WORDS:
                    known, last = {}, part
                ends = np.cumsum(unsqueeze(sizes)).tolist()
                joined = unpress(data)
                words = [joined[x:y] for x, y in pairwise([0, *ends])]
                fresh = [w for w in words if w not in known]
                for w, e in zip(fresh, full.encode_batch([w.decode() for w in fresh], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.int64)
                ids = [known[w] for w in words]
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int64()),
                        pa.array([part], pa.int32()),
                        pa.array([squeeze(np.array([len(x) for x in ids]))], pa.binary()),
                        pa.array([press(flat.astype(width).tobytes())], pa.binary()),
                        pa.array([np.unique(flat).astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    names=["chunk", "part", "a", "b", "ids"],
                )

    return run


def encode_words(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Ids of the words of every chunk and bucket: ``(chunk, part, a, b, ids)``; equal words meet and are encoded once."""
    words = rows.filter(F.col("part") < LAST_PART).select("chunk", "part", "a", "b")
    dealt = words.repartition(2 * shuffle_width(rows.sparkSession), "part").sortWithinPartitions("part", "chunk")
    return materialize(dealt.mapInArrow(_encode(path), "chunk bigint, part int, a binary, b binary, ids array<int>"), "word-ids")


def piece_table(spark: SparkSession, path: str = TOKENIZER) -> DataFrame:
    """``(id, piece)`` of the whole vocabulary: the bytes that an id stands for."""
    from tokenizers import Tokenizer

    byte = {c: i for i, c in enumerate(_byte_chars())}
    pieces = []
    for token, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items():
        pieces.append((i, bytearray(byte[c] for c in token) if all(c in byte for c in token) else bytearray(token.encode())))
    return spark.createDataFrame(sorted(pieces), "id int, piece binary")


def chunk_pieces(ids: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces of the distinct ids of every chunk: ``(chunk, ids, pieces)``."""
    # the vocabulary bounds the ids of a chunk, its pieces, and the broadcast table
    used = ids.groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")).select("chunk", F.explode("ids").alias("id"))
    found = used.join(F.broadcast(pieces), "id").groupBy("chunk").agg(F.collect_list(F.struct("id", "piece")).alias("p"))
    return materialize(found, "pieces").select("chunk", F.col("p.id").alias("ids"), F.col("p.piece").alias("pieces"))


def _place(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        width = id_width(Tokenizer.from_file(path))
        piece: dict[int, bytes] = {}
        ids: list[bytes] = []
        texts: list[bytes] = []
        counts: list[np.ndarray] = []
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i] for n in b.schema.names}
                part = row["part"].as_py()
                if part < 0:
                    piece = dict(zip(row["ids"].as_py(), row["pieces"].as_py(), strict=True))
                elif part < LAST_PART:
                    n, flat = unsqueeze(row["a"].as_py()), np.frombuffer(unpress(row["b"].as_py()), width)
                    ends = np.cumsum(n).tolist()
                    raw, found = flat.astype("<u4").tobytes(), list(map(piece.__getitem__, flat.tolist()))
                    for x, y in pairwise([0, *ends]):
                        ids.append(raw[4 * x : 4 * y])
                        texts.append(b"".join(found[x:y]))
                    counts.append(n)
                else:
                    n = np.concatenate([*counts, np.zeros(0, np.int64)])
                    codes = most_used(unsqueeze(row["b"].as_py()))[unsqueeze_codes(row["c"].as_py(), row["d"].as_py())]
                    ends = np.cumsum(unsqueeze(row["a"].as_py())).tolist()
                    yield from _documents(row["docs"].as_py(), codes, ends, n, ids, texts, keep)
                    piece, ids, texts, counts = {}, [], [], []

    return run


def _documents(docs: list, codes: np.ndarray, ends: list[int], n: np.ndarray, ids: list[bytes], texts: list[bytes], keep: bool) -> Iterator[pa.RecordBatch]:
    held, out = 0, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())]
        if keep:
            arrays += [pa.array(columns[4], pa.list_(pa.int32())), pa.array(columns[5], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    for doc, (x, y) in zip(docs, pairwise([0, *ends]), strict=True):
        mine = codes[x:y]
        at = mine.tolist()
        raw = b"".join(map(ids.__getitem__, at))
        text = b"".join(map(texts.__getitem__, at)).decode("utf-8", "replace")
        row = (doc, int(n[mine].sum()), sha256(raw).hexdigest(), sha256(text.encode()).hexdigest())
        out.append((*row, np.frombuffer(raw, "<i4"), text) if keep else row)
        held += len(raw) if keep else 200
        if held > 4_000_000:
            yield batch()
            held, out = 0, []
    if out:
        yield batch()


def encode_decode(docs: DataFrame, path: str = TOKENIZER, keep: bool = True, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``keep`` also ``ids`` and ``decoded``."""
    spark = docs.sparkSession
    rows = split_words(docs, path, id_col, text_col, chunk_bytes)
    words = encode_words(rows, path)
    none = {"docs": "array<bigint>", "a": "binary", "b": "binary", "c": "binary", "d": "binary", "ids": "array<int>", "pieces": "array<binary>"}

    def as_part(df: DataFrame, part) -> DataFrame:
        return df.select("chunk", part.cast("int").alias("part"), *[(F.col(n) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in none.items()])

    parts = as_part(chunk_pieces(words, piece_table(spark, path)), F.lit(-1))
    parts = parts.unionByName(as_part(words.drop("ids"), F.col("part")))
    parts = parts.unionByName(as_part(rows.filter(F.col("part") == LAST_PART), F.col("part")))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return parts.repartition(2 * shuffle_width(spark), "chunk").sortWithinPartitions("chunk", "part").mapInArrow(_place(path, keep), schema)
