"""Alignment of two tokenizers on the same bytes, by products of sparse incidence matrices.

Tokens cover bytes: a tokenizer's incidence matrix has a row per token and a one in the column of each
byte that it covers. In compressed rows (``indptr``, ``indices``), A times B transposed by Gustavson's
row-wise product links each token of A with the tokens of B that share a byte with it; the value is the
number of shared bytes. Byte offsets where tokens of both end cut the text into groups; the product of
the two token-by-group matrices links all tokens of a group.

Both tokenizers cut at a single space between words and around a single line end, and never join bytes
across; such stretches of a text (units) are aligned on their own, each distinct one once per worker
memo, many in one block-diagonal product. A text is the concatenation of its units.

Counts per id pair (documents that hold it linked) cover the whole corpus: a chunk of documents leaves,
per document, its distinct pairs with their number of links, as numbers into the chunk's own list of
pairs. Lists meet in one aggregation by pair, and the counts go back to their chunk by place.

Defined cases: a null or empty text has no tokens; a text whose joined bytes of either tokenizer differ
from space + text has none either; both give zeros and an empty digest. Repeated rows are rows each on
its own and documents of their own in the counts; a null id is kept; an empty table gives no rows;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biparta.llm.bpe_words import SPACE, press, special_tokens, squeeze, squeeze_codes, unpress, unsqueeze, unsqueeze_codes
from biparta.llm.packing import _byte_chars
from biparta.session import materialize, shuffle_width

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
# Texts of one chunk, links of documents held before their pairs are counted, and units remembered by a worker.
CHUNK_BYTES = 32_000_000
MEMO_UNITS = 600_000
MEMO_UNIT = 64
BLOCK_BYTES = 200_000

_ONE = f"(?: |\n)(?![{SPACE}])"
UNIT = re.compile(f"\n(?![{SPACE}])|(?: ?[^{SPACE}]+|[{SPACE}]+[^{SPACE}]*)(?:(?!{_ONE})[{SPACE}]+[^{SPACE}]*)*")


@dataclass
class Rows:
    """A sparse matrix of ones in compressed rows."""

    indptr: np.ndarray
    indices: np.ndarray
    width: int


def intervals(lengths: np.ndarray) -> Rows:
    """Token-by-byte matrix of tokens that cover consecutive bytes."""
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Rows(indptr, np.arange(indptr[-1]), int(indptr[-1]))


def members(group: np.ndarray, n_groups: int) -> Rows:
    """Token-by-group matrix: one group per token."""
    return Rows(np.arange(len(group) + 1), group.astype(np.int64), n_groups)


def transpose(m: Rows) -> Rows:
    row = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.width))]).astype(np.int64)
    return Rows(indptr, row[order], len(m.indptr) - 1)


def product(a: Rows, b: Rows) -> tuple[Rows, np.ndarray]:
    """Gustavson's product: each row of ``a`` gathers the rows of ``b`` that it names and adds them up.

    Returns the pattern of the product and its values.
    """
    size = np.diff(b.indptr)[a.indices]
    row = np.repeat(np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), size)
    ends = np.cumsum(size)
    inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    column = b.indices[np.repeat(b.indptr[a.indices], size) + inside]
    cell = row * b.width + column
    if len(cell) and not (cell[1:] >= cell[:-1]).all():
        cell.sort()
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    values = np.diff(np.concatenate([first, [len(cell)]]))
    rows = cell[first] // max(b.width, 1)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(a.indptr) - 1))]).astype(np.int64)
    return Rows(indptr, cell[first] % max(b.width, 1), b.width), values


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Entries of each row of the product, counted without listing them, where no two meet in a cell."""
    size = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return size[a.indptr[1:]] - size[a.indptr[:-1]]


def row_of(m: Rows) -> np.ndarray:
    return np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))


@dataclass
class Aligned:
    """Links ``(a, b)`` of token places, and the group of each token."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Aligned:
    """Align two tokenizations of the same bytes, given the bytes of each token."""
    a, b = intervals(a_lengths), intervals(b_lengths)
    links, _ = product(a, transpose(b))
    shared = np.intersect1d(a.indptr[1:], b.indptr[1:])
    return Aligned(row_of(links), links.indices, np.searchsorted(shared, a.indptr[1:]), np.searchsorted(shared, b.indptr[1:]), len(shared))


def group_links(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share a group, by the product of the token-by-group matrices."""
    found, _ = product(members(x.a_group, x.n_groups), transpose(members(x.b_group, x.n_groups)))
    return row_of(found), found.indices


def group_link_counts(x: Aligned) -> np.ndarray:
    """How many tokens of B share a group with each token of A."""
    return product_sizes(members(x.a_group, x.n_groups), transpose(members(x.b_group, x.n_groups)))


class ByteBpe:
    """Ids and byte lengths by a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        special_tokens(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.full.no_truncation()
        self.full.no_padding()
        byte = {c: bytes([i]) for i, c in enumerate(_byte_chars())}
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.bytes = {i: b"".join(byte.get(c, c.encode()) for c in t) for t, i in vocab.items()}
        self.size = max(vocab.values()) + 1

    def __call__(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.full.encode_batch(units, add_special_tokens=False)]


class PieceBpe:
    """Ids and byte lengths by a sentence-piece vocabulary, of units without the start mark that it adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.full = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.full.get_piece_size()
        names = [self.full.id_to_piece(i) for i in range(self.size)]
        if any("▁" in n.lstrip("▁") or "\n" in n for n in names):
            raise ValueError("pieces that reach across a space or a line end")
        self.bytes = {}
        for i, n in enumerate(names):
            self.bytes[i] = bytes([int(n[3:5], 16)]) if self.full.is_byte(i) else b"" if self.full.is_control(i) else n.replace("▁", " ").encode()
        self.lead = len(self.full.encode("\n"))

    def __call__(self, units: list[str]) -> list[list[int]]:
        # a line end in front takes the start mark and never joins what follows
        return [x[self.lead :] for x in self.full.encode(["\n" + u for u in units], num_threads=1)]


@dataclass(slots=True)
class Unit:
    """What a unit adds to its text: counts, the text of its groups, its links as id pairs, and whether its bytes are the text's."""

    n_a: int
    n_b: int
    n_groups: int
    n_shared: int
    groups: str
    pairs: bytes
    same: bool


_ODD = Unit(0, 0, 0, 0, "", b"", False)


class Aligner:
    """Units of texts, aligned many at a time; distinct units once per memo."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), PieceBpe(b_path)
        self.memo: dict[str, Unit] = {}

    def learn(self, units: list[str]) -> dict[str, Unit]:
        """Align units; those that are short enough stay in the memo."""
        out: dict[str, Unit] = {}
        kept: list[tuple[str, list[int], list[int]]] = []
        for u, x, y in zip(units, self.a(units), self.b(units), strict=True):
            raw = u.encode()
            same = b"".join([self.a.bytes[i] for i in x]) == raw and b"".join([self.b.bytes[i] for i in y]) == raw
            if same:
                kept.append((u, x, y))
            else:
                out[u] = _ODD
        held: list[tuple[str, list[int], list[int]]] = []
        size = 0
        for item in kept:
            held.append(item)
            size += len(item[0])
            if size > BLOCK_BYTES:
                self._block(held, out)
                held, size = [], 0
        if held:
            self._block(held, out)
        return out

    def _block(self, items: list[tuple[str, list[int], list[int]]], out: dict[str, Unit]) -> None:
        """One block-diagonal product for many units: unit ends are ends of tokens of both."""
        flat_a = np.array([i for _, x, _ in items for i in x], np.int64)
        flat_b = np.array([i for _, _, y in items for i in y], np.int64)
        n_a, n_b = np.array([len(x) for _, x, _ in items]), np.array([len(y) for _, _, y in items])
        la = np.array([len(self.a.bytes[i]) for i in flat_a.tolist()], np.int64)
        lb = np.array([len(self.b.bytes[i]) for i in flat_b.tolist()], np.int64)
        al = align(la, lb)
        pairs = flat_a[al.a] * self.b.size + flat_b[al.b]
        a_ends, b_ends = np.cumsum(n_a), np.cumsum(n_b)
        link_ends = np.searchsorted(al.a, a_ends)
        group_ends = al.a_group[a_ends - 1] + 1
        names_a, names_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        ga = np.searchsorted(al.a_group, np.arange(al.n_groups + 1)).tolist()
        gb = np.searchsorted(al.b_group, np.arange(al.n_groups + 1)).tolist()
        groups = [",".join(names_a[ga[g] : ga[g + 1]]) + "|" + ",".join(names_b[gb[g] : gb[g + 1]]) for g in range(al.n_groups)]
        shared_ends = np.cumsum(group_link_counts(al))[a_ends - 1]
        raw = pairs.astype("<i8").tobytes()
        g0 = l0 = s0 = 0
        for (u, x, y), g1, l1, s1 in zip(items, group_ends.tolist(), link_ends.tolist(), shared_ends.tolist(), strict=True):
            out[u] = Unit(len(x), len(y), g1 - g0, s1 - s0, ";".join(groups[g0:g1]), raw[8 * l0 : 8 * l1], True)
            g0, l0, s0 = g1, l1, s1

    def texts(self, texts: list[str]) -> list[list[Unit]]:
        """Units of space + text for each text."""
        cut = [UNIT.findall(" " + t) if t else [] for t in texts]
        fresh = list({u for units in cut for u in units if u not in self.memo})
        if not fresh:
            return [[self.memo[u] for u in units] for units in cut]
        if len(self.memo) > MEMO_UNITS:
            self.memo = {}
            fresh = list({u for units in cut for u in units})
        new = self.learn(fresh)
        self.memo.update((u, x) for u, x in new.items() if len(u) <= MEMO_UNIT)
        return [[self.memo[u] if u in self.memo else new[u] for u in units] for units in cut]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process, so that its memo lives across tasks."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


PER_DOC = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
CHUNKS = "chunk bigint, docs array<bigint>, digests array<string>, facts binary, sizes binary, low binary, high binary, times binary, pairs array<bigint>, holders array<bigint>"


def _count(a_path: str, b_path: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_texts = aligner(a_path, b_path).texts
        chunk = TaskContext.get().partitionId() << 32
        docs, digests, facts, found, times, held = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([*found, np.zeros(0, np.int64)])
            pairs, code, holders = np.unique(flat, return_inverse=True, return_counts=True)
            # frequent pairs get small numbers
            order = np.argsort(-holders, kind="stable")
            rank = np.empty(len(pairs), np.int64)
            rank[order] = np.arange(len(pairs))
            low, high = squeeze_codes(rank[code])
            counts = np.concatenate([*times, np.zeros(0, np.int64)])
            columns = [
                pa.array([chunk], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([digests], pa.list_(pa.string())),
                pa.array([squeeze(np.array(facts, np.int64).reshape(-1))], pa.binary()),
                pa.array([squeeze(np.array([len(x) for x in found]))], pa.binary()),
                pa.array([low], pa.binary()),
                pa.array([high], pa.binary()),
                pa.array([squeeze(counts - 1)], pa.binary()),
                pa.array([pairs[order]], pa.list_(pa.int64())),
                pa.array([holders[order]], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in CHUNKS.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, text, units in zip(part.column(0).to_pylist(), texts, align_texts(texts), strict=True):
                    if not units or not all([u.same for u in units]):
                        fact, digest, raw = (0, 0, 0, 0, 0), "", b""
                    else:
                        raw = b"".join([u.pairs for u in units])
                        fact = (sum([u.n_a for u in units]), sum([u.n_b for u in units]), sum([u.n_groups for u in units]), len(raw) // 8, sum([u.n_shared for u in units]))
                        digest = sha256(";".join([u.groups for u in units]).encode()).hexdigest()
                    values, n = np.unique(np.frombuffer(raw, "<i8"), return_counts=True)
                    docs.append(doc)
                    digests.append(digest)
                    facts.append(fact)
                    found.append(values)
                    times.append(n)
                    held += len(text) + 1
                    if held >= chunk_bytes:
                        yield flush()
                        docs, digests, facts, found, times, held = [], [], [], [], [], 0
                        chunk += 1
        if docs:
            yield flush()

    return run


def pair_counts(chunks: DataFrame, b_path: str = PIECE_BPE) -> DataFrame:
    """Documents per id pair over the whole corpus, ``(a, pair, n_docs, best)``: whether the count is the highest of its A id."""
    size = _piece_count(b_path)
    listed = chunks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = materialize(listed.groupBy("pair").agg(F.sum("holders").alias("n_docs")).withColumn("a", F.expr(f"pair div {size}").cast("int")), "pair-counts")
    # at most one row per id of A
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    return counts.join(F.broadcast(top), "a").select("a", "pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def _piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def _finish():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i] for n in b.schema.names}
                docs = row["docs"].as_py()
                facts = unsqueeze(row["facts"].as_py()).reshape(-1, len(PER_DOC))
                sizes = unsqueeze(row["sizes"].as_py())
                codes = unsqueeze_codes(row["low"].as_py(), row["high"].as_py())
                times = unsqueeze(row["times"].as_py()) + 1
                n_docs, best = (np.frombuffer(unpress(row[c].as_py() or b""), t) for c, t in (("n_docs", "<i8"), ("best", np.uint8)))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                links = np.concatenate([[0], np.cumsum(times * n_docs[codes])])
                firsts = np.concatenate([[0], np.cumsum(times * best[codes])])
                columns = [pa.array(docs, pa.int64()), *[pa.array(facts[:, k]) for k in range(len(PER_DOC))]]
                columns += [pa.array(firsts[ends[1:]] - firsts[ends[:-1]]), pa.array(links[ends[1:]] - links[ends[:-1]]), pa.array(row["digests"].as_py(), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *PER_DOC, "n_best", "count_sum", "groups_sha256"])

    return run


def _by_place():
    """Counts of a chunk's pairs, sorted by place, as two blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from biparta.llm.arrow_groups import in_groups

        for group in in_groups(batches, ["chunk"]):
            columns = [
                pa.array([group["chunk"][0].as_py()], pa.int64()),
                pa.array([press(group["n_docs"].to_numpy().astype("<i8").tobytes())], pa.binary()),
                pa.array([press(group["best"].to_numpy().astype(np.uint8).tobytes())], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "n_docs", "best"])

    return run


def count_links(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256``; and the corpus counts per id pair."""
    width = shuffle_width(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = materialize(texts.mapInArrow(_count(a_path, b_path, chunk_bytes), CHUNKS), "links")
    counts = pair_counts(chunks, b_path)
    listed = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    back = listed.join(counts.select("pair", "n_docs", "best"), "pair").select("chunk", "place", "n_docs", "best")
    back = back.repartition(width, "chunk").sortWithinPartitions("chunk", "place")
    blobs = materialize(back.mapInArrow(_by_place(), "chunk bigint, n_docs binary, best binary"), "link-counts")
    # a chunk without links has no counts
    whole = chunks.drop("pairs", "holders").join(blobs, "chunk", "left")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return whole.mapInArrow(_finish(), schema), counts
