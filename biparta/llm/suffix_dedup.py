"""Suffix-array removal of repeated byte strings, by two-stage sorting in content buckets.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller id,
or same document and smaller offset) is removed; strings are judged on the input.

Buckets. The strings of ``LENGTH`` bytes (windows) of a text are dealt by their anchor: the
leftmost smallest hash among the ``GRAM``-byte grams inside the window. Equal windows have
equal anchors at equal places, so they meet in one bucket, wherever they stand; neighbouring
windows share an anchor, so a bucket holds short segments, not single windows.

Inside buckets. Segments that are equal as a whole need no sorting: all but the first are
removed. This is settled first inside each task, so that frequent passages shrink before
they are shuffled. Where a bucket holds different segments, their suffixes are sorted in two
stages: those smaller than their successor are sorted directly; each of the others starts
with a greater byte than it is followed by (or an equal one), so scanning the buckets of
first bytes in order places it right after the suffix behind it has its place. Common
prefixes of neighbours then show which windows are equal, and all but the first start of
each are removed. A bucket with very many segments is cut into blocks, and each pair of
blocks is a task.

Defined cases: a null or empty text has no bytes; texts below ``LENGTH`` bytes keep all; a
null id counts as the largest; rows that repeat an id are one document with equal places,
and rows that repeat id and text get equal results; an empty table gives no rows; other
columns pass through, except those named like a new one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biparta.llm.arrow_groups import in_groups
from biparta.operators.ordering import global_rank
from biparta.session import materialize

LENGTH = 100
GRAM = 24
# Bytes hashed in one go: small enough for a processor's cache, and for 20 bits of place.
CHUNK = 400_000
# Distinct segments of one block of a large bucket, and bytes sorted in one go.
BLOCK = 20_000
SORT_BYTES = 4_000_000
LAST = (1 << 63) - 1

_U = np.uint64
_A = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _U((1 << 20) - 1)


def _power(n: int) -> np.uint64:
    return _U(pow(_A, n, 1 << 64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, by doubling."""
    level, width, out, have = _TABLE[data], 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, have = level, width
            else:
                n = len(data) - have - width + 1
                out = out[:n] * _power(width) + level[have : have + n]
                have += width
        if 2 * width > size:
            break
        n = len(level) - width
        level = level[:n] * _power(width) + level[width : width + n]
        width *= 2
    out = (out ^ (out >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    powers = np.full(len(data), _U(_A))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * powers)])
    # brought to one place by the inverse power
    back = np.full(len(data), _U(pow(_A, -1, 1 << 64)))
    back[0] = 1
    back = np.multiply.accumulate(back)
    x = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk: place of the text in the list, first window, number of windows, anchor hash, segment hash."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        # a long text comes in parts that overlap by all but one byte of a window
        for at in range(0, max(len(t) - length + 1, 0), CHUNK):
            part = t[at : at + CHUNK + length - 1]
            if size + len(part) > CHUNK + length and parts:
                yield _chunk(parts, length, gram)
                parts, size = [], 0
            parts.append((k, at, part))
            size += len(part)
    if parts:
        yield _chunk(parts, length, gram)


def _chunk(parts: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = gram_hashes(data, gram)
    keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(keyed, length - gram + 1) & _PLACE).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) - begins[part] <= sizes[part] - length
    starts = np.flatnonzero(inside)
    a, p = anchor[starts], part[starts]
    heads = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1])) + 1])
    count = np.diff(np.concatenate([heads, [len(starts)]]))
    first = starts[heads]
    owner = p[heads]
    place = np.array([k for k, _, _ in parts])[owner]
    offset = first - begins[owner] + np.array([at for _, at, _ in parts])[owner]
    return place, offset, count, hashes[a[heads]], _segment_hashes(data, first, first + count + length - 1)


def _split(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).to_numpy()
            texts = [t.encode() if t else b"" for t in b.column(1).to_pylist()]
            found = list(segments(texts, length, gram))
            if not found:
                continue
            place, start, n, anchor, content = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = doc[place]
            # equal segments inside the batch: all but the first are settled here
            order = np.lexsort((start, owner, content, anchor))
            same = np.zeros(len(order), bool)
            same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
            # rows that repeat an id and text stand at equal places and are no earlier than each other
            repeat = np.zeros(len(order), np.int64)
            heads = np.flatnonzero(~same)
            head = heads[np.cumsum(~same) - 1]
            equal_place = (owner[order] == owner[order][head]) & (start[order] == start[order][head])
            repeat[order] = np.where(same & ~equal_place, 1, 0)
            arrays = [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(owner), pa.array(start), pa.array(n), pa.array(repeat.astype(bool))]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "content", "doc", "start", "n", "settled"])

    return run


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; runs follow their end, the last is not."""
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    # equal neighbours take the answer of the next place that differs
    at = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def two_stage_sort(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffix array of bytes 1..255, right to ``depth`` bytes at least; ties stay in text order only within a stage."""
    n, up = len(text), smaller_than_next(text)
    # first stage: suffixes smaller than their successor, by their leading bytes
    direct = np.flatnonzero(up)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct])
    direct = direct[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")] if len(direct) else direct
    cuts = np.searchsorted(text[direct], np.arange(257))
    # second stage: scan the buckets of first bytes; each suffix places its greater predecessor
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        placed = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        run = [placed]
        while len(placed):
            placed = placed[placed > 0] - 1
            placed = placed[(text[placed] == c) & ~up[placed]]
            run.append(placed)
        bucket = np.concatenate([*run, direct[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~up[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        heads = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if b > a:
                waiting[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, at: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each listed suffix with the one before it, up to ``depth``; 0 for the first."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view, out = np.lib.stride_tricks.sliding_window_view(padded, depth), np.zeros(len(at), np.int64)
    for s in range(1, len(at), 50_000):
        e = min(len(at), s + 50_000)
        differ = view[at[s:e]] != view[at[s - 1 : e - 1]]
        out[s:e] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out


def repeated_windows(parts: list[bytes], windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Part and place of every window that equals an earlier one; parts come in order of their places."""
    sizes = np.array([len(p) + 1 for p in parts])
    # bytes of UTF-8 end at 244: one more leaves 0 for padding and 255 for the ends of parts
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    text = np.where(text == 255, text, text + 1).astype(np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    part = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(text)) - begins[part]
    suffixes = two_stage_sort(text, length)
    suffixes = suffixes[offset[suffixes] < windows[part[suffixes]]]
    new = common_prefixes(text, suffixes, length) < length
    if not len(suffixes):
        return suffixes, suffixes
    heads = np.flatnonzero(new)
    earliest = np.minimum.reduceat(suffixes, heads)[np.cumsum(new) - 1]
    again = np.sort(suffixes[suffixes != earliest])
    return part[again], offset[again]


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data = text.as_py().encode()
                rows += [(w["anchor"], doc, w["start"], w["n"], w["block"], w["blocks"], data[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted.as_py()]
            names = ["anchor", "doc", "start", "n", "block", "blocks", "data"]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _sort_buckets(length: int):
    def settle(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        doc, start, n = (t[c].to_numpy() for c in ("doc", "start", "n"))
        order = np.lexsort((start, doc))
        # rows that repeat an id and text bring their segments twice
        new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)])
        order = order[new]
        data = t["data"].to_pylist()
        part, offset = repeated_windows([data[i] for i in order.tolist()], n[order], length)
        # neighbouring windows make one run
        heads = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(part) else np.zeros(0, np.int64)
        ends = np.concatenate([heads[1:], [len(part)]]).astype(np.int64)[: len(heads)]
        owner = order[part[heads]]
        first = start[owner] + offset[heads]
        return pa.RecordBatch.from_arrays([pa.array(doc[owner]), pa.array(first), pa.array(first + (ends - heads) + length - 1)], names=["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in in_groups(batches, ["anchor", "i", "j"]):
            held.append(t)
            size += t["data"].nbytes
            if size >= SORT_BYTES:
                yield settle(held)
                held, size = [], 0
        if held:
            yield settle(held)

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """``doc, lo, hi``: runs of bytes covered by repeated strings; they may overlap. ``texts``: ``doc, text``."""
    rows = "anchor bigint, content bigint, doc bigint, start bigint, n bigint, settled boolean"
    every = materialize(texts.mapInArrow(_split(length, gram), rows), "anchors")
    end = F.col("start") + F.col("n") + (length - 1)
    local = every.filter("settled").select("doc", F.col("start").alias("lo"), end.alias("hi"))
    open_rows = every.filter(~F.col("settled")).drop("settled")
    shared = open_rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).select("anchor")
    shared = materialize(open_rows.join(shared, "anchor"), "shared-anchors")
    first = materialize(shared.groupBy("anchor", "content").agg(F.min(F.struct("doc", "start", "n")).alias("f")).select("anchor", "content", "f.*"), "first-segments")
    heads = first.select("anchor", "content", F.col("doc").alias("f_doc"), F.col("start").alias("f_start"))
    later = shared.join(heads, ["anchor", "content"]).filter((F.col("doc") != F.col("f_doc")) | (F.col("start") != F.col("f_start")))
    whole = later.select("doc", F.col("start").alias("lo"), end.alias("hi"))

    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
    blocks = F.ceil(F.col("m") / block).cast("int")
    differ = first.join(several, "anchor").select("anchor", "doc", "start", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("content"), blocks.cast("bigint")).cast("int").alias("block"))
    # a document's own segments: no more than its length allows
    wanted = materialize(differ.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "n", "block", "blocks")).alias("wanted")), "wanted-segments")
    data = "anchor bigint, doc bigint, start bigint, n bigint, block int, blocks int, data binary"
    fetched = texts.join(wanted, "doc")
    pieces = materialize(fetched.select("doc", "text", "wanted").mapInArrow(_fetch(length), data), "segments")
    dealt = pieces.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "start", "n", "data")
    dealt = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    sorted_out = materialize(dealt.mapInArrow(_sort_buckets(length), "doc bigint, lo bigint, hi bigint"), "repeated-windows")
    return local.unionByName(whole).unionByName(sorted_out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _cut(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                data, spans = (text.as_py() or "").encode(), merged([(s["lo"], s["hi"]) for s in spans.as_py() or []])
                at, kept = 0, []
                for lo, hi in spans:
                    kept.append(data[at:lo])
                    at = hi
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, keep_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left) of each row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    named = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    if named.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).take(1):
        # rows with one id but several texts: places are numbered by id and text
        marked = named.withColumn("mark", F.sha2(F.coalesce("text", F.lit("")), 256))
        order = global_rank(marked.select("doc", "mark").distinct(), [F.col("doc").asc(), F.col("mark").asc()], "place")
        named = materialize(marked.join(order, ["doc", "mark"]).select("doc_id", "text", F.col("place").alias("doc")), "numbered")
    spans = repeated_spans(named.select("doc", "text"), length, gram, block)
    lists = materialize(spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    joined = named.join(lists, "doc", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(keep_bytes), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
