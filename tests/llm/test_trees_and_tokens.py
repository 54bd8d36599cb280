"""Manifest, distinct-word encoding and tokenizer alignment against plain versions, on odd rows too."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from biparta.llm import bpe_words, merkle, token_links
from check import compare, connect

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, digest string, chunk bigint, part int, pair string"
TEXTS = [
    "a <|endoftext|> b", "foo  <|endoftext|>x<|endoftext|>", "</s> <s> <unk>", "it's I'll  don't,.,  x, y.\n\n  z;;a ,b", "a\x85b\x1cc d  　e",
    "x" * 20000, " " * 3000, "é,à.b c'est l'á ,,, ś, aś, Łb.", "\r\n\t x\r\n y", "中文，字。 abc。", "a\x00b\x00 \x00", "😀😀, 😀", "�▁ x ", "  a   b\n c \nd\n\ne \n f",
    "\n", "\nx", " \n ", "x ", "ﬁ ﬃ ①", "a);\r\nb();\r\n", "a　b   c", "word again word, again. word", "word again word, again. word", None, "",
]
ROWS = [(i if i != 3 else None, t, (None, "en", "de", "")[i % 4], None if i % 5 == 0 else "s", None if i % 3 == 0 else i, 7, "x", 1, 2, "p") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[21]] * 3


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([h(*at[i : i + 2]) for i in range(0, len(at), 2)])
    return levels


def plain_path(levels, rank):
    out = []
    for level in levels[:-1]:
        out.append((level[rank ^ 1] if rank ^ 1 < len(level) else "", rank & 1))
        rank >>= 1
    return out


def plain_manifest(rows):
    def leaf(doc, text, lang, source, n):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)])

    groups = collections.defaultdict(list)
    for doc, text, lang, source, n, *_ in rows:
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
        groups["" if lang is None else "+" + lang].append((doc is not None, doc or 0, leaf(doc, text, lang, source, n), doc, leaf(doc, text, lang, source, n + hit if n is not None else None)))
    trees = {k: plain_tree([x[2] for x in sorted(v)]) for k, v in groups.items()}
    keys = sorted(trees)
    top = plain_tree([trees[k][-1][0] for k in keys])
    out = []
    for k, v in groups.items():
        for rank, (_, _, plain, doc, shown) in enumerate(sorted(v)):
            path = plain_path(trees[k], rank) + plain_path(top, keys.index(k))
            acc = shown
            for sibling, right in path:
                acc = h(sibling, acc) if right else h(acc, sibling)
            out.append((doc, plain, trees[k][-1][0], top[-1][0], h(*[s for s, _ in path]), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(odd, height):
    got = merkle.verify(odd, tampered(), F.col("n_chars") + 1, height=height).drop("proof")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == plain_manifest(ROWS) and {r[-1] for r in rows} == {True, False}


def test_manifest_small(spark, odd, none):
    assert merkle.verify(none, tampered(), F.col("n_chars") + 1).count() == 0
    one = odd.filter("doc_id = 1")
    (r,) = merkle.verify(one, F.lit(False), F.col("n_chars")).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == [] and r.proof_sha256 == h("")


def test_store_is_content_addressed(odd):
    m = merkle.build_manifest(odd, height=2)
    records = {r.digest: r.children for r in m.records().collect()}
    assert all(h(c) == d for d, c in records.items())
    seen, todo = set(), [m.root().first().root]
    while todo:
        at = todo.pop()
        seen.add(at)
        todo += [records[at][i : i + 64] for i in range(0, len(records[at]), 64)] if at in records else []
    assert set(records) <= seen and {r.leaf for r in m.leaves.collect()} <= seen
    few = merkle.prove(m, m.leaves.filter("rank = 0"), height=2)
    assert few.count() == 4


def test_manifest_sql(spark, sf):
    text, ok = compare(spark, connect(sf), "op11_merkle_manifest", queries()["op11_merkle_manifest"], oracle_sql()["op11_merkle_manifest"], sf)
    assert ok, text


def plain_codes(texts):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(bpe_words.TOKENIZER)
    for t in texts:
        ids = full.encode(t or "", add_special_tokens=False).ids
        yield ids, full.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chunk_bytes", [1, 500, 10**9])
def test_words_encode_and_decode(odd, chunk_bytes):
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_words.encode_decode(odd, chunk_bytes=chunk_bytes).collect())
    want = collections.Counter()
    for row, (ids, text) in zip(ROWS, plain_codes([r[1] for r in ROWS]), strict=True):
        want[row[0], tuple(ids), text, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_words_query(spark, sf, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op12_bpe_words"](spark, sf).collect()}
    want = {d.doc_id: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, (ids, t) in zip(docs, plain_codes([d.text for d in docs]), strict=True)}
    assert got == want
    assert bpe_words.encode_decode(none).count() == 0


def test_words_are_cut_where_the_tokenizer_cuts():
    from tokenizers import Tokenizer

    full, cut = Tokenizer.from_file(bpe_words.TOKENIZER), bpe_words.word_splitter(bpe_words.special_tokens(bpe_words.TOKENIZER))
    rng = np.random.default_rng(3)
    pool = list(" \n\t\x85\xa0 　\x1c,.!'sabé1_ś") + ["<|endoftext|>"]
    for _ in range(5000):
        t = "".join(rng.choice(pool, rng.integers(1, 14)))
        assert [i for e in full.encode_batch(cut(t), add_special_tokens=False) for i in e.ids] == full.encode(t, add_special_tokens=False).ids, t


def plain_alignment(text, a, b, a_bytes, b_bytes):
    """Ids of both, links as id pairs, groups as text, pairs that share a group; nothing where bytes differ."""
    if not text:
        return None
    whole = (" " + text).encode()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[i] for i in x) != whole or b"".join(b_bytes[i] for i in y) != whole:
        return None
    links, groups, shared = [], [], 0
    i = j = i0 = j0 = 0
    end_x, end_y = list(itertools.accumulate(len(a_bytes[t]) for t in x)), list(itertools.accumulate(len(b_bytes[t]) for t in y))
    while i < len(x) and j < len(y):
        links.append((x[i], y[j]))
        p, q = end_x[i], end_y[j]
        i, j = i + (p <= q), j + (q <= p)
        if p == q:
            groups.append(",".join(map(str, x[i0:i])) + "|" + ",".join(map(str, y[j0:j])))
            shared += (i - i0) * (j - j0)
            i0, j0 = i, j
    return x, y, links, groups, shared


def plain_links(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_links.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_links.PIECE_BPE)
    a_bytes, b_bytes = token_links.ByteBpe(token_links.BYTE_BPE).bytes, token_links.PieceBpe(token_links.PIECE_BPE).bytes
    found = [(doc, plain_alignment(t, a, b, a_bytes, b_bytes)) for doc, t in rows]
    counts = collections.Counter(p for _, f in found if f for p in set(f[2]))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = collections.Counter()
    for doc, f in found:
        if f is None:
            out[doc, 0, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            x, y, links, groups, shared = f
            out[doc, len(x), len(y), len(groups), len(links), shared, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk_bytes", [1, 10**9])
def test_links_odd(odd, chunk_bytes):
    got = collections.Counter(map(tuple, token_links.count_links(odd, chunk_bytes=chunk_bytes)[0].collect()))
    assert got == plain_links([r[:2] for r in ROWS])


def test_links_query(spark, sf, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries()["op13_token_links"](spark, sf)
    assert collections.Counter(map(tuple, got.collect())) == plain_links([tuple(d) for d in docs])
    assert token_links.count_links(none)[0].count() == 0


def test_products_equal_dense_ones():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = rng.random((rng.integers(1, 9), 7)) < 0.4, rng.random((7, rng.integers(1, 9))) < 0.4
        rows = [token_links.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1]) for m in (x, y)]
        found, values = token_links.product(*rows)
        dense = np.zeros((len(x), y.shape[1]), int)
        dense[token_links.row_of(found), found.indices] = values
        assert (dense == x.astype(int) @ y.astype(int)).all()
        back = token_links.transpose(rows[0])
        assert (np.diff(back.indptr) == x.sum(0)).all()
        parts = [rng.multinomial(20, np.ones(n) / n) for n in rng.integers(1, 9, 2)]
        al = token_links.align(*[p[p > 0] for p in parts])
        a, b = token_links.group_links(al)
        assert {(i, j) for i in range(len(al.a_group)) for j in range(len(al.b_group)) if al.a_group[i] == al.b_group[j]} == set(zip(a.tolist(), b.tolist(), strict=True))
        assert token_links.group_link_counts(al).sum() == len(a) and set(zip(al.a.tolist(), al.b.tolist(), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True))
