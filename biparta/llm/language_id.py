"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. The likelihood
of a word is the sum over all ways to segment it into pieces, found by a forward pass;
that of a text is the product over its words. Piece probabilities are fitted by
expectation maximisation on expected piece counts (forward-backward), on a sample of the
labelled documents: whole texts, about ``SAMPLE_DOCS`` per language, chosen by a hash of
the id. Words are maximal runs of letters, lower-cased; what no piece covers is taken
letter by letter with a learned probability.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is
every text where no language could be learned; ties go to the language that sorts first;
the score is the posterior of the language under equal priors, between 0 and 1; rows with
null language are not learned from; repeated rows count as often as they occur; words
beyond ``LONG_WORD`` letters are cut into parts of that length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.session import materialize

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SAMPLE_DOCS = 600
SEED = 5
ROUNDS = 2
SMOOTHING = 0.05
LONG_WORD = 40
MAX_PIECE = 16
# Words that a worker keeps scores of, and new words scored in one go.
MEMO_ENTRIES = 300_000
NEW_WORDS = 20_000
# Letters of the texts whose words are held at once.
PART_LETTERS = 4_000_000
UNKNOWN = "und"
START = "▁"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if len(text) > LONG_WORD and found and max(map(len, found)) > LONG_WORD:
        found = [w[i : i + LONG_WORD] for w in found for i in range(0, len(w), LONG_WORD)]
    return found


def load_pieces(path: str) -> list[str]:
    """Pieces that a lower-cased word can contain, in vocabulary order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        body = p[1:] if p[:1] == START else p
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and body.isalpha() and p == p.lower() and len(p) <= MAX_PIECE:
            out.append(p)
    return out


def with_prefixes(index: dict[str, int]) -> dict[str, int]:
    """``index`` and -1 for what only begins a piece: a string that is not in it begins none."""
    out = {p[:i]: -1 for p in index for i in range(1, len(p))}
    out.update(index)
    return out


class Lattice:
    """All segmentations of a batch of words, as arrays of edges.

    Piece 0 stands for a letter that no single-letter piece covers; a start mark counts
    as part of the first letter.
    """

    def __init__(self, words: list[str], index: dict[str, int], longest: int, walk: dict[str, int] | None = None):
        word, begin, end, piece = [], [], [], []
        get = (with_prefixes(index) if walk is None else walk).get
        self.length = np.array([len(w) for w in words], np.int64)
        for k, w in enumerate(words):
            n = len(w)
            ends, pieces = [], []
            # from the first letter, with the start mark or else without it
            marked, alive, plain = START + w, True, True
            for j in range(1, min(n, longest) + 1):
                p = get(marked[: j + 1]) if alive else None
                alive = p is not None
                if p is None or p < 0:
                    q = get(w[:j]) if plain else None
                    plain = q is not None
                    p = q
                if p is not None and p >= 0:
                    ends.append(j)
                    pieces.append(p)
                elif j == 1:
                    ends.append(j)
                    pieces.append(0)
                if not (alive or plain):
                    break
            starts = [0] * len(ends)
            for i in range(1, n):
                p = get(w[i : i + 1])
                starts.append(i)
                ends.append(i + 1)
                pieces.append(p if p is not None and p >= 0 else 0)
                if p is None:
                    continue
                for j in range(i + 2, min(n, i + longest) + 1):
                    p = get(w[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        starts.append(i)
                        ends.append(j)
                        pieces.append(p)
            word += [k] * len(ends)
            begin += starts
            end += ends
            piece += pieces
        order = np.lexsort((word, end)) if word else np.zeros(0, np.int64)
        self.word, self.begin, self.end, self.piece = (np.array(x, np.int64)[order] for x in (word, begin, end, piece))
        self.n = len(words)

    def _steps(self, by: np.ndarray) -> list[slice]:
        cuts = np.flatnonzero(np.diff(by)) + 1
        edges = np.concatenate([[0], cuts, [len(by)]])
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, place, language]; p[piece, language]."""
        alpha = np.zeros((self.n, LONG_WORD + 1, p.shape[1]))
        alpha[:, 0] = 1.0
        for s in self._steps(self.end):
            w = self.word[s]
            x = alpha[w, self.begin[s]] * p[self.piece[s]]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
            alpha[w[heads], self.end[s][0]] = np.add.reduceat(x, heads, axis=0)
        return alpha

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        a = self.forward(p)
        return np.log(np.maximum(a[np.arange(self.n), self.length], 1e-300))

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece, words weighted; p has one column."""
        alpha = self.forward(p)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.length] = 1.0
        order = np.lexsort((self.word, -self.begin))
        w, b, e, x = self.word[order], self.begin[order], self.end[order], p[self.piece[order], 0]
        for s in self._steps(b):
            np.add.at(beta, (w[s], b[s]), x[s] * beta[w[s], e[s]])
        total = np.maximum(alpha[np.arange(self.n), self.length], 1e-300)
        share = alpha[w, b] * x * beta[w, e] / total[w] * weight[w]
        return np.bincount(self.piece[order], weights=share, minlength=len(p))


class Model:
    """Languages (sorted) and the log of nothing: plain probabilities per piece and language."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p
        self.index = {s: i + 1 for i, s in enumerate(pieces)}
        self.walk = with_prefixes(self.index)
        self.longest = max(map(len, pieces), default=1)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def __reduce__(self):
        return Model, (self.pieces, self.languages, self.p)

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), NEW_WORDS):
            part = new[i : i + NEW_WORDS]
            base = len(self.rows)
            self.scores = np.concatenate([self.scores[:base], Lattice(part, self.index, self.longest, self.walk).log_likelihood(self.p)])
            self.rows.update(zip(part, range(base, base + len(part)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the words of about PART_LETTERS of text are held at once."""
        langs, scores = [], []
        upto = np.cumsum([len(t) if t else 0 for t in texts])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PART_LETTERS, "right")))
            some = self._predict(texts[lo:hi])
            langs += some[0]
            scores += some[1]
            lo = hi
        return langs, scores

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(t) if t else [] for t in texts]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        for i, words in enumerate(lists):
            if not words:
                continue
            new = [w for w in dict.fromkeys(words) if w not in self.rows]
            if len(self.rows) + len(new) > MEMO_ENTRIES:
                self.rows, self.scores = {}, self.scores[:0]
                new = list(dict.fromkeys(words))
            if new:
                # words of the next texts too, so that batches are worth while
                if len(new) < NEW_WORDS and len(self.rows) + NEW_WORDS < MEMO_ENTRIES:
                    seen = dict.fromkeys(new)
                    for more in lists[i + 1 :]:
                        if len(seen) >= NEW_WORDS:
                            break
                        seen.update((w, None) for w in more if w not in self.rows)
                    new = list(seen)
                self.learn(new)
            total = self.scores[[self.rows[w] for w in words]].sum(axis=0)
            best = int(total.argmax())
            langs[i], scores[i] = self.languages[best], float(1 / np.exp(total - total[best]).sum())
        return langs, scores


def train(docs: DataFrame, pieces_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit one unigram model per non-null language of ``docs``.

    The driver receives one count per piece and language: the model itself.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(sizes, "lang").filter(draw < F.lit(float(sample_docs)) / F.col("n")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple[str, str], int] = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n.update((lang, w) for w in words_of(text))
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    words = chosen.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    pieces = load_pieces(pieces_path)
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    p = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    for _ in range(rounds if languages else 0):
        model = Model(pieces, languages, p)

        def expect(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                langs = np.array(b.column(0).to_pylist(), dtype=object)
                words, n = b.column(1).to_pylist(), b.column(2).to_numpy()
                for k, lang in enumerate(model.languages):
                    at = np.flatnonzero(langs == lang)
                    if not len(at):
                        continue
                    lattice = Lattice([words[i] for i in at], model.index, model.longest, model.walk)
                    x = lattice.expected(model.p[:, k : k + 1], n[at].astype(float))
                    used = np.flatnonzero(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(x[used])], names=["lang", "piece", "x"])

        counts = words.mapInArrow(expect, "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).toArrow()
        c = np.full_like(p, SMOOTHING)
        c[counts["piece"].to_numpy(), counts["lang"].to_numpy()] += counts["x"].to_numpy()
        p = c / c.sum(axis=0)
    return Model(pieces, languages, p)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts):
        import pandas as pd

        langs, scores = held.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "lid_guess")]
    return docs.withColumn("lid_guess", guess(F.col(text_col))).select(*names, "lid_guess.lang_pred", "lid_guess.score")


def is_held_out(id_col: str = "doc_id") -> Column:
    """Held out by crc32 of the id as text; rows without id are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
