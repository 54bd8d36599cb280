"""Secret scans behind a trigram inverted index; DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams. The index posts, for
every trigram that some rule asks for, the documents that hold it; a rule's candidates
are the documents whose postings satisfy its query, and only they are searched with its
expression. A rule without mandatory trigrams searches every text. The index is written
to the shared folder, sorted by trigram inside each file.

Spans are in code points. Splitting a text at the matches gives the lengths between
them, so positions are running sums of lengths; matches are found left to right without
overlap, and those shorter than a rule's least length are dropped afterwards.

Defined cases: a null text is empty and holds nothing; rows with equal id and text have
equal spans; a null id is kept; an empty table gives no rows; other columns pass through,
except those that bear the name of a new one.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.llm.trigrams import Clause, trigram_query, vocabulary
from biparta.session import materialize


class Rule(NamedTuple):
    kind: str
    regex: str
    least: int = 1  # least length of the group below
    group: int = 0


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [Rule("assign", ASSIGN, 12, 2), Rule("access", "AKIA[A-Z0-9]+", 18), Rule("hex", "[0-9a-f]{16,}", 16)]
MORE = [Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"), Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")]
RULES = BASE + MORE
SPAN = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Id and hash of a row: rows that agree on both hold the same text."""
    return F.col(id_col).alias("key_id"), F.xxhash64(text_col).alias("key_hash")


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram, key_id, key_hash`` of the trigrams asked for."""
    low = docs.select(*row_key(), F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(present).alias("trigram"), "key_id", "key_hash").sortWithinPartitions("trigram")


def satisfied(query: list[Clause], found: Column) -> Column:
    """Whether the set of trigrams found satisfies a query."""
    all_of = lambda alt: reduce(lambda a, b: a & b, [F.array_contains(found, t) for t in sorted(alt)])
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [all_of(alt) for alt in clause]) for clause in query])


def candidates(index: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """``key_id, key_hash, kinds``: rows that pass the query of one rule at least.

    Postings meet by document; a set holds no more than the rules' vocabulary.
    """
    sets = index.groupBy("key_id", "key_hash").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*[F.when(satisfied(q, F.col("found")), F.lit(k)) for k, q in queries.items()]))
    return sets.select("key_id", "key_hash", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def rule_spans(rule: Rule, place: int, text: Column) -> Column:
    """Spans of a rule in a text, whatever the index says."""
    gaps = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("len"))), part, lambda s, p: F.struct(s.gap.alias("gap"), s.len.alias("len"), F.length(p).alias("part")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(SPAN).alias("spans"))

    def add(acc: Column, s: Column) -> Column:
        first = acc.at + s.gap
        span = F.struct(first.alias("start"), F.lit(place).alias("place"), (first + s.len).alias("end"), F.lit(rule.kind).alias("kind"))
        spans = F.coalesce(acc.spans, F.array().cast(SPAN))
        return F.struct((first + s.len).alias("at"), F.when(s.part >= rule.least, F.concat(spans, F.array(span))).otherwise(spans).alias("spans"))

    return F.when(text.rlike(rule.regex), F.aggregate(steps, start, add, lambda acc: acc.spans))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then rule order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: the spans of each row, sorted by start and rule order."""
    own = ["key_id", "key_hash", "secret_candidate", "secret_spans"]
    rows = docs.drop(*[c for c in docs.columns if c in own and c not in (id_col, text_col)])
    text = F.coalesce(text_col, F.lit(""))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    gated = rows.withColumn("secret_candidate", F.lit(None).cast("array<string>"))
    if queries:
        small = rows.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        index = materialize(build_index(small, vocabulary(list(queries.values()))), "postings")
        passed = materialize(candidates(index, queries), "candidates").withColumnRenamed("kinds", "secret_candidate")
        same = (F.xxhash64(text) == F.col("key_hash")) & F.col(id_col).eqNullSafe(F.col("key_id"))
        gated = rows.join(passed, same, "left").drop("key_id", "key_hash")
    none = F.array().cast(SPAN)
    parts = []
    for place, r in enumerate(rules):
        spans = rule_spans(r, place, text)
        parts.append(F.coalesce(F.when(F.array_contains("secret_candidate", r.kind), spans) if r.kind in queries else spans, none))
    return gated.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop("secret_candidate")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of base spans, and all spans as text."""
    base = [r.kind for r in BASE]
    n = lambda k: F.size(F.filter("secret_spans", lambda s: s.kind == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in base], F.sha2(joined(F.filter("secret_spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with a mark in place of every span; spans that overlap share one."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        out = F.when(s.start >= acc.at, F.concat(acc.out, gap, F.lit(mark))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc.out, F.substring(text, (acc.at + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
