"""Registered queries of this package, with SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biparta.llm import bpe_words, jaccard_join, language_id, merkle, mixing, near_vectors, packing, permutation_index, secret_scan, shard_table, suffix_dedup, token_links, url_trust
from biparta.plans.registry import sql_uniform

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = packing.pack(table(spark, d, "documents"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    return shard_table.assign_shards(table(spark, d, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held = language_id.is_held_out()
    model = language_id.train(docs.filter(~held))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


_NUL = r"[^\x20\x09-\x0D]+"
_OP4 = f"""WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_NUL}')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM per),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100 - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level FROM weighed
  WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM levels),
expected AS (SELECT s.doc_id, s.size, s.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
    {sql_uniform(mixing.SEED, 's.doc_id')} AS u FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, CAST(floor(e) AS BIGINT) AS certain, CASE WHEN e - floor(e) > 0 THEN u / (1 - u) * ((1 - (e - floor(e))) / (e - floor(e))) END AS rank FROM expected),
fixed AS (SELECT source, CAST(sum(certain * size) AS DOUBLE) AS words FROM ranked GROUP BY source),
alike AS (SELECT source, rank, doc_id, size, CAST(sum(size) AS BIGINT) AS words FROM ranked WHERE rank IS NOT NULL GROUP BY ALL),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words / 2.0 AS at FROM alike),
chosen AS (SELECT r.*, coalesce(a.at <= r.target - f.words, false) AS extra FROM ranked r JOIN fixed f ON r.source IS NOT DISTINCT FROM f.source
  LEFT JOIN running a ON r.source IS NOT DISTINCT FROM a.source AND r.rank = a.rank AND r.doc_id = a.doc_id AND r.size = a.size)
SELECT doc_id, size, source_size, target, (certain + extra::BIGINT) * size AS taken FROM chosen"""


@query("op4_mixing", _OP4)
def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    m = mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def _spans_sql(rules: list[secret_scan.Rule]) -> str:
    """One SELECT per rule: text positions are running sums over what lies between matches."""
    out = []
    for place, r in enumerate(rules):
        # letters of both cases spelled out: a case-blind match would admit more than ASCII
        rx = r.regex
        if "(?i:" in rx:
            inner = rx[rx.index("(?i:") + 4 : rx.index(")", rx.index("(?i:"))]
            rx = rx.replace(f"(?i:{inner})", "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in inner))
        rx = rx.replace("'", "''")
        whole, part, gaps = f"regexp_extract_all(text, '{rx}')", f"regexp_extract_all(text, '{rx}', {r.group})", f"string_split_regex(text, '{rx}')"
        out.append(f"""SELECT n, unnest(range(1, len(m) + 1)) AS i, {place} AS place, '{r.kind}' AS kind, m, p, g, {r.least} AS least
  FROM (SELECT n, {whole} AS m, {part} AS p, {gaps} AS g FROM docs)""")
    return "\nUNION ALL ".join(out)


_OP8 = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({_spans_sql(secret_scan.RULES)}),
placed AS (SELECT n, place, kind, list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS s, length(m[i]) AS w FROM hits WHERE length(p[i]) >= least),
texts AS (SELECT n, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + w)::BIGINT, ',' ORDER BY s, place) AS every,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + w)::BIGINT, ',' ORDER BY s, place) FILTER (place < 3) AS base FROM placed GROUP BY n)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM docs LEFT JOIN texts USING (n)"""


@query("op8_secret_scan", _OP8)
def op8_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, d, "documents").select("doc_id", "text")))


def _rules_sql(field: int) -> str:
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, a)[field]}'" for a, h, p in sorted(url_trust.RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    return "CASE " + " ".join(cases) + " END"


def _host_sql(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), '{url_trust.UPPER}', '{url_trust.LOWER}')"


def _walk_sql() -> str:
    steps = ["s0 AS (SELECT host, way, seed, linked, seed AS x FROM nodes)"]
    for i in range(url_trust.most_steps()):
        d = url_trust.DAMPING
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT n.host, n.way, n.seed, n.linked, {1 - d!r} * n.seed + {d} * (coalesce(m.got, 0) + coalesce(n.seed * k.lost / nullif(k.seeds, 0), 0)) AS x FROM nodes n
  LEFT JOIN (SELECT a.b AS host, a.way, sum(s.x * a.p) AS got FROM s{i} s JOIN shares a ON a.host = s.host AND a.way = s.way GROUP BY 1, 2) m ON m.host = n.host AND m.way = n.way
  JOIN (SELECT way, sum(CASE WHEN linked THEN 0 ELSE x END) AS lost, sum(seed) AS seeds FROM s{i} GROUP BY way) k ON k.way = n.way)""")
    return ",\n".join(steps)


_LINK_SQL = r"""[hH][rR][eE][fF]\s*=\s*["''']([^"''<>]*)["'']""".replace("'''", "''")
_OP9 = f"""WITH pages_ AS (SELECT page_id, html, {_host_sql('url')} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rows_ AS (SELECT page_id, host, path, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS action FROM pages_),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked FROM rows_ WHERE host <> '' GROUP BY host),
found AS (SELECT host AS src, {_host_sql("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{_LINK_SQL}', 1)) AS link FROM pages_) WHERE contains(link, '//')),
links AS (SELECT src, dst, count(*)::DOUBLE AS w FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
arcs AS (SELECT 0 AS way, src AS host, dst AS b, w FROM links UNION ALL SELECT 1, dst, src, w FROM links),
shares AS MATERIALIZED (SELECT way, host, b, w / sum(w) OVER (PARTITION BY way, host) AS p FROM arcs),
seeds AS (SELECT host, 0 AS way, allowed::DOUBLE AS seed FROM hosts UNION ALL SELECT host, 1, blocked::DOUBLE FROM hosts),
every AS (SELECT * FROM seeds UNION ALL SELECT DISTINCT b, way, 0.0::DOUBLE FROM shares WHERE b NOT IN (SELECT host FROM hosts)),
nodes AS MATERIALIZED (SELECT host, way, seed, (host, way) IN (SELECT (host, way) FROM shares) AS linked FROM every),
{_walk_sql()},
verdicts AS (SELECT h.host, round(sum(CASE WHEN way = 1 THEN x ELSE -x END) / any_value(h.n), 6) AS host_score FROM hosts h JOIN s{url_trust.most_steps()} s USING (host) GROUP BY h.host)
SELECT page_id, r.host, path, rule, coalesce(action, CASE WHEN host_score > {url_trust.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM rows_ r LEFT JOIN verdicts v ON v.host = r.host"""


@query("op9_url_trust", _OP9)
def op9_url_trust(spark: SparkSession, d: str) -> DataFrame:
    return url_trust.filter_urls(table(spark, d, "pages")).drop("host_score")


@query("op10_ngram_join")
def op10_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.near_copies(table(spark, d, "documents"))


@query("op5_near_vectors")
def op5_near_vectors(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, d, "embeddings"))


@query("op6_permutation_index")
def op6_permutation_index(spark: SparkSession, d: str) -> DataFrame:
    return permutation_index.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, d, "documents"), keep_bytes=False).drop("kept")


# the checksum of an id's digits, bit by bit; the constants are those of the public CRC-32
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree_sql(name: str, nodes: str) -> str:
    return f"""{name}(lvl, tree, rank, digest, n) AS (SELECT 0, tree, rank, digest, count(*) OVER (PARTITION BY tree) FROM {nodes}
  UNION ALL SELECT lvl + 1, tree, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY lvl, tree, rank // 2)"""


def _fold_sql(name: str, start: str, tree: str) -> str:
    return f"""{name}(k, tree, lvl, rank, acc, proof) AS ({start}
  UNION ALL SELECT f.k, f.tree, f.lvl + 1, f.rank // 2, sha256(CASE WHEN f.rank % 2 = 1 THEN s.digest || f.acc ELSE f.acc || coalesce(s.digest, '') END), f.proof || coalesce(s.digest, '')
  FROM {name} f JOIN {tree}_heights h ON h.tree = f.tree AND f.lvl < h.height LEFT JOIN {tree} s ON s.tree = f.tree AND s.lvl = f.lvl AND s.rank = xor(f.rank, 1))"""


_OP11 = f"""WITH RECURSIVE framed AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
  CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS shown FROM documents),
leaves AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, row_number() OVER () AS k FROM framed),
{_tree_sql("low", "leaves")},
low_heights AS (SELECT tree, max(lvl) AS height FROM low GROUP BY 1),
subs AS (SELECT tree AS grp, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS rank FROM low WHERE n = 1),
{_tree_sql("top", "subs")},
top_heights AS (SELECT tree, max(lvl) AS height FROM top GROUP BY 1),
{_fold_sql("inner_", "SELECT k, tree, 0, rank, coalesce(shown, leaf), '' FROM leaves", "low")},
joined AS (SELECT i.k, s.tree, 0 AS lvl, s.rank, i.acc, i.proof, s.digest AS subroot FROM inner_ i JOIN low_heights h ON h.tree = i.tree AND h.height = i.lvl JOIN subs s ON s.grp = i.tree),
{_fold_sql("outer_", "SELECT k, tree, lvl, rank, acc, proof FROM joined", "top")}
SELECT l.doc_id, l.leaf, j.subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.acc AS folded_root, o.acc = r.digest AS verified
FROM leaves l JOIN joined j ON j.k = l.k JOIN outer_ o ON o.k = l.k JOIN top_heights h ON h.height = o.lvl CROSS JOIN (SELECT digest FROM top WHERE n = 1) r"""


@query("op11_merkle_manifest", _OP11)
def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return merkle.verify(table(spark, d, "documents"), crc % 7 == 0, F.col("n_chars") + 1).drop("proof")


@query("op12_bpe_words")
def op12_bpe_words(spark: SparkSession, d: str) -> DataFrame:
    return bpe_words.encode_decode(table(spark, d, "documents"), keep=False)


@query("op13_token_links")
def op13_token_links(spark: SparkSession, d: str) -> DataFrame:
    return token_links.count_links(table(spark, d, "documents"))[0]
