"""Operators against brute force on small and on skewed data."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from biparta.operators import components, features, graph, history, metrics, negatives, neighbors, ordering, projection, ranking, reports, skew, splits
from biparta.streaming import stateful, streams

HOT = 0.4  # share of rows on one key


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(600):
        c = 0 if rng.random() < HOT else rng.randrange(1, 30)
        out.append((c, 0 if rng.random() < HOT else rng.randrange(1, 25), float(rng.randrange(0, 90) * 86400), float(rng.randrange(1, 1000)), i))
    return out


@pytest.fixture(scope="module")
def inv(spark, rows):
    return spark.createDataFrame(rows, "company int, investor int, ts double, raised double, idx int")


@pytest.fixture(scope="module")
def edges(inv):
    return graph.edge_rollup(inv)


def test_global_rank_is_a_permutation(inv, rows):
    got = ordering.global_rank(inv, [F.col("company").asc(), F.col("idx").asc()], "r", start=0).select("company", "idx", "r").collect()
    want = {i: k for k, (c, i) in enumerate(sorted((r[0], r[4]) for r in rows))}
    assert {x["idx"]: x["r"] for x in got} == want


def test_running_sum_by_group(inv, rows):
    got = ordering.running_sum(inv, [F.col("idx").asc()], {"s": "raised"}, by=("company",)).collect()
    sums, want = defaultdict(float), {}
    for c, _, _, raised, i in rows:
        sums[c] += raised
        want[i] = sums[c]
    assert {x["idx"]: x["s"] for x in got} == pytest.approx(want)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("buckets", [1, 7])
def test_as_of(inv, rows, inclusive, buckets):
    got = history.as_of(
        inv, inv, ["company"], sums={"n": F.lit(1), "t": F.col("raised")}, maxes={"last": F.col("ts"), "s": F.struct("ts", "idx")}, inclusive=inclusive, buckets=buckets
    ).collect()
    assert len(got) == len({(r[0], r[2]) for r in rows})
    for x in got:
        past = [r for r in rows if r[0] == x["company"] and (r[2] <= x["ts"] if inclusive else r[2] < x["ts"])]
        assert x["n"] == len(past)
        assert x["t"] == pytest.approx(sum(r[3] for r in past))
        assert x["last"] == (max(r[2] for r in past) if past else None)
        assert (tuple(x["s"]) if x["s"] else None) == (max((r[2], r[4]) for r in past) if past else None)


def test_recent_neighbors(inv, rows):
    adj = neighbors.temporal_adjacency(inv)
    index = neighbors.NeighborIndex(adj)
    got = defaultdict(list)
    for x in index.recent(adj.select("side", "id", "ts", "idx"), 3).orderBy("slot").collect():
        got[(x["side"], x["idx"])].append(x["neighbor_idx"])
    for c, v, ts, _, i in rows:
        for side, k, me in (("company", 0, c), ("investor", 1, v)):
            past = sorted(((r[2], r[4]) for r in rows if r[k] == me and r[2] < ts), reverse=True)[:3]
            assert got.get((side, i), []) == [p[1] for p in past]


def test_uniform_neighbors_lie_in_the_past(inv):
    adj = neighbors.temporal_adjacency(inv)
    got = neighbors.NeighborIndex(adj).uniform(adj.select("side", "id", "ts", "idx"), 4, seed=1)
    assert got.filter(F.col("neighbor_ts") >= F.col("ts")).isEmpty()
    assert got.groupBy("side", "idx").count().filter("count <> 4").isEmpty()


def test_plausible_negatives_fill_every_slot(spark):
    # investor 0 has funded all but 3 of 40 companies: many rounds are needed
    rows = [(c, 0, 0.0, 1.0, c) for c in range(37)] + [(c, 1, 0.0, 1.0, 100 + c) for c in range(37, 40)]
    inv = spark.createDataFrame(rows, "company int, investor int, ts double, raised double, idx int")
    got = defaultdict(list)
    for x in negatives.plausible_negatives(inv, inv, 3, seed=2).collect():
        got[x["idx"]].append(x["negative"])
    for c, v, *_, i in rows:
        funded = {r[0] for r in rows if r[1] == v}
        assert len(got[i]) == len(set(got[i])) == 3
        assert not funded & set(got[i])
        if v == 0:
            assert set(got[i]) == {37, 38, 39}


def test_hard_negatives_prefer_similar(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0])] + [(i, [1.0, 0.0] if i <= 5 else [-1.0, 0.0]) for i in range(1, 41)] + [(41, None)], "id int, vec array<double>")
    queries = spark.range(50).select(F.col("id").alias("idx"), (F.col("id") % 2).alias("who"), F.lit(0).alias("positive"))
    known = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (1, 40), (1, 40)], "who long, negative int")
    for top_k in (None, 3):
        per_block = [sorted(negatives.hard_negatives(queries, emb, 4, known, "who", top_k=top_k, block=b).collect()) for b in (7, 512)]
        assert per_block[0] == per_block[1]
        hard = [r for r in per_block[0] if r["kind"] == "hard"]
        assert len(hard) == 100 and len(per_block[0]) == 200
        assert all(1 <= r["negative"] <= 5 for r in hard)
        assert not any(r["idx"] % 2 and r["negative"] in (0, 1, 40) for r in per_block[0])
        assert not any(r["negative"] in (0, 41) for r in per_block[0])


def test_long_walks_are_listed_in_parts(spark):
    rows = spark.range(2).withColumns({"__step": F.lit(3_999_999_000), "__offset": F.lit(5)})
    got = negatives._turns(rows, 3_999_990_000, 3_999_992_500).withColumn("place", negatives._place(4_000_000_007)).collect()
    assert sorted((r["id"], r["turn"]) for r in got) == [(i, t) for i in range(2) for t in range(3_999_990_000, 3_999_992_500)]
    assert all(r["place"] == (3_999_999_000 * r["turn"] + 5) % 4_000_000_007 for r in got)


def test_as_of_cuts_hot_keys_by_their_rows(spark, monkeypatch):
    events = spark.range(200).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("ts"))
    monkeypatch.setattr(history, "BUCKET_ROWS", 3)
    got = history.as_of(events, events, ["k"], sums={"n": F.lit(1)}).collect()
    assert sorted((r["ts"], r["n"]) for r in got) == [(float(i), i) for i in range(200)]


def test_hard_negatives_of_a_source_linked_to_all(spark):
    emb = spark.createDataFrame([(i, [1.0]) for i in range(3)], "id int, vec array<double>")
    queries = spark.createDataFrame([(0, 7, 0), (1, 8, 1)], "idx int, who int, positive int")
    known = spark.createDataFrame([(7, 0), (7, 1), (7, 2), (8, 0), (8, 1)], "who int, negative int")
    got = negatives.hard_negatives(queries, emb, 4, known, "who", block=2).collect()
    assert {(r["idx"], r["negative"]) for r in got} == {(1, 2)}
    assert sorted((r["slot"], r["kind"]) for r in got) == [(0, "hard"), (1, "random"), (2, "random"), (3, "random")]


def _union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("hot_rows", [10, skew.HOT_ROWS])
def test_components(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(components, "HOT_ROWS", hot_rows)
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components.star_components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert got == _union_find(pairs)


def test_bipartite_check(spark):
    even = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (7, 8)], "u int, v int")
    odd = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "u int, v int")
    loop = spark.createDataFrame([(1, 2), (5, 5)], "u int, v int")
    assert [components.is_bipartite(x).first()[0] for x in (even, odd, loop)] == [True, False, False]


def test_ranking_with_hot_nodes(edges, monkeypatch):
    plain = {(r["side"], r["id"]): r["score"] for r in ranking.fixed_scores(edges, 3).collect()}
    real = skew.hot_keys
    monkeypatch.setattr(ranking, "hot_keys", lambda c, k, n: real(c, k, n, hot_rows=12))
    graph_ = ranking.RankGraph(edges)
    assert graph_.any_hot
    salted = {(r["side"], r["id"]): r["score"] for r in graph_.run(3).collect()}
    assert salted == pytest.approx(plain)


def test_transition_columns_sum_to_one(edges):
    n = ranking.RankGraph(edges, 0.8, -0.6).nodes
    c = n.filter("side = 'company'").select(F.col("id").alias("company"), "penalty")
    v = n.filter("side = 'investor'").select(F.col("id").alias("investor"), "norm")
    sums = edges.join(c, "company").join(v, "investor").groupBy("investor").agg(F.sum(F.col("penalty") / F.col("norm")).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


@pytest.mark.parametrize("side", ["company", "investor"])
def test_projection(spark, side):
    rng = random.Random(8)
    pairs = {(rng.randrange(25), rng.randrange(40)) for _ in range(70)}
    e = spark.createDataFrame(list(pairs), "company int, investor int")
    k, o = (0, 1) if side == "company" else (1, 0)
    near = defaultdict(set)
    for a in pairs:
        for b in pairs:
            if a[o] == b[o] and a[k] != b[k]:
                near[a[k]].add(b[k])
    ids = {p[k] for p in pairs}
    got = {r["id"]: r["degree"] for r in projection.projection_degrees(e, side).collect()}
    assert got == {i: len(near[i]) for i in ids}
    xs = [(len(near[a]), len(near[b])) for a in near for b in near[a]]
    n = len(xs)
    mx = sum(x for x, _ in xs) / n
    cov, var = sum((x - mx) * (y - mx) for x, y in xs), sum((x - mx) ** 2 for x, _ in xs)
    assert projection.assortativity(e, side).first()["assortativity"] == pytest.approx(cov / var)


def test_common_coinvestors(inv, rows):
    at = 40.0 * 86400
    asked = inv.select("company", "investor").distinct()
    got = features.common_coinvestors(asked, inv, at, inclusive=True).collect()
    known = {(r[0], r[1]) for r in rows if r[2] <= at}
    of = defaultdict(set)
    for c, v in known:
        of[v].add(c)
    for x in got:
        others = {v for c, v in known if c == x["company"] and v != x["investor"]}
        assert x["common_coinvestors"] == sum(bool(of[v] & of[x["investor"]]) for v in others)


def test_category_overlap(spark, inv, rows):
    cats = {c: {f"k{c % 3}", f"k{c % 5}", f"x{c}"} for c in range(30)}
    table = spark.createDataFrame([(c, sorted(s)) for c, s in cats.items()], "company int, categories array<string>")
    for x in features.category_overlap(inv.select("company", "investor", "ts", "idx"), inv, table).collect():
        past = set().union(*[cats[r[0]] for r in rows if r[1] == x["investor"] and r[2] < x["ts"]] or [set()])
        own = cats[x["company"]]
        assert x["category_overlap"] == pytest.approx(len(past & own) / len(past | own) if past else 0.0)


def test_edge_rounds_are_complete_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS_PER_ROW", 10)
    rows = [(1, 1, float(i), i) for i in range(95)] + [(2, 2, 1.0, 1000)]
    inv = spark.createDataFrame(rows, "company int, investor int, ts double, round_id int")
    got = graph.edge_rounds(inv, ["ts", "round_id"]).collect()
    assert max(len(r["rounds"]) for r in got) < 40
    assert sorted((r["company"], x["round_id"]) for r in got for x in r["rounds"]) == sorted((r[0], r[3]) for r in rows)


def test_edge_rounds_continue_in_time_order(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS_PER_ROW", 10)
    sizes = {(1, 1): 95, (1, 2): 10, (2, 2): 11, (3, 1): 1}
    rows = [(c, v, float(i * 7 % n // 2), i) for (c, v), n in sizes.items() for i in range(n)]
    inv = spark.createDataFrame(rows, "company int, investor int, ts double, round_id int")
    got = {(r["company"], r["investor"], r["chunk"]): [tuple(x) for x in r["rounds"]] for r in graph.edge_rounds(inv, ["ts", "round_id"]).collect()}
    want = {}
    for pair, n in sizes.items():
        mine = sorted(r[2:] for r in rows if r[:2] == pair)
        want |= {(*pair, at // 10): mine[at : at + 10] for at in range(0, n, 10)}
    assert got == want


def test_splits_partition_the_input(inv, rows):
    counts = Counter(r["split"] for r in splits.quantile_split(inv).collect())
    ts = sorted(r[2] for r in rows)
    at = lambda q: ts[int(q * 599)] + (ts[min(int(q * 599) + 1, 599)] - ts[int(q * 599)]) * (q * 599 - int(q * 599))
    assert counts["train"] == sum(t <= at(0.7) for t in ts)
    assert sum(counts.values()) == len(rows)


def test_inductive_nodes_never_train(inv):
    held = splits.inductive_nodes(inv)
    train = splits.inductive_split(inv).filter("split = 'train'")
    seen = graph.nodes_of(train)
    assert held.join(seen, ["side", "id"]).isEmpty()
    assert held.count() == int(0.1 * graph.nodes_of(inv).count())


def test_early_stop(spark):
    series = [("a", i, v) for i, v in enumerate([0.5, 0.6, 0.6, 0.59, 0.58, 0.9])] + [("b", i, v) for i, v in enumerate([0.1, 0.2, 0.3])]
    got = {r["run"]: r for r in reports.early_stop(spark.createDataFrame(series, "run string, epoch int, v double"), "run", "epoch", "v").collect()}
    assert (got["a"]["best_epoch"], got["a"]["stop_epoch"]) == (1, 4)
    assert (got["b"]["best_epoch"], got["b"]["stop_epoch"]) == (2, None)


def _deliver(spark, path, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_events_are_routed(spark, tmp_path):
    schema = "idx long, id long, ts double"
    stream = _deliver(spark, f"{tmp_path}/in", [[(0, 1, 10.0), (1, 2, 5.0)], [(2, 1, 9.0), (3, 2, 6.0)], [(4, 1, 10.0), (5, 2, 1.0)]], schema)
    ok, late = streams.split_late(stream)
    assert sorted(r["idx"] for r in ok.collect()) == [0, 1, 3, 4]
    assert sorted(r["idx"] for r in late.collect()) == [2, 5]


def _append(spark, path, batch, schema):
    spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_without_key_or_time_are_accepted(spark, tmp_path):
    schema = "idx long, id long, ts double, note string"
    stream = _deliver(spark, f"{tmp_path}/in", [[(0, None, 10.0, "a"), (1, 2, 5.0, None)], [(2, None, 1.0, "b"), (3, 2, None, "c"), (4, 2, 4.0, "d")]], schema)
    ok, late = streams.split_late(stream)
    assert sorted(ok.collect(), key=lambda r: r.idx) == [(0, None, 10.0, "a"), (1, 2, 5.0, None), (2, None, 1.0, "b"), (3, 2, None, "c")]
    assert late.collect() == [(4, 2, 4.0, "d")]


def test_state_store_can_be_read_after_each_batch(spark, tmp_path):
    stream = _deliver(spark, f"{tmp_path}/in", [[(1,), (1,)], [(2,)], [(1,)]], "id long")
    counts = streams.node_counts(stream, f"{tmp_path}/state")
    assert {r["id"]: r["n"] for r in counts.collect()} == {1: 3, 2: 1}
    for batch, want in ((0, {1: 2}), (1, {1: 2, 2: 1}), (2, {1: 3, 2: 1})):
        rows = stateful.state_of(spark, f"{tmp_path}/state", batch).select("key.id", F.col("value.count").alias("n")).collect()
        assert {r["id"]: r["n"] for r in rows} == want


def test_node_state_goes_on_after_a_restart(spark, tmp_path):
    """Two runs over one folder give what one pass in plain Python gives, in whatever order times come."""
    schema = "id long, ts double, value double"
    rng = random.Random(5)
    batches = [[(rng.randrange(4), rng.uniform(0, 100), rng.choice([None, rng.uniform(-2, 2)])) for _ in range(40)] for _ in range(3)]
    batches[1] += [(None, 1.0, 1.0), (1, None, 1.0)]
    src, folder = f"{tmp_path}/in", f"{tmp_path}/state"
    streams.node_state(_deliver(spark, src, batches[:2], schema), 20.0, folder=folder)
    _append(spark, src, batches[2], schema)
    got = {r["id"]: r for r in streams.node_state(_deliver(spark, src, [], schema), 20.0, folder=folder).collect()}
    rows = [r for b in batches for r in b if r[0] is not None and r[1] is not None]
    assert set(got) == {r[0] for r in rows}
    for i, r in got.items():
        mine = [x for x in rows if x[0] == i]
        end = max(x[1] for x in mine)
        assert (r["n"], r["last_ts"]) == (len(mine), end)
        assert r["state"] == pytest.approx(sum((x[2] or 0.0) * 0.5 ** ((end - x[1]) / 20.0) for x in mine), abs=1e-9)


def test_latest_neighbors_go_on_after_a_restart(spark, tmp_path):
    schema = "id long, idx long, ts double, kind string"
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, float(rng.randrange(30)), rng.choice([None, "a", "b"])) for i in range(150)]
    src, folder = f"{tmp_path}/in", f"{tmp_path}/state"
    last = lambda batches: streams.latest_neighbors(_deliver(spark, src, batches, schema), 4, schema, ["id"], ["ts", "idx"], folder)
    last([rows[:50], rows[50:60]])
    _append(spark, src, rows[60:], schema)
    want = [r for i in (1, 2, 3) for r in sorted((r for r in rows if r[0] == i), key=lambda r: (r[2], r[1]))[-4:]]
    assert sorted(tuple(r) for r in last([]).collect()) == sorted(want)


def test_order_monitor_against_a_plain_pass(spark, tmp_path):
    schema = "idx long, id long, ts double"
    rng = random.Random(7)
    rows = [(i, rng.randrange(3), float(rng.randrange(12))) for i in range(90)]
    shuffled = [rng.sample(rows[a : a + 30], 30) for a in (0, 30, 60)]
    src, folder = f"{tmp_path}/in", f"{tmp_path}/state"
    streams.order_monitor(_deliver(spark, src, shuffled[:1], schema), folder=folder)
    for b in shuffled[1:]:
        _append(spark, src, b, schema)
    got = {r["id"]: r for r in streams.order_monitor(_deliver(spark, src, [], schema), folder=folder).collect()}
    for i in range(3):
        ts = [r[2] for r in rows if r[1] == i]
        back = sum(t < max(ts[:j]) for j, t in enumerate(ts) if j)
        repeats = sum(len(part) - len(set(part)) for part in ([r[2] for r in rows[a : a + 30] if r[1] == i] for a in (0, 30, 60)))
        assert (got[i]["n"], got[i]["last_ts"], got[i]["goes_back"], got[i]["repeats"]) == (len(ts), max(ts), back, repeats)


def test_alerts_follow_each_refresh(spark, tmp_path):
    """The score is a company's share of all money; alerts are its relative moves between prefixes of the deliveries."""
    schema = "company long, investor long, raised double, ts double"
    batches = [[(1, 7, 10.0, 1.0), (2, 7, 10.0, 1.0)], [(1, 8, 60.0, 2.0)], [(1, 7, 1.0, 3.0), (3, 9, 1.0, 3.0)]]

    def rank(edges):
        total = edges.agg(F.sum("total_raised")).scalar()
        return edges.groupBy(F.col("company").alias("id")).agg(F.sum("total_raised").alias("raised")).select("id", (F.col("raised") / total).alias("score"))

    got = streams.delta_alerts(_deliver(spark, f"{tmp_path}/in", batches, schema), rank, 0.2).collect()
    assert sorted((r.batch, r.id, round(r.delta, 6)) for r in got if r.batch > 0) == [(1, 1, 0.75), (1, 2, -0.75)]


def test_streams_without_rows(spark, tmp_path):
    schema = "idx long, id long, ts double, value double"
    empty = lambda: _deliver(spark, f"{tmp_path}/in", [[]], schema)
    assert streams.node_state(empty(), 5.0).count() == 0
    assert streams.order_monitor(empty()).count() == 0
    assert [t.count() for t in streams.split_late(empty())] == [0, 0]
    assert streams.latest_neighbors(empty(), 2, schema, ["id"], ["ts", "idx"]).count() == 0


def test_checkpoint_folder_of_the_session_is_used(spark):
    from biparta.session import durable_root

    root = durable_root(spark)
    assert durable_root(spark) == root


def test_only_one_process_may_use_its_own_folder():
    from biparta.session import is_local

    assert is_local("local") and is_local("local[8]") and is_local("local[*]")
    assert not any(is_local(m) for m in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://x"))


def test_metric_logs_keep_their_first_line(spark, tmp_path):
    from biparta.sources import readers

    for run, text in (("one", "AP: 0.5\nnoise\nMRR = 3\n"), ("two", "AP: 0.1\nAP: 0.2\n"), ("three", "noise\n")):
        (tmp_path / f"run={run}").mkdir()
        (tmp_path / f"run={run}" / "log.txt").write_text(text)
    got = readers.scan_metric_logs(spark, str(tmp_path), {"ap": r"AP: ([0-9.]+)", "mrr": r"MRR = ([0-9]+)"}, r"run=([^/]+)/").collect()
    assert {r.run: (r.ap, r.mrr) for r in got} == {"one": (0.5, 3.0), "two": (0.2, None), "three": (None, None)}


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_moves_in_ranges(spark, ranges):
    """Places taken range by range equal places in the whole order, where ranges overlap too."""
    import numpy as np

    from biparta.operators.block_ranking import moves

    rng = np.random.default_rng(11)
    data, want = [], {}
    for run, noise in ((0, 0.0), (1, 0.02), (2, 5.0)):
        for side in ("company", "investor"):
            x = rng.integers(0, 60, 80).astype(float)[:, None] + noise * rng.random((80, 5))
            data += [(run, side, i, row.tolist()) for i, row in enumerate(x)]
            place = np.argsort(np.array([sorted(range(80), key=lambda i, j=j: (x[i, j], i)) for j in range(5)]), axis=1)
            want[run, side] = [0, *(place[1:] != place[:-1]).sum(axis=1).tolist()]
    rows = spark.createDataFrame(data, "run int, side string, id bigint, xs array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        sizes, found = moves(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == want and set(sizes.values()) == {80}


def test_block_scores_equal_single_runs(spark, monkeypatch):
    """Weights, bundles and flushed partial sums, against one ranking per run."""
    from biparta.operators import block_ranking

    monkeypatch.setattr(block_ranking, "BUNDLE", 3)
    monkeypatch.setattr(block_ranking, "HELD_BYTES", 1)
    data = [(c, 100 + v, 1.0 + (c * v) % 5) for c in range(40) for v in range(9) if (c + v) % 3 or v == 0]
    df = spark.createDataFrame(data, "company bigint, investor bigint, w double")
    runs = [(0.3, -5.0), (0.8, -0.6), (1.0, 0.0)]
    got = {(r.run, r.side, r.id): r.score for r in block_ranking.block_scores(df, *zip(*runs, strict=True), iterations=3, weight="w")[0].collect()}
    want = {(i, r.side, r.id): r.score for i, (a, b) in enumerate(runs) for r in ranking.fixed_scores(df, 3, a, b, "w").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    empty = block_ranking.block_scores(df.limit(0), [0.3], [-5.0])
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_timed_groups(spark):
    """One positive and four distinct companies per group, at its own time, none funded by then."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(30), rng.choice([100, 100, 101, 102]), float(rng.randrange(50))) for i in range(80)]
    x = spark.createDataFrame(rows, "idx bigint, company bigint, investor bigint, ts double")
    later = x.filter("ts >= 25")
    got = features.timed_groups(later, negatives.plausible_negatives(later, x, 4)).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.idx].append(r)
    assert set(groups) == {r[0] for r in rows if r[3] >= 25}
    for i, group in groups.items():
        _, company, investor, ts = rows[i]
        assert {(r.investor, r.ts) for r in group} == {(investor, ts)} and [r.company for r in group if r.label] == [company]
        known = {c for _, c, v, t in rows if v == investor and t <= ts}
        mine = [r.company for r in group if not r.label]
        pool = {c for _, c, _, _ in rows} - known - {company}
        assert len(mine) == len(set(mine)) == min(4, len(pool)) and not set(mine) & (known | {company})


def test_recent_lists_of_a_hot_node_are_cut_into_buckets(spark):
    # company 1 has 60 of 70 events, two at each time; its rows are cut into buckets, and lists reach over several of them
    rows = [(1, 100 + i, float(i // 2), i) for i in range(60)] + [(c, 100, float(c), 60 + c) for c in range(2, 12)]
    inv = spark.createDataFrame(rows, "company int, investor int, ts double, idx int")
    adj = neighbors.temporal_adjacency(inv)
    queries = adj.select("side", "id", "ts", "idx").unionByName(adj.select("side", F.lit(None).cast("int").alias("id"), "ts", "idx").limit(1))
    for inclusive in (False, True):
        index = neighbors.NeighborIndex(adj, hot_rows=5)
        got = index.recent_lists(queries, 7, inclusive, without_history=True).collect()
        assert len(got) == 141
        for x in got:
            k = 0 if x["side"] == "company" else 1
            past = sorted(((r[2], r[3]) for r in rows if r[k] == x["id"] and (r[2] <= x["ts"] if inclusive else r[2] < x["ts"])), reverse=True)[:7]
            assert [(n["neighbor_ts"], n["neighbor_idx"]) for n in x["near"]] == past


def test_lists_are_pooled_without_a_shuffle_after_the_stream(inv):
    adj = neighbors.temporal_adjacency(inv, "raised")
    queries = adj.select("side", "id", "ts", "idx", F.array(F.lit(0.5), F.lit(1.5)).alias("q"))
    lists = neighbors.NeighborIndex(adj).recent_lists(queries, 3, without_history=True)
    vecs = F.transform("near", lambda x: F.array(x.raised.cast("double") / 100, x.neighbor_ts / 100))
    pooled = neighbors.attended(lists, F.col("q"), vecs, vecs, 2).withColumn("total", neighbors.summed(vecs, 2))
    assert pooled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(side") == 1
    key = ["side", "id", "idx"]
    flat = lists.select(*key, F.explode("near").alias("x")).select(*key, F.array(F.col("x.raised").cast("double") / 100, F.col("x.neighbor_ts") / 100).alias("v"))
    plain = neighbors.pool_attention(queries, flat, key, "q", "v", "v", 2).join(neighbors.pool_sum(flat, key, [F.col("v")], 2).withColumnRenamed("pooled", "total"), key, "left")
    want = {(x["side"], x["id"], x["idx"]): (x["pooled"], x["total"] or [0.0, 0.0]) for x in plain.collect()}
    got = {(x["side"], x["id"], x["idx"]): (x["pooled"], x["total"]) for x in pooled.collect()}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert got[k][0] == pytest.approx(a) and got[k][1] == pytest.approx(b)


def test_draw_totals_are_those_of_the_listed_draws(spark):
    pool = spark.createDataFrame([(7, 0), (None, 1), (9, 2)], "investor int, place bigint")
    asked = spark.range(20).select(F.col("id").alias("idx"))
    drawn = negatives.random_negatives(asked, pool, "investor", 6, 3)
    want = drawn.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.sum("negative").alias("total"), F.count_distinct("negative").alias("distinct_n"))
    totals = negatives.draw_totals(asked, pool, "investor", 6, 3)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, want.select(totals.columns).collect()))
    # draws meet the pool where they are made
    for made in (drawn, totals):
        assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_positive_ranks_with_a_known_best(spark):
    rows = [(1, 1.0, 0.5), (1, 0.0, 0.7), (1, 0.0, 0.5), (2, 1.0, 0.9), (2, 0.0, 0.1), (3, 1.0, 0.2)]
    scored = spark.createDataFrame(rows, "g int, label double, score double").withColumn("best", F.element_at(F.create_map(*map(F.lit, [1, 0.5, 2, 0.9, 3, 0.2])), F.col("g")))
    known, plain = metrics.positive_ranks(scored, ["g"], best="best"), metrics.positive_ranks(scored, ["g"])
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, plain.collect())) == [(1, 2), (2, 1), (3, 1)]
    # the candidates are not joined with their best positive
    assert "Join" not in known._jdf.queryExecution().executedPlan().toString()
