"""Steps whose tables or tasks once grew faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from biparta.operators import block_ranking, graph, neighbors
from biparta.operators.ranking import RankGraph
from biparta.plans import ranks


def _pairs(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(20), rng.randrange(15)) for _ in range(120)})
    return spark.createDataFrame([(c, v, rng.random(), float(1 + c % 3)) for c, v in rows], "company long, investor long, p double, w double")


@pytest.mark.parametrize("weight", [None, "w"])
def test_few_runs_in_columns(spark, monkeypatch, weight):
    cuts = [0.1, 0.4, 0.8]
    digits = F.concat(*[F.when(F.col("p") >= t, "1").otherwise("0") for t in cuts])
    edges = _pairs(spark).withColumn("bits", block_ranking.bitset(digits, 3)).localCheckpoint()

    def scores(**kind):
        got, _ = block_ranking.block_scores(edges, [0.3, 0.8, 1.0], [-5.0, -0.6, 0.0], members="bits", weight=weight, **kind)
        return {(r["run"], r["side"], r["id"]): r["score"] for r in got.collect()}

    few = scores(iterations=3)
    assert not any(name == "partial" for name in called(monkeypatch, scores))
    monkeypatch.setattr(block_ranking, "NARROW", 0)
    assert few == pytest.approx(scores(iterations=3))


def called(monkeypatch, scores):
    names = []
    with monkeypatch.context() as m:
        m.setattr(block_ranking, "_partial_sums", lambda *a: names.append("partial"))
        scores(iterations=1)
    return names


def test_steps_are_done_once(spark, sf, monkeypatch):
    done = []
    real = RankGraph.step
    monkeypatch.setattr(RankGraph, "step", lambda self, x: done.append(1) or real(self, x))
    assert {r["side"] for r in ranks.w10(spark, sf).collect()} == {"company", "investor"}
    assert len(done) == 5


def test_steps_to_several_stops(spark):
    g = RankGraph(_pairs(spark))
    values = lambda df: {(r["side"], r["id"]): r["score"] for r in df.collect()}
    none, two, seven = g.run_to([0, 2, 7])
    assert [values(x) for x in (none, two, seven)] == [pytest.approx(values(x)) for x in (g.zero_order(), g.run(2), g.run(7))]


def test_round_technologies_spread(spark, monkeypatch):
    monkeypatch.setattr(graph, "EXPANDED_ROWS", 10)
    rounds = spark.createDataFrame([(c, r) for r in range(60) for c in (r % 7, (r + 3) % 7)], "company long, round_id long")
    technologies = spark.createDataFrame([(c, t) for c in range(7) for t in ("a", f"t{c}", f"t{c % 3}x")], "company long, technology string")
    got = graph.round_technologies(rounds, technologies)
    rows = [tuple(r) for r in got.collect()]
    want = {(r, t) for r in range(60) for c in (r % 7, (r + 3) % 7) for t in ("a", f"t{c}", f"t{c % 3}x")}
    assert len(rows) == len(want) and set(rows) == want
    # 120 rows before they are expanded
    assert got.rdd.getNumPartitions() >= 12


@pytest.mark.parametrize("inclusive", [False, True])
def test_uniform_draws_from_the_stream(spark, inclusive):
    rng = random.Random(2)
    events = [("company" if i % 3 else "investor", rng.choice([1, 1, 1, 2, 3]), rng.randrange(50), float(rng.randrange(30)), i) for i in range(200)]
    adj = spark.createDataFrame(events, "side string, id long, other long, ts double, idx long")
    asked = adj.select("side", "id", "ts", "idx").unionByName(adj.limit(3).select("side", "id", "ts", "idx"))
    values = lambda df: sorted(tuple(r) for r in df.select("side", "id", "ts", "idx", "slot", "neighbor", "neighbor_ts", "neighbor_idx").collect())
    index = neighbors.NeighborIndex(adj)
    got = values(index.uniform(asked, 4, 3, inclusive))
    # no table of places was needed
    assert "events" not in vars(index)
    assert got == values(index._by_place(asked, 4, 3, inclusive))
    # nodes with many rows are looked up by place, the rest comes from the stream
    assert got == values(neighbors.NeighborIndex(adj, hot_rows=40).uniform(asked, 4, 3, inclusive))
    assert len(got) >= 4 * 150
