"""Steps of the ranking on packed cells, against steps by joins; the stop rule on equal neighbourhoods."""

import random

import numpy as np
import pytest

from biparta.operators import cell_steps, ranking

GRAPH = [(c, v, float(c % 3 + 1)) for c, v in {(x.randrange(40), x.randrange(30)) for x in [random.Random(7)] for _ in range(200)}]


@pytest.mark.parametrize(("weight", "text"), [(None, False), ("w", True)])
def test_cells_step_like_joins(spark, monkeypatch, weight, text):
    monkeypatch.setattr(cell_steps, "CHUNK", 7)
    monkeypatch.setattr(cell_steps, "PACKED_ARCS", 50)
    edges = spark.createDataFrame([(c, v, w) for c, v, w in [*GRAPH, (None, 3, 1.0), (5, None, 2.0)]], "company long, investor long, w double")
    if text:
        edges = edges.selectExpr("cast(company AS string) AS company", "concat('n', investor) AS investor", "w")
    graph = ranking.RankGraph(edges, weight=weight)
    cells = cell_steps.CellGraph(graph)
    x, y = graph.start(), cells.start()
    vectors = [(0, y)]
    for i in range(1, 4):
        x, y = graph.step(x), cells.step(y)
        vectors.append((i, y))
    want = {(r["side"], r["id"]): r["x"] for r in graph.decode(x).collect()}
    rows = cells.lists(vectors).collect()
    assert {(r["side"], r["id"]): r["xs"][3] for r in rows} == pytest.approx(want, rel=1e-9)
    start = {(r["side"], r["id"]): r["x"] for r in graph.decode(graph.start()).collect()}
    assert {(r["side"], r["id"]): r["xs"][0] for r in rows} == pytest.approx(start, rel=1e-9)
    cells.close()


def test_last_bits_do_not_part_equal_values(spark):
    # copies of a component have equal values but for the order of their sums; they changed place in every iteration
    cells = cell_steps.CellGraph(ranking.RankGraph(spark.createDataFrame([(c, v) for c, v, _ in GRAPH], "company long, investor long")))
    y = cells.start()
    noisy = [(r["chunk"], np.nextafter(np.frombuffer(r["x"]), np.inf).tobytes(), bytes(r["m"])) for r in y.collect()]
    z = spark.createDataFrame([(c, x, m) for c, x, m in noisy], y.schema)
    assert all(r["xs"][0] == r["xs"][1] for r in cells.lists([(0, y), (1, z)]).collect())


def test_own_partitions(spark):
    from pyspark.sql import functions as F

    found = cell_steps.own_partitions(spark, 16)
    got = spark.createDataFrame([(x,) for x in found], "id int").select(F.pmod(F.hash("id"), F.lit(16)).alias("p")).collect()
    assert [r["p"] for r in got] == list(range(16))
