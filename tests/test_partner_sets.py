import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from biparta.operators import features, negatives, projection
from biparta.operators.partner_sets import BITS, MAP_BYTES, partner_sets


def test_containers_cost_what_they_hold(spark):
    rows = spark.createDataFrame([(1, 5), (1, 70_000), (2, 3), (2, 4)], "o long, bit long").unionByName(spark.range(BITS).select(F.lit(3).alias("o"), F.col("id").alias("bit")))
    got = {(r["o"], r["bucket"]): len(r["items"]) for r in partner_sets(rows, "o").collect() if r["o"] < 3}
    assert got == {(1, 0): 2, (1, 2): 2, (2, 0): 4}
    assert all(len(r["items"]) <= MAP_BYTES for r in partner_sets(rows, "o").collect())


@pytest.mark.parametrize("batch", [100])
def test_hub_and_leaves(spark, batch):
    """A hub whose set is a bitmap next to nodes with few partners, groups cut by small batches."""
    rnd = random.Random(1)
    pairs = {(c, 0) for c in range(2500)} | {(rnd.randrange(2600), rnd.randrange(1, 40)) for _ in range(300)}
    e = spark.createDataFrame([(f"c{c}", v) for c, v in sorted(pairs)], "company string, investor long")
    of, members = {}, {}
    for c, v in pairs:
        of.setdefault(c, set()).add(v)
        members.setdefault(v, set()).add(c)
    reach = {c: set().union(*(members[v] for v in of[c])) - {c} for c in of}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["id"]: r["degree"] for r in projection.projection_degrees(e, "company").collect()}
        assert got == {f"c{c}": len(r) for c, r in reach.items()}
        size = {c: len(r) for c, r in reach.items()}
        x = [(size[a], size[b]) for a in reach for b in reach[a]]
        mean = sum(a for a, _ in x) / len(x)
        want = sum((a - mean) * (b - mean) for a, b in x) / sum((a - mean) ** 2 for a, _ in x)
        assert projection.assortativity(e, "company").first()["assortativity"] == pytest.approx(want)
        asked = spark.createDataFrame([(f"c{rnd.randrange(2600)}", rnd.randrange(41)) for _ in range(50)] + [("c1", 0), ("none", 0)], "company string, investor long")
        flipped = {v: set().union(*(of[c] for c in m)) - {v} for v, m in members.items()}
        found = features.common_coinvestors(asked, e.withColumn("ts", F.lit(0.0))).collect()
        assert len(found) == 52
        for r in found:
            mine = of.get(int(r["company"][1:]), set()) if r["company"] != "none" else set()
            assert r["common_coinvestors"] == len((mine - {r["investor"]}) & flipped.get(r["investor"], set()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hard_negatives_in_many_parts(spark, monkeypatch):
    """Queries in several parts, destinations in several blocks: the same rows as all at once."""
    rnd = random.Random(3)
    emb = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(30)], "id long, vec array<double>")
    queries = spark.createDataFrame([(i, i % 3, rnd.randrange(30)) for i in range(40)], "idx long, who long, positive long")
    known = queries.select("who", F.col("positive").alias("negative"))
    for top_k in (None, 6):
        whole = sorted(negatives.hard_negatives(queries, emb, 4, known, "who", top_k=top_k).collect())
        monkeypatch.setattr(negatives, "QUERIES", 7)
        assert sorted(negatives.hard_negatives(queries, emb, 4, known, "who", top_k=top_k, block=4).collect()) == whole
        monkeypatch.undo()


def test_kept_columns_of_equal_values():
    merit = np.array([[1.0, 3.0, 1.0, 1.0, 2.0], [-np.inf, 5.0, -np.inf, 5.0, 5.0]])
    assert negatives._kept(merit, 3).tolist() == [[0, 1, 4], [1, 3, 4]]
