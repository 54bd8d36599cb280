"""Draws of many texts at once are those of the column function."""

import random
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from biparta.functions import digests
from biparta.functions.hashing import draw_int, gumbel
from biparta.operators import negatives


def test_draws_of_all_sizes(monkeypatch):
    monkeypatch.setattr(digests, "TEXTS", 64)
    rnd = random.Random(1)
    heads = [rnd.randbytes(rnd.randrange(30)) for _ in range(40)]
    tails = [rnd.randbytes(rnd.randrange(40)) for _ in range(50)]
    want = [[int(md5(h + t).hexdigest()[:15], 16) for t in tails] for h in heads]
    assert digests.draws(heads, tails).tolist() == want
    assert digests.draws([], tails).shape == (0, 50) and digests.draws(heads, []).shape == (40, 0)


def test_sampled_edges_are_drawn_together(spark, monkeypatch):
    """Five samples of each edge, more edges than are held at once, and none of them hashed on its own."""
    monkeypatch.setattr(negatives, "DRAWN_EDGES", 7)
    assert not hasattr(negatives, "md5")
    edges = spark.createDataFrame([(c, v, None if c == 3 else (c * v % 10) / 10) for c in range(6) for v in range(5)], "company long, investor long, p double")
    got = {(r["company"], r["investor"]): r for r in negatives.bernoulli_edges(edges, 5, 9).collect()}
    bits = edges.select("company", "investor", *[((draw_int(9, F.lit(i), "company", "investor") / 2.0**60) < F.coalesce("p", F.lit(0.0))).cast("int").alias(f"b{i}") for i in range(5)])
    for r in bits.collect():
        row = got[r["company"], r["investor"]]
        want = [r[f"b{i}"] for i in range(5)]
        assert row["in_samples"] == "".join(map(str, want)) and row["n_samples"] == sum(want)


def test_noise_left_out_changes_nothing(spark):
    """The best by similarity and noise in several blocks are those of all noise."""
    rnd = np.random.default_rng(2)
    emb = [(i, [float(x) for x in rnd.normal(size=3)]) for i in range(60)]
    vectors = spark.createDataFrame(emb, "id long, vec array<double>")
    asked = spark.createDataFrame([(i, i % 4, i % 60) for i in range(30)], "idx long, who long, positive long")
    known = asked.select("who", F.col("positive").alias("negative"))
    got = negatives.hard_negatives(asked, vectors, 6, known, "who", ratio=0.5, temperature=0.5, seed=3, block=8).filter("kind = 'hard'")
    drawn = {(r["idx"], r["id"]): r["g"] for r in asked.select("idx").crossJoin(vectors.select("id")).select("idx", "id", gumbel(3, "idx", "id").alias("g")).collect()}
    taken = {w: {i % 60 for i in range(30) if i % 4 == w} for w in range(4)}
    vec = {i: np.array(v) for i, v in emb}
    rows = {(r["idx"], r["slot"]): r["negative"] for r in got.collect()}
    for i in range(30):
        merit = sorted((-round(vec[i % 60] @ vec[j] / 0.5 + drawn[i, j], 9), j) for j in vec if j not in taken[i % 4])
        assert [rows[i, s] for s in range(3)] == [j for _, j in merit[:3]]
