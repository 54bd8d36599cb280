"""Hand-computed values."""

import pytest
from pyspark.sql import functions as F

from biparta.operators import block_ranking, diagnostics, losses, metrics, ranking
from biparta.operators.ordering import exact_quantiles

EDGES = [("A", "x"), ("A", "y"), ("B", "y"), ("B", "z"), ("C", "z")]
GOLDEN = {
    (0.3, -5.0, 1): {"A": 0.562461, "B": 0.826648, "C": 0.017044, "x": 0.371722, "y": 0.638759, "z": 0.673654},
    (0.3, -5.0, 2): {"A": 0.579139, "B": 0.815049, "C": 0.017107, "x": 0.364676, "y": 0.781859, "z": 0.505677},
    (0.3, -5.0, 3): {"A": 0.650844, "B": 0.759097, "C": 0.013199, "x": 0.374681, "y": 0.782142, "z": 0.497863},
    (0.8, -0.6, 1): {"A": 0.649089, "B": 0.715620, "C": 0.258014, "x": 0.433054, "y": 0.589613, "z": 0.681778},
    (0.8, -0.6, 3): {"A": 0.706031, "B": 0.664980, "C": 0.243561, "x": 0.465787, "y": 0.622954, "z": 0.628467},
}


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(EDGES, "company string, investor string")


@pytest.mark.parametrize("key", list(GOLDEN))
def test_ranking_vectors(small, key):
    alpha, beta, n = key
    got = {r["id"]: round(r["score"], 6) for r in ranking.fixed_scores(small, n, alpha, beta).collect()}
    assert got == pytest.approx(GOLDEN[key], abs=1e-6)


def test_zero_order(small):
    got = {r["id"]: r["score"] for r in ranking.RankGraph(small).zero_order().collect()}
    assert got == pytest.approx({"A": 2 / 3, "B": 2 / 3, "C": 1 / 3, "x": 1 / 3, "y": 2 / 3, "z": 2 / 3})


def test_convergence_matches_plain_loop(small, spark):
    nodes = spark.createDataFrame([("company", "Q")], "side string, id string")
    scores, stops = ranking.converge(ranking.RankGraph(small), nodes, block=9)
    stop = {r["side"]: r["iterations"] for r in stops.collect()}
    comps, invs = ["A", "B", "C", "Q"], ["x", "y", "z"]
    f = {c: sum(1.0 for a, _ in EDGES if a == c) for c in comps}
    u = {v: sum(1.0 for _, b in EDGES if b == v) for v in invs}
    wf = {c: (f[c] or 1e-12) ** 5.0 for c in comps}
    wu = {v: u[v] ** -0.3 for v in invs}
    nv = {v: sum(wf[a] for a, b in EDGES if b == v) for v in invs}
    nc = {c: sum(wu[b] for a, b in EDGES if a == c) or 1e-12 for c in comps}
    place = lambda x: {k: i for i, (k, _) in enumerate(sorted(x.items(), key=lambda kv: (kv[1], kv[0])))}
    streak, before, found, final = {"company": 0, "investor": 0}, {}, {}, {}
    for i in range(1, 200):
        f, u = ({c: wf[c] * sum(u[b] / nv[b] for a, b in EDGES if a == c) for c in comps}, {v: wu[v] * sum(f[a] / nc[a] for a, b in EDGES if b == v) for v in invs})
        for side, x in (("company", f), ("investor", u)):
            p = place(x)
            moved = len(x) if i == 1 else sum(p[k] != before[side][k] for k in x)
            streak[side] = streak[side] + 1 if moved / len(x) < 0.01 else 0
            before[side] = p
            if streak[side] >= 20 and side not in found:
                found[side], final[side] = i, dict(x)
    assert stop == found
    got = {(r["side"], r["id"]): r["score"] for r in scores.collect()}
    for side, x in final.items():
        norm = sum(v * v for v in x.values()) ** 0.5
        for k, v in x.items():
            assert got[(side, k)] == pytest.approx(v / norm, abs=1e-9)


def test_positive_ranks(spark):
    groups = {1: (0.78, [0.65, 0.23, 0.19]), 2: (0.35, [0.78, 0.65, 0.52]), 3: (0.05, [0.95, 0.505, 0.06])}
    rows = [(g, p, 1.0) for g, (p, _) in groups.items()] + [(g, n, 0.0) for g, (_, ns) in groups.items() for n in ns]
    ranks = metrics.positive_ranks(spark.createDataFrame(rows, "g int, score double, label double"), ["g"])
    assert {r["g"]: r["rank"] for r in ranks.collect()} == {1: 1, 2: 4, 3: 4}
    m = metrics.mrr_recall(ranks, [1, 3, 10]).first()
    assert (m["mrr"], m["recall_1"], m["recall_3"], m["recall_10"]) == pytest.approx((0.5, 1 / 3, 1 / 3, 1.0))


@pytest.mark.parametrize(("ps", "bce", "focal"), [([0.95, 0.05, 0.98, 0.02], 0.035748, 3.408e-05), ([0.55, 0.45, 0.58, 0.42], 0.571282, 0.05428797)])
def test_losses(spark, ps, bce, focal):
    rows = spark.createDataFrame([(p, float(1 - i % 2)) for i, p in enumerate(ps)], "p double, label double")
    assert losses.bce_loss(rows).first()[0] == pytest.approx(bce, abs=1e-6)
    assert losses.focal_loss(rows, alpha=0.5).first()[0] == pytest.approx(focal, rel=1e-3)
    # half of the rows are positive, so the adaptive alpha is 0.5
    assert losses.adaptive_focal_loss(rows).first()["adaptive_focal"] == pytest.approx(focal, rel=1e-3)


def test_contrastive(spark):
    row = spark.createDataFrame([(0.1, 0.0, 4, 9, 1)], "pos_score double, neg_score double, src_degree int, pos_degree int, neg_degree int")
    assert losses.contrastive_loss(row).first()[0] == pytest.approx(0.07160997, abs=1e-7)


def test_moments_gini_quantiles(spark):
    v = spark.createDataFrame([(1,), (2,), (3,), (10,), (50,)], "v int")
    m = v.agg(*diagnostics.moments(F.col("v"))).first()
    assert (m["skewness"], m["kurtosis"], m["std"]) == pytest.approx((1.399034, 0.099384, 18.669762), abs=1e-6)
    assert exact_quantiles(v, "v", [0.7]).first()[0] == pytest.approx(8.6)
    deg = spark.createDataFrame([(1,), (1,), (2,), (6,)], "d int")
    assert diagnostics.gini(deg, "d").first()[0] == pytest.approx(0.4)


def test_quality_of_ties(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    q = metrics.ranking_quality(rows).first()
    assert q["auroc"] == pytest.approx(0.875)
    assert q["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_p_value():
    # the normal tail of the fit agrees with erfc
    from math import erfc, sqrt

    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    for t in (0.1, 1.0, 2.5):
        got = s.range(1).select(metrics.normal_p_value(F.lit(t)).alias("p")).first()["p"]
        assert got == pytest.approx(erfc(t / sqrt(2)), abs=2e-7)


def plain_scores(edges, alpha, beta):
    """Company and investor scores at the stop of each side, by a plain loop."""
    comps, invs = sorted({a for a, _ in edges}), sorted({b for _, b in edges})
    f = {c: float(sum(a == c for a, _ in edges)) for c in comps}
    u = {v: float(sum(b == v for _, b in edges)) for v in invs}
    wf, wu = {c: f[c] ** -beta for c in comps}, {v: u[v] ** -alpha for v in invs}
    nv = {v: sum(wf[a] for a, b in edges if b == v) for v in invs}
    nc = {c: sum(wu[b] for a, b in edges if a == c) for c in comps}
    streak, before, final = {"company": 0, "investor": 0}, {}, {}
    while len(final) < 2:
        f, u = ({c: wf[c] * sum(u[b] / nv[b] for a, b in edges if a == c) for c in comps}, {v: wu[v] * sum(f[a] / nc[a] for a, b in edges if b == v) for v in invs})
        for side, x in (("company", f), ("investor", u)):
            p = sorted(x, key=lambda k: (float(f"{x[k]:.11e}"), k))
            streak[side] = streak[side] + 1 if before.get(side) == p else 0
            before[side] = p
            if streak[side] >= 20 and side not in final:
                norm = sum(v * v for v in x.values()) ** 0.5
                final[side] = {k: v / norm for k, v in x.items()}
    return final


DENSE = [(c, 10 + v, (37 * c + 61 * v) % 97 / 97) for c in range(7) for v in range(6) if (c * v + c) % 4 != 3]


def test_parameter_sweep_until_stable(spark):
    df = spark.createDataFrame(DENSE, "company int, investor int, p double")
    grid = [(0.3, -5.0), (0.8, -0.6)]
    want = {(i, s, k): x for i, g in enumerate(grid) for s, side in plain_scores([e[:2] for e in DENSE], *g).items() for k, x in side.items()}
    got = {(r.param_id, r.side, r.id): r.score for r in block_ranking.parameter_sweep(df, grid).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_threshold_sweep_until_stable(spark):
    df = spark.createDataFrame(DENSE, "company int, investor int, p double")
    cuts = [0.0, 0.2]
    want = {(i, s, k): x for i, t in enumerate(cuts) for s, side in plain_scores([e[:2] for e in DENSE if e[2] >= t], 0.3, -5.0).items() for k, x in side.items()}
    got = {(r.param_id, r.side, r.id): r.score for r in block_ranking.threshold_sweep(df, cuts).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_uncertainty_of_blocks_until_stable(spark):
    import statistics

    from biparta.operators import montecarlo, negatives

    df = spark.createDataFrame(DENSE, "company int, investor int, p double")
    runs = {}
    for r in negatives.bernoulli_edges(df, 3, 3).collect():
        assert r.n_samples == r.in_samples.count("1") and len(r.in_samples) == 3
        for i in range(3):
            if r.in_samples[i] == "1":
                runs.setdefault(i, []).append((r.company, r.investor))
    plain = [plain_scores(runs[i], 0.3, -5.0)["company"] for i in range(3)]
    got = {r.id: r for r in montecarlo.uncertainty(df, 3, None, 2, seed=3).collect()}
    assert sorted(got) == sorted({e[0] for e in DENSE})
    tops = [sorted(got, key=lambda k: (-round(s.get(k, 0.0), 9), k))[:2] for s in plain]
    for k, r in got.items():
        values = [s.get(k, 0.0) for s in plain]
        assert (r.mean_score, r.std_score) == pytest.approx((statistics.fmean(values), statistics.pstdev(values)), abs=1e-9)
        assert r.p_top == pytest.approx(sum(k in t for t in tops) / 3)


def test_forest_is_scored_on_later_rows(spark, sf, monkeypatch):
    from biparta.operators import features, scoring
    from biparta.plans import inputs, learning

    seen = {}
    monkeypatch.setattr(features, "pair_features", lambda pairs, events, cats, at: pairs.select("*", F.lit(at).alias("at"), *[F.lit(0.0).alias(f) for f in features.FEATURES]))
    monkeypatch.setattr(scoring, "fit_forest", lambda rows, names, **k: seen.update(rows=rows, trees=k.get("trees", 200)) or (lambda *c: c[0]))
    late = learning.m7(spark, sf)
    first = inputs.interactions(spark, sf).select("company", "investor", F.col("ts").alias("met"))
    fitted = seen["rows"].filter("label = 1").join(first, ["company", "investor"]).agg(F.min("met"), F.max("met"), F.max("at"), F.count(F.lit(1))).first()
    scored = late.filter("label = 1").join(first, ["company", "investor"]).agg(F.min("met"), F.count(F.lit(1))).first()
    assert seen["trees"] == 200 and fitted[3] > 0 and scored[1] > 0
    assert fitted[2] <= fitted[0] and fitted[1] < learning.AT <= scored[0]
