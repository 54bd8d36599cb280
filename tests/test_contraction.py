"""Components by contraction: tables shrink from round to round, and two colours follow from parities."""

import random

import pytest

from biparta.operators import components


@pytest.fixture
def written(monkeypatch):
    rows = {}
    real = components.materialize

    def materialize(df, label="table"):
        out = real(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", materialize)
    return rows


def test_pairs_shrink(spark, written):
    pairs = [(a, 100 + b) for a in range(30) for b in range(30)]
    assert components.is_bipartite(spark.createDataFrame(pairs, "u int, v int")).first()[0]
    assert written["cc"][0] == len(pairs)
    assert sum(written["cc"][1:]) < len(pairs) / 2


def test_long_path_takes_few_rounds(spark, written):
    got = components.star_components(spark.createDataFrame([(i, i + 1) for i in range(400)], "u int, v int")).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 401
    assert len(written["cc"]) <= 14


@pytest.mark.parametrize("extra, want", [([], True), ([(3, 8)], True), ([(2, 6)], False)])
def test_cycles(spark, extra, want):
    ring = [(i, (i + 1) % 20) for i in range(20)]
    random.Random(1).shuffle(ring)
    pairs = [*ring, *((b, a) for a, b in ring), *extra, (50, 51)]
    assert components.is_bipartite(spark.createDataFrame(pairs, "u int, v int")).first()[0] is want


def test_labels_are_the_first_in_text_order(spark):
    edges = spark.createDataFrame([(9, 1), (10, 1), (2**62 + 5, 3), (-4, 4)], "company long, investor long")
    nodes = spark.createDataFrame([("company", 9), ("investor", 1), ("investor", 77), ("company", 2**62 + 5), ("company", -4)], "side string, id long")
    got = {(r["side"], r["id"]): r["component"] for r in components.components(edges, nodes).collect()}
    want = {("company", 9): "company:10", ("investor", 1): "company:10", ("investor", 77): "investor:77", ("company", 2**62 + 5): f"company:{2**62 + 5}", ("company", -4): "company:-4"}
    assert got == want
    small = components.components(edges.filter("company < 100")).collect()
    assert {(r["side"], r["id"], r["component"]) for r in small} == {
        ("company", 9, "company:10"), ("company", 10, "company:10"), ("investor", 1, "company:10"), ("company", -4, "company:-4"), ("investor", 4, "company:-4")
    }
