import random

import pytest

from marketgrid.operators import graph


def union_find(edges):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for n in list(parent):
        groups.setdefault(root(n), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rnd = random.Random(9)
    if kind == "chain":
        names = [f"n{i:03d}" for i in range(90)]
        rnd.shuffle(names)
        edges = list(zip(names, names[1:])) + [("z1", "z1")]
    elif kind == "star":
        edges = [("m", f"x{i}") for i in range(60)] + [("a", "b")]
    else:
        edges = [(f"c{rnd.randint(0, 60)}", f"p{rnd.randint(0, 60)}") for _ in range(45)]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == union_find(edges)


OVERLAPS = [
    ("c1", "p1", 100.0),                                   # unchanged
    ("c2", "p2", 60.0), ("c3", "p2", 40.0),                # split in two
    ("c4", "p3", 10.0), ("c4", "p4", 20.0),                # merged
    ("c5", "p5", 100.0),                                   # suppressed parent
    ("c6", "p1", 0.2),                                     # sliver only
    ("c7", "p1", 0.0),                                     # water only
]
OLD = [("p1", 1000.0), ("p2", 500.0), ("p3", 100.0), ("p4", 300.0), ("p5", -666666666.0)]


def test_apportionment_and_growth_ladder(spark):
    rel = spark.createDataFrame(OVERLAPS, "child string, parent string, land_part double")
    old = spark.createDataFrame(OLD, "parent string, households_old double")
    weights = graph.land_weights(rel)
    base = {r.tract_geoid: r for r in graph.apportion(weights, old).collect()}
    assert "c7" not in base
    assert base["c1"].growth_basis == "direct" and base["c4"].growth_basis == "direct"
    assert base["c2"].growth_basis == base["c6"].growth_basis == "fragmentary"
    assert base["c5"].growth_basis == "parent_suppressed" and base["c5"].households_2019 is None
    assert base["c4"].households_2019 == pytest.approx(400)
    # nothing is lost: children add up to the parents with data
    assert sum(r.households_2019 for r in base.values() if r.households_2019) == pytest.approx(1900)

    tracts = spark.createDataFrame(
        [("c1", 1100.0, "ok"), ("c2", 330.0, "ok"), ("c3", 275.0, "ok"), ("c4", None, "suppressed"), ("c5", 10.0, "ok"),
         ("c6", 50.0, "ok"), ("c8", 5.0, "ok"), ("c9", 0.0, "unpopulated")],
        "tract_geoid string, households double, tract_status string")
    out = {r.tract_geoid: r for r in graph.tract_growth(tracts, rel, old).collect()}
    assert out["c1"].growth_basis == "direct"
    assert out["c2"].growth_basis == out["c3"].growth_basis == "cluster"
    assert out["c2"].household_growth_pct == pytest.approx(((605 / 500) ** 0.2 - 1) * 100, abs=1e-4)
    assert out["c2"].household_growth_pct_tract == pytest.approx(((330 / 300) ** 0.2 - 1) * 100, abs=1e-4)
    assert out["c4"].growth_basis == "no_2019_base" and out["c4"].household_growth_pct is None
    assert out["c5"].growth_basis == "parent_suppressed"
    assert out["c6"].growth_basis == "fragmentary_no_cluster" and out["c6"].growth_cluster is None
    assert out["c8"].growth_basis == "no_2010_counterpart"
    assert out["c9"].growth_basis == "not_applicable" and out["c9"].household_growth_pct is None
