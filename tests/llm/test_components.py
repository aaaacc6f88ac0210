"""Connected components against union-find, hubs included."""

import random

import pytest

from quillon.llm import common


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def star(hub, leaves):
    return [(hub, x) for x in leaves]


CASES = {
    "none": [],
    "loops": [(3, 3)],
    "least_hub": star(-7, range(1500)),
    "largest_hub": star(9999, range(1500)),
    "middle_hubs": star(700, range(1500)) + star(2000, range(1400, 2600)) + [(5000, 5001), (5001, 5000)],
    "chain": [(x, x + 1) for x in range(300)] + star(150, range(4000, 4700)),
    "random": [(r.randrange(900), r.randrange(900)) for r in [random.Random(3)] for _ in range(700)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("hub", [4, 512])
def test_components(spark, monkeypatch, case, hub):
    monkeypatch.setattr(common, "HUB", hub)
    edges = CASES[case]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = plain([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("local", [-1, 600])
def test_components_by_steps(spark, monkeypatch, case, local):
    """Steps alone, and steps until 600 edges are left."""
    monkeypatch.setattr(common, "LOCAL", local)
    test_components(spark, monkeypatch, case, 4)


def test_few_edges_are_cut_twice(spark, monkeypatch):
    """A chain took a dozen rounds, each of several stored steps in as many small files as there are tasks."""
    cuts, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(1) or cut(df))
    edges = [(x, x + 1) for x in range(300)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(301), 0) and len(cuts) == 2
