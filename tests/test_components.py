"""Components against union-find, and the rounds that they take."""

import random

import pytest

from loam.operators import components


def roots(links):
    up = {}

    def find(k):
        up.setdefault(k, k)
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in up}


@pytest.mark.parametrize("heavy", [100_000, 5])
def test_components_equal_union_find(spark, monkeypatch, heavy):
    """With heavy keys at 5 rows, hubs go by broadcast in renaming, in composing names and in the last join."""
    monkeypatch.setattr(components, "HEAVY", heavy)
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000, 1001 + k) for k in range(200)] + [(2000 + k, 2001 + k) for k in range(60)]
    links += [(3000 - k % 3, 3001 + k) for k in range(100)] + links[:20] + [(-5, 1100), (7, 7)]
    rows = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(rows).collect()}
    assert found == roots([x for x in links if x[0] != x[1]])


def test_a_long_path_takes_few_rounds(spark):
    rounds = []
    path = spark.range(9999).selectExpr("id AS a", "id + 1 AS b")
    found = components.connected_components(path, rounds)
    assert found.where("component = 0").count() == 10_000
    assert len(rounds) <= 20 and all(b <= 0.75 * a for a, b in zip(rounds[:8], rounds[1:9]))


def test_a_star_takes_two_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "HEAVY", 1000)
    rounds = []
    star = spark.range(50_000).selectExpr("999999 AS a", "id AS b")
    assert components.connected_components(star, rounds).where("component = 0").count() == 50_001
    assert len(rounds) <= 2
