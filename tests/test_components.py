"""Leaders of linked rows against the greedy rule, in order, and how many rounds they take."""

from __future__ import annotations

import random

import pytest

from hearthline.operators import components


def greedy(links):
    earlier: dict[int, list[int]] = {}
    for a, b in links:
        earlier.setdefault(a, [])
        earlier.setdefault(b, []).append(a)
    leaders: set[int] = set()
    for node in sorted(earlier):
        if not leaders & set(earlier[node]):
            leaders.add(node)
    return leaders


@pytest.mark.parametrize(("small", "eager"), [(100_000, 1), (40, 1), (0, 2)])
def test_leaders_are_those_of_the_greedy_rule(spark, small, eager):
    r = random.Random(small + eager)
    links = {tuple(sorted(r.sample(range(200), 2))) for _ in range(160)}  # trees and small cycles
    links |= {tuple(sorted(r.sample(range(1000, 1030), 2))) for _ in range(120)}  # dense
    links |= {(2000 + i, 2001 + i) for i in range(60)} | {(3000, 3000 + i) for i in range(1, 80)}  # a chain and a star
    got = components.first_leaders(spark.createDataFrame(sorted(links), "a long, b long"), small, eager).collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node for x in got} == greedy(links)


@pytest.mark.parametrize("small", [100_000, 0])
def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch, small):
    n, steps = 10_000, []
    monkeypatch.setattr(components, "_cut", lambda df, real=components._cut: steps.append(1) or real(df))
    # ids in no order of the chain, but each linked with the one before
    got = components.first_leaders(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"), small).selectExpr("sum(node)", "count(*)", "min(node % 2)", "max(node % 2)").first()
    assert tuple(got) == (sum(range(0, n, 2)), n // 2, 0, 0)
    assert len(steps) <= 26  # checkpoints: one for each doubling, and a few about them


def test_no_links(spark):
    assert components.first_leaders(spark.createDataFrame([], "a long, b long")).count() == 0
