"""Components of links, and what they cost where nothing is left to join."""

from __future__ import annotations

import random

import pytest

from usagelens.llm import components as module
from usagelens.llm.components import components, extended

LINKS = "u bigint, v bigint"


def plain(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


def labels_of(df):
    rows = [tuple(r) for r in df.select("node", "label").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.fixture
def tables(monkeypatch):
    """Labels of the tables written."""
    made, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, label: made.append(label) or write(df, label))
    return made


def test_stars_take_no_round(spark, tables):
    """Settled links are read once; a round to see that nothing changes would write them again."""
    links = [(u, 1) for u in range(2, 30)] + [(u, 100) for u in range(101, 120)]
    assert labels_of(components(spark.createDataFrame(links, LINKS))) == plain(links)
    assert tables == ["links"]


@pytest.mark.parametrize("seed", [1, 2])
def test_more_links_join_components(spark, seed):
    rng = random.Random(seed)
    some = lambda n: [(rng.randrange(60), rng.randrange(60)) for _ in range(n)]
    first, more = [(u, v) for u, v in some(25) if u != v], [(u, v) for u, v in some(12) if u != v]
    labels = components(spark.createDataFrame(first, LINKS))
    assert labels_of(labels) == plain(first)
    chain = [(i, i + 1) for i in range(200, 220)]
    assert labels_of(extended(labels, spark.createDataFrame(more + chain, LINKS))) == plain(first + more + chain)


def test_links_inside_components_change_nothing(spark, tables):
    links = [(2, 1), (3, 2), (7, 5)]
    labels = components(spark.createDataFrame(links, LINKS))
    tables.clear()
    assert labels_of(extended(labels, spark.createDataFrame([(3, 1), (5, 7)], LINKS))) == plain(links)
    assert tables == ["links"]
    assert labels_of(extended(labels, spark.createDataFrame([], LINKS))) == plain(links)
