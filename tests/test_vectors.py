"""Near vectors against all pairs, with sizes so small that many shards, blocks and groups arise."""

from __future__ import annotations

import numpy as np
import pytest

from usagelens.operators import vectors

SCHEMA = "id bigint, v array<double>, key string, copies string, is_near string"


def plain_near(rows, threshold):
    """(id, is_near) of all rows by comparing everything with everything."""
    out = []
    units = []
    for _, v in rows:
        a = None if v is None or any(x is None for x in v) else np.array(v, dtype=float)
        good = a is not None and len(a) and np.isfinite(a).all() and a.any()
        units.append(a / np.linalg.norm(a) if good else None)
    for i, (key, _) in enumerate(rows):
        u = units[i]
        out.append((key, u is not None and any(
            j != i and w is not None and len(w) == len(u) and u @ w >= threshold - 1e-12 for j, w in enumerate(units)
        )))
    return sorted(out, key=repr)


def found(spark, rows, threshold):
    df = spark.createDataFrame([(k, v, "", "", "") for k, v in rows], SCHEMA)
    return sorted(((r.id, r.is_near) for r in vectors.near_vectors(df, "id", "v", threshold).collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_BYTES", 2048)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(vectors, "GROUP_BYTES", 8192)
    monkeypatch.setattr(vectors, "PIVOTS", 8)
    monkeypatch.setattr(vectors, "STRIP", 7)


@pytest.mark.parametrize("threshold", [0.6, 0.9, 0.99])
def test_equals_all_pairs(spark, small, threshold):
    rng = np.random.default_rng(int(threshold * 100))
    centres = rng.normal(size=(12, 16))
    noise = rng.choice([0.02, 0.1, 0.3, 0.8], size=(240, 1))
    points = centres[rng.integers(12, size=240)] + noise * rng.normal(size=(240, 16))
    rows = [(i, p.tolist()) for i, p in enumerate([*points, *rng.normal(size=(80, 16))])]
    want = plain_near(rows, threshold)
    assert {True, False} == {near for _, near in want}
    assert found(spark, rows, threshold) == want


def test_hot_families_and_odd_rows(spark, small):
    rng = np.random.default_rng(5)
    family = rng.normal(size=8) + 0.01 * rng.normal(size=(150, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(family)]
    rows += [(1000, [1.0, 0.0]), (1001, [2.0, 0.0]), (1002, [0.0, 1.0]), (1003, [0.0, 1.0, 0.0])]
    rows += [(1004, [-1.0, -0.0]), (1005, [-1.0, 0.0]), (1006, None), (1007, []), (1008, [0.0, 0.0])]
    rows += [(1009, [float("nan"), 1.0]), (1010, [float("inf"), 1.0]), (1011, [None, 1.0]), (None, [0.5, 0.5])]
    rows += [(1000, [3.0, -7.0])] + [(2000, [5.0] * 8)] * 200
    assert found(spark, rows, 0.95) == plain_near(rows, 0.95)


def test_scaled_copies_reach_one(spark):
    rows = [(1, [0.1, 0.2, 0.7]), (2, [0.3, 0.6, 2.1]), (3, [0.1, 0.2, 0.70001])]
    assert found(spark, rows, 1.0) == [(1, True), (2, True), (3, False)]


def test_empty_table_and_stats(spark):
    none = vectors.near_vectors(spark.createDataFrame([], SCHEMA), "id", "v")
    assert none.columns == ["id", "copies", "is_near"] and none.count() == 0
    assert vectors.near_vector_stats(none).first() == (0, 0, 0, 0.0, 0.0)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, None)], "id int, v array<double>")
    assert vectors.near_vector_stats(vectors.near_vectors(df, "id", "v")).first() == (4, 2, 3, 0.5, 0.75)


def test_thresholds_out_of_range_raise(spark):
    with pytest.raises(ValueError):
        vectors.near_vectors(spark.createDataFrame([], SCHEMA), "id", "v", 0.0)
