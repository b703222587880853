"""Exact nearest neighbours against scores of all pairs."""

import numpy as np
import pandas as pd
import pytest

from sievework.operators import neighbours


def _frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], "clash") for i, v in zip(ids, vectors, strict=True)], "id long, vector array<double>, score string")


def _plain(queries, examples, k):
    out = []
    for q, v in queries:
        scored = []
        for e, w in examples:
            size = np.linalg.norm(v) * np.linalg.norm(w)
            scored.append((-round(float(np.dot(v, w) / size), 9) if size > 1e-12 else 0.0, e))
        out += [(q, e, -s + 0.0) for s, e in sorted(scored)[:k]]
    return sorted(out)


def _rounded(df):
    return sorted((r["query_id"], r["example_id"], round(r["score"], 9) + 0.0) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(2)
    middle = draw.normal(size=(12, 6)) * 4
    near = [*(middle[i % 12] + draw.normal(size=6) * 0.2 for i in range(240))]
    hot = [np.array([1.0, 2.0, 0, 0, 0, -1])] * 120  # a third of all rows
    return [*near, *hot, np.zeros(6), np.array([1e-3, 2e-3, 0, 0, 0, -1e-3])]


@pytest.mark.parametrize(("k", "block", "cells"), [(3, 10_000, 256), (3, 20, 256), (5, 9, 4), (400, 50, 256)])
def test_nearest_equals_all_pairs(spark, vectors, k, block, cells):
    ids = np.random.default_rng(4).permutation(len(vectors))
    rows = list(zip(ids.tolist(), vectors, strict=True))
    asked = rows[::7] + [(9001, np.zeros(6)), (9002, np.ones(6))]
    got = neighbours.nearest(_frame(spark, *zip(*asked, (9003, None), strict=True)), _frame(spark, *zip(*rows, (9004, None), strict=True)), k, block=block, cells=cells)
    assert got.columns == ["query_id", "example_id", "score"]
    assert _rounded(got) == _plain(asked, rows, k)


def test_nearest_of_nothing(spark, vectors):
    some, none = _frame(spark, [1, 2], vectors[:2]), _frame(spark, [], [])
    assert neighbours.nearest(some, none).collect() == [] and neighbours.nearest(none, some).collect() == []
    sure = some.selectExpr("*", "if(id = 1, 0.95, 0.5) AS confidence")
    assert {r["example_id"] for r in neighbours.nearest(some, sure, 3, 0.9).collect()} == {1}


def test_far_cells_are_not_visited(vectors):
    x = neighbours.unit_rows(vectors[:240], 0)
    away = neighbours.distances(x, x[:12])
    cell = away.argmin(axis=1)
    edge = np.ceil(away.min(axis=1) * 16) / 16
    counts = pd.DataFrame({"cell": cell, "edge": edge}).groupby(["cell", "edge"]).size().rename("n").reset_index()
    reach = neighbours.reach(away, counts, 3)
    third = np.sort(neighbours.distances(x, x), axis=1)[:, 2]
    assert (third <= reach + 1e-9).all()
    visited = away - counts.groupby("cell")["edge"].max().to_numpy() <= reach[:, None]
    assert visited.mean() < 0.4
    assert np.isinf(neighbours.reach(away[:1], counts, 241)).all()


def test_equal_vectors_need_little_room():
    same = np.array([0.6, 0.8, 0, 0]).tobytes()
    examples = pd.DataFrame({"id": np.arange(50_000)[::-1], "vector": [same] * 50_000})
    got = neighbours.compare(pd.DataFrame({"id": np.arange(2000), "vector": [same] * 2000}), examples, 3)
    assert got["example_id"].tolist() == [0, 1, 2] * 2000
