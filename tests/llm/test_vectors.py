"""The embedding join against all pairs."""

import numpy as np
import pytest

from tagweave.llm.embeddings import components_of, near_vectors

SCHEMA = "vec_id long, label int, embedding array<float>, n_links string"


def brute(rows):
    ok = [
        (i, lab, np.array(v, float))
        for i, lab, v, _ in rows
        if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    name = {i: i for i, _, _ in ok}
    links = dict.fromkeys(name, 0)
    pairs = []
    for a, la, x in ok:
        for b, lb, y in ok:
            if a != b and la == lb and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    pairs.append((a, b))
    for _ in range(len(name)):
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    return [(i, links.get(i, 0), name.get(i, i), i is not None and name.get(i, i) == i) for i, *_ in rows]


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [
        (i, i % 3 if i % 17 else None, (centres[i % 12] + rng.normal(size=16) * 0.25).tolist(), "x")
        for i in range(150)
    ]
    rows += [(200 + i, 1, [2.0] * 16, "x") for i in range(20)]  # copies
    rows += [(300, 1, [4.0] * 16, "x"), (301, 1, [1e-30] * 16, "x"), (302, 2, [2.0] * 16, "x")]
    rows += [(310, 1, None, "x"), (311, 1, [], "x"), (312, 1, [0.0] * 16, "x"), (313, 1, [float("nan")] * 16, "x")]
    rows += [(314, 1, [None] + [1.0] * 15, "x"), (315, 1, [2.0] * 8, "x"), (316, 1, [float("inf")] * 16, "x")]
    rows += [(None, 1, [2.0] * 16, "x")]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, 1, a, "x"), (5, 1, b, "x"), (2, 1, [1.0, 0.1, 0.0], "x"), (9, 1, [0.0, 1.0, 0.1], "x"), (7, 1, b, "x")]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 2, True), (5, 1, 2, False), (5, 2, 5, True), (7, 2, 5, False), (9, 2, 5, False)]


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_forest_joins_the_same():
    linked = np.ones((40, 30), bool)
    i, j = components_of(linked, False)
    assert len(i) == 69 and len(set(i)) == 40 and len(set(j)) == 30
