import math

import numpy as np
import pytest

from quire.llm.lattice import NEIGHBOURS, lattice_dedup, lattice_point


def all_pairs(rows):
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if label is None or label != other or any(u is None or None in u or not all(map(math.isfinite, u)) or not any(u) for u in (v, w)) or len(v) != len(w):
                continue
            if np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return links, [find(k) for k in range(len(rows))]


@pytest.mark.parametrize("most", [2000, 7])
def test_matches_all_pairs(spark, most):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append([len(rows), (centre + rng.normal(size=16) * 0.12).astype(np.float32).tolist(), label])
    rows += [[len(rows) + k, rows[4][1], 0] for k in range(40)]
    rows += [[len(rows), [2.0 * x for x in rows[4][1]], 0]]
    for odd in (None, [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], []):
        rows.append([len(rows), odd, 1])
        rows.append([len(rows), odd, 1])
    links, root = all_pairs(rows)
    got = lattice_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4), most=most).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (links[k], root[k], root[k] == k) for k in links}


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above the threshold, in general position, are found in at least 0.97 of cases."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(600, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9305 * a + math.sqrt(1 - 0.9305**2) * b / np.linalg.norm(b, axis=1)[:, None]
    rows = [(k, v.tolist(), 3) for k, v in enumerate(np.concatenate([a, b]))]
    got = lattice_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links > 0").count() >= 0.97 * 1200


def test_lattice_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 3
    point = lattice_point(x)
    doubled = np.rint(2 * point).astype(int)
    assert (np.ptp(doubled % 2, axis=1) == 0).all() and (point.sum(1) % 2 == 0).all()
    gap = ((x - point) ** 2).sum(1)
    assert (gap <= 1 + 1e-9).all() and all((((x - point - v) ** 2).sum(1) >= gap - 1e-9).all() for v in NEIGHBOURS)
    assert len(NEIGHBOURS) == 240


def test_empty_table(spark):
    assert lattice_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
