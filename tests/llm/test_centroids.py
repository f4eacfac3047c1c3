import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from quire.llm.centroids import assigned, cluster, fitting
from quire.llm.queries import ORACLES, QUERIES

KIND = "vec_id long, embedding array<double>, label int, distance string"


def plain(rows, clusters, rounds, size, scale=256):
    """Python integers throughout."""
    kept = [(i, [scale * math.floor(x) if abs(x) > 2**60 else math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in by_hash[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c))

    for _ in range(rounds):
        placed = [(nearest(v)[1], v) for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*own, strict=True)] if (own := [v for k, v in placed if k == j]) else w for j, w in enumerate(c)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = [sum(d for _, d, k in found if k == j) for j in range(len(c))]
    long = lambda d: d if d < 2**63 else None
    return sorted(((i, k, long(d), long(sums[k]), long(sum(sums)), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in found), key=repr)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND).repartition(parts)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_rounds_equal_plain_integers(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(200)]
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [1.0, None, 1.0, 1.0, 1.0]), (304, [math.nan, *[1.0] * 4]), (305, [math.inf, *[1.0] * 4]), (306, [0.0] * 5), (306, [0.0] * 5), (306, [0.5] * 5), (None, [-0.001] * 5)]
    assert got(cluster(made(spark, rows), 7, 4, 5)) == plain(rows, 7, 4, 5)
    assert got(cluster(made(spark, rows[:3]), 7, 2, 5)) == plain(rows[:3], 7, 2, 5)  # fewer vectors than centroids
    alike = [(k, [0.25, -0.5]) for k in range(50)]  # ties: every vector goes to the first of equal centroids, the others stay empty
    assert got(cluster(made(spark, alike), 4, 3, 2)) == plain(alike, 4, 3, 2)
    assert cluster(made(spark, rows).limit(0), 7, 2, 5).count() == 0
    assert cluster(made(spark, [(1, None)]), 7, 2, 5).count() == 0


def test_magnitudes_beyond_doubles_and_longs(spark):
    rng = random.Random(9)
    rows = [(k, [rng.choice((1, -1)) * 2.0 ** rng.choice((0, 3, 16, 17, 18, 19, 22, 24, 40, 54, 100)) * rng.random() for _ in range(3)]) for k in range(150)]
    rows += [(500, [1e308, -1e308, 5e-324]), (501, [2.0**53 + 2, 0.0, 0.1])]
    assert got(cluster(made(spark, rows), 6, 3, 3)) == plain(rows, 6, 3, 3)
    few = [(k, [2.0**16 * rng.random() for _ in range(3)]) for k in range(60)]
    assert got(cluster(made(spark, few), 6, 3, 3)) == plain(few, 6, 3, 3)
    odd = [(k, [rng.random() for _ in range(3)]) for k in range(60)]  # a scale that is no power of two is not rounded first
    want = plain([(i, [x for x in v]) for i, v in odd], 4, 2, 3, 1000)
    exact = [(i, k) for i, k, *_ in got(cluster(made(spark, odd), 4, 2, 3, scale=1000))]
    assert exact == [(i, k) for i, k, *_ in want]


@pytest.mark.parametrize("top", [2**10, 2**23, 2**24, 2**26, 2**31, 2**45])
def test_nearest_at_the_bounds_of_each_number(top):
    rng = np.random.default_rng(top)
    x, c = rng.integers(-top, top, (300, 8)), rng.integers(-top, top, (11, 8))
    c[5] = c[3]
    number, distance = assigned(x, c)
    for v, k, d in zip(x.tolist(), number.tolist(), distance.tolist(), strict=True):
        assert (d, k) == min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c.tolist()))
    assert fitting([[1 << 70]], 1).dtype == object and fitting([], 8).shape == (0, 8)


def test_query_and_its_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    found = QUERIES["op11_centroids"](spark, at)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op11_centroids']})").fetchall()
    assert got(found) == sorted(want, key=repr) and len(want) == 500
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    assert got(found) == plain(rows, 40, 5, 64)
