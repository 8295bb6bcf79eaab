import hashlib
import math

import numpy as np
import pytest

from lectern.llm.queries import ORACLES, QUERIES
from lectern.llm.simplex_clusters import Simplex, clusters, nearest
from tests.compare import differences


def brute(rows, dim, k=16, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found, total, sums = assign(), 0, {}
    for d, j in found:
        sums[j] = sums.get(j, 0) + d
        total += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sums[j], total, names[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 6))
    rows = [(int(i), [float(x) for x in middles[i % 9] + rng.normal(size=6) * 0.2]) for i in range(600)]
    rows += [(600 + i, [0.5] * 6) for i in range(300)]  # a third of the rows is one vector
    rows += [(None, [0.5] * 6), (3, rows[3][1]), (3, [9.0] * 6), (-5, [0.1, -0.1, 0.0, -0.0, 1e-9, -1e-9])]
    rows += [(2000, None), (2001, []), (2002, [0.1] * 5), (2003, [0.1] * 5 + [None]), (2004, [0.1] * 5 + [float("nan")]), (2005, [float("inf")] + [0.1] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as x", "3 as squares", "4 as cluster")
    for parts in (1, 5):
        got = sorted((tuple(r) for r in clusters(df.repartition(parts), dim=6).collect()), key=str)
        assert got == brute(rows, 6)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [1.0, 1.0]) for i in range(40)], [(i, [float(i), 2.0 * i]) for i in range(40)], [(i, [float(i % 3), 0.0]) for i in range(5)]])
def test_few_equal_and_flat_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in clusters(df, dim=2).collect()), key=str) == brute(rows, 2)


def test_too_large_a_component_is_named(spark):
    df = spark.createDataFrame([(77, [1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large in vector 77"):
        clusters(df, dim=2).collect()


def test_bounds_filter_and_never_lose_the_nearest():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-60, 60, size=(4000, 64)) // 8 + (rng.integers(0, 12, size=4000) * 40)[:, None] * rng.integers(-1, 2, size=(1, 64))
    centroids = vectors[:16]
    simplex = Simplex(vectors[:48])
    number, d, compared = nearest(vectors, simplex.squares(vectors), simplex, centroids)
    every = ((vectors[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (d == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert compared < every.size / 3


def test_query_gives_what_its_sql_gives(spark):
    name = "op12_simplex_clusters"
    ours, theirs, rows = differences(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLES[name], "/root/testdata/sf0.001")
    assert not ours and not theirs and rows
