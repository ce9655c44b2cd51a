import hashlib
import math
import random

import numpy as np

from lattica.llm import centroids
from lattica.llm.centroids import LIMIT, nearest, segment_norms

VECTORS = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, dims):
    """Plain integer arithmetic over rows of ``(vec_id, embedding)``."""
    kept = [(i, [math.floor(max(min(256 * x, LIMIT), -LIMIT)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, at) in zip(kept, found) if at == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign())], c


def test_screening_is_exact_and_spares_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (40, 64))
    v = np.vstack([centres[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 64)), centres, centres, np.zeros((3, 64), int), np.full((2, 64), LIMIT), np.full((2, 64), -LIMIT)])
    c = np.vstack([centres, centres[:3], np.zeros((1, 64), int), np.full((1, 64), LIMIT)])
    got, distance, exact = nearest(v, segment_norms(v), c, segment_norms(c))
    want = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (got == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    assert exact < 0.1 * v.shape[0] * c.shape[0]


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(4)
    for scale in (1, 300, LIMIT):
        for dims in (64, 7, 1):
            v, c = rng.integers(-scale, scale + 1, (200, dims)), rng.integers(-scale, scale + 1, (30, dims))
            got, distance, _ = nearest(v, segment_norms(v), c, segment_norms(c))
            want = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
            assert (got == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_clusters_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 0.5) for _ in range(6)]) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (500, [0.0] * 6), (501, [0.0] * 6), (502, [1e300, -1e30, 1e9, 0.0, 0.0, 0.0]), (None, [0.1] * 6)]
    bad = [(600, None), (601, []), (602, [0.0] * 5), (603, [0.0] * 5 + [None]), (604, [0.0] * 5 + [math.nan]), (605, [math.inf] + [0.0] * 5)]
    df = spark.createDataFrame([(i, e, "clash") for i, e in rows + bad], VECTORS).repartition(3)
    got, ends = centroids.cluster_vectors(df, k=12, rounds=4, dims=6)
    want, c = brute(rows + bad, 12, 4, 6)
    assert ends == c and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    few, ends = centroids.cluster_vectors(df.limit(0).union(spark.createDataFrame([(i, e, "") for i, e in rows[:3]], VECTORS)), k=12, rounds=2, dims=6)
    assert len(ends) == 3 and {(r.vec_id, r.distance) for r in few.collect()} == {(i, 0) for i in range(3)}
    none, ends = centroids.cluster_vectors(df.limit(0), dims=6)
    assert ends == [] and none.count() == 0 and none.columns == ["vec_id", "cluster", "distance"]
