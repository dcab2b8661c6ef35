import hashlib
import math

import numpy as np
import pytest

from tracekit.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance double"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in vectors], SCHEMA)


def plain(rows, dims, k=8, rounds=10, salt="3", scale=1024):
    """The contract, one vector at a time, in Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < C.LIMIT / scale for x in v)]

    def key(row):
        return hashlib.sha256(f"{salt}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    centers = [v for _, v in sorted(kept, key=key)[:k]]
    for step in range(rounds + 1):
        where = []
        for _, v in kept:
            found = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers]
            where.append((min(found), found.index(min(found))))
        if step < rounds:
            for c in range(len(centers)):
                own = [v for (_, v), (_, w) in zip(kept, where) if w == c]
                if own:
                    centers[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, w, d) for (i, _), (d, w) in zip(kept, where)), key=repr), centers


def same(spark, rows, dims, **how):
    got, centers = C.cluster(table(spark, rows), dims=dims, **how)
    want, plain_centers = plain(rows, dims, **how)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=repr) == want
    assert centers == plain_centers
    return got, centers


def test_equals_plain_rounds(lspark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 16))
    rows = [(i, (middle[i % 6] + rng.normal(scale=0.3, size=16)).astype(np.float32).tolist()) for i in range(300)]
    same(lspark, rows, 16)
    same(lspark, rows, 16, k=3, rounds=2, salt="7")


def test_ties_repeats_and_broken_vectors(lspark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(80)]  # many equal distances
    rows += [(5, rows[5][1])] * 30 + [(None, [1.0, 0.0, 0.0, 0.0])] * 2
    rows += [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [math.nan, 0.0, 0.0, 0.0]),
             (904, [math.inf, 0.0, 0.0, 0.0]), (905, [3e38, 0.0, 0.0, 0.0]), (906, []), (907, [1e5, -1e5, 1e5, 0.25])]
    got, centers = same(lspark, rows, 4)
    full = C.with_inertia(got, centers).collect()
    assert all(r["inertia"] == sum(x["distance"] for x in full) for r in full)
    assert all(r["cluster_inertia"] == sum(x["distance"] for x in full if x["cluster"] == r["cluster"]) for r in full)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest() for r in full)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0])], [(1, [0.0])]])
def test_few_rows(lspark, rows):
    got, centers = same(lspark, rows, 2)
    assert C.with_inertia(got, centers).count() == len(got.collect())


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(8, 64)) * 300
    vectors = np.floor(middle[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 64)) * 40).astype(np.int64)
    vectors[:50] = vectors[50]
    for pivots in (vectors[:12], vectors[100:112], vectors[100:101], np.vstack([vectors[100:103], vectors[100:103] + 1])):
        simplex, others = C.Simplex(pivots), np.floor(middle).astype(np.int64)
        apexes, exact = simplex.apexes(vectors), C.distances(vectors, others)
        low, high = simplex.bounds(apexes, simplex.apexes(others))
        assert (low <= exact).all() and (exact <= high).all()
        low, high = simplex.bounds(apexes, apexes[:9])
        assert (low <= C.distances(vectors, vectors[:9])).all() and (C.distances(vectors, vectors[:9]) <= high).all()
        where, best, compared = C.nearest(vectors, apexes, simplex, others)
        assert (where == exact.argmin(1)).all() and (best == exact.min(1)).all()
    simplex = C.Simplex(vectors[100:112])
    assert C.nearest(vectors, simplex.apexes(vectors), simplex, others)[2] < 0.3 * exact.size


def test_large_components_stay_exact():
    vectors = np.array([[C.LIMIT - 1] * 64, [1 - C.LIMIT] * 64, [0] * 64], np.int64)
    simplex = C.Simplex(vectors)
    where, best, _ = C.nearest(vectors, simplex.apexes(vectors), simplex, vectors[:2])
    assert where.tolist() == [0, 1, 0] and best.tolist() == [0, 0, 64 * (C.LIMIT - 1) ** 2]
