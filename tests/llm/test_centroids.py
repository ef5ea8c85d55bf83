"""Centroid clustering: the search against all distances, and whole results against a plain version."""
import hashlib

import numpy as np
import pytest

from tracewell.llm import centroids

VECTORS = "vec_id long, embedding array<float>, label int, vector string, cluster long, distance string, digest int"


def plain(rows, clusters, rounds=3, seed=1, size=64, scale=64):
    """[(id, cluster, distance, inertia of the cluster, of all, digest)] by all distances, in Python's integers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == size and all(x is not None and np.isfinite(np.float32(x)) for x in vector):
            kept.append((vec_id, [int(np.floor(scale * float(np.float32(x)))) for x in vector]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in order[:clusters]]

    def placed():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, c) in zip(kept, placed()):
            groups.setdefault(c, []).append(v)
        for c, own in groups.items():
            points[c] = [sum(column) // len(own) for column in zip(*own)]
    last = placed()
    total = {c: sum(d for d, k in last if k == c) for c in range(len(points))}
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return [(i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, last)]


def awkward(rng):
    rows = [(int(i), [float(x) for x in rng.normal(size=64) / 3]) for i in range(150)]
    rows += [rows[3], rows[3], (500, rows[4][1]), (501, [0.0] * 64), (502, [0.0] * 64), (503, [-1 / 64] * 64), (504, [1000.0] * 64), (505, [0.1, -0.1] * 32)]
    rows += [(None, rows[5][1]), (None, rows[6][1]), (600, None), (601, []), (602, [0.5] * 63), (603, [0.5] * 65), (604, [None] * 64),
             (605, [float("nan")] + [0.5] * 63), (606, [float("inf")] + [0.5] * 63), (607, [0.5] * 63 + [None])]
    return rows


@pytest.mark.parametrize("clusters", [1, 5, 16, 400])
def test_equals_plain(spark, clusters):
    rows = awkward(np.random.default_rng(1))
    docs = spark.createDataFrame([(i, v, 1, "a", 7, None, 2) for i, v in rows], VECTORS).repartition(5)
    got = centroids.clustered(docs, clusters=clusters).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows, clusters), key=repr)


def test_empty(spark):
    assert centroids.clustered(spark.createDataFrame([], VECTORS)).collect() == []
    assert centroids.clustered(spark.createDataFrame([(1, None, 1, "a", 7, None, 2), (None, [0.5] * 3, 1, "a", 7, None, 2)], VECTORS)).collect() == []


def test_search_is_exact_and_computes_few_distances():
    rng = np.random.default_rng(2)
    points = rng.integers(-60, 60, (64, 16)) + np.arange(-32, 32)[:, None] * 20
    points[7] = points[21]
    vectors = np.concatenate([points[rng.integers(0, 64, 3000)] + rng.integers(-9, 9, (3000, 16)), points, np.full((2, 16), 5000)])
    label, best, computed = centroids.Search(points).nearest(vectors)
    every = ((vectors[:, None, :] - points) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (label == every.argmin(axis=1)).all()
    assert computed < 0.2 * every.size
    level = rng.integers(-(1 << 24) + 1, 1 << 24, (200, 64))
    label, best, _ = centroids.Search(level[:9]).nearest(level)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, p)) for p in level[:9]] for v in level]
    assert best.tolist() == [min(d) for d in exact] and label.tolist() == [d.index(min(d)) for d in exact]


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="must stay below"):
        centroids.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()
