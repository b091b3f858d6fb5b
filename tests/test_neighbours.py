"""Nearest neighbours against all distances, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort as C
from tidemark.operators import neighbours as N

FEATURES = ["a", "b", "c", "d"]


def frame(spark, ids, x, parts=6):
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, x)], "id long, a double, b double, c double, d double").repartition(parts)


def brute(ids, x, asked, y, k):
    d = N.distances(y, x)
    out = {}
    for i, row in zip(asked, d):
        best = sorted((dist, j) for dist, j in zip(row, ids) if j != i)[:k]
        out[i] = [(j, dist) for dist, j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "place").collect():
        out.setdefault(r.query, []).append((r.neighbour, r.distance))
    return out


def points(kind, n):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4))
    if kind == "clusters":
        x = x * 0.1 + rng.integers(0, 6, (n, 1)) * 3
    if kind == "constant":
        x[:, 0] = 1.0
    if kind == "ties":
        x = np.floor(x * 1.5)
    if kind == "one hot point":
        x[: n // 2] = x[0]
    return x


def test_equal_to_all_distances_on_five_thousand_rows(spark):
    x = points("normal", 5000)
    df = frame(spark, range(5000), x)
    assert found(N.nearest(df, df, "id", FEATURES, 5)) == brute(range(5000), x, range(5000), x, 5)


@pytest.mark.parametrize("kind", ["clusters", "constant", "ties", "one hot point"])
def test_skewed_points(spark, kind):
    x = points(kind, 1200)
    df = frame(spark, range(1200), x)
    got = found(N.nearest(df.where("id % 3 = 0"), df, "id", FEATURES, 4, pivots=12, block=100))
    assert got == brute(range(1200), x, range(0, 1200, 3), x[::3], 4)


def test_a_constant_feature_makes_many_cells(spark):
    x = points("constant", 2000)
    centres = N.spread_out(x[:500], 32)
    sizes = np.bincount(N.distances(x, centres).argmin(1), minlength=len(centres))
    assert len(centres) == 32 and sizes.max() < 2000 / 3


def test_few_rows_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (2, 3.0, 4.0), (3, None, 1.0), (None, 0.0, 0.0)], "id long, x double, y double")
    df = df.withColumns({c: F.lit(1) for c in ("v", "ids", "cell", "q", "distance")})
    assert found(N.nearest(df, df, "id", ["x", "y"], 3)) == {1: [(2, 5.0)], 2: [(1, 5.0)]}
    assert N.nearest(df, df.where("id > 9"), "id", ["x", "y"]).count() == 0
    assert N.nearest(df.where("id > 9"), df, "id", ["x", "y"]).count() == 0


def test_votes_of_neighbours(spark):
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(300, 4)), rng.normal(size=(80, 4))
    t[0] = x[0]
    y = (x[:, 0] + rng.normal(size=300) * 0.3 > 0).astype(int)
    train = frame(spark, range(300), x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, y int"), "id")
    d = N.distances(t, x)
    order = np.argsort(d, axis=1)[:, :7]
    for weights in ("uniform", "distance"):
        got = {r.id: r.probability for r in N.knn_predict(train, frame(spark, range(80), t), "id", "y", FEATURES, 7, weights).collect()}
        for i in range(80):
            w = np.ones(7) if weights == "uniform" else (1 / d[i, order[i]] if d[i, order[i]].min() > 0 else (d[i, order[i]] == 0).astype(float))
            assert got[i] == pytest.approx((w * y[order[i]]).sum() / w.sum(), abs=1e-12)


def test_smote_uses_the_nearest_and_names_their_group(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    x[:, 0] = 2.0  # the first feature has no spread
    label = (np.arange(400) % 5 == 0).astype(int)
    rows = [(i, int(label[i]), f"g{i % 37}", *map(float, x[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, grp string, a double, b double, c double, d double")
    out = C.smote(df, "id", "y", FEATURES, k=3, group="grp").collect()
    assert len(out) == 320 - 80
    minor = np.flatnonzero(label)
    near = brute(minor.tolist(), x[minor], minor.tolist(), x[minor], 3)
    for r in out:
        assert r.neighbour in [j for j, _ in near[r.base]]
        v = np.array([r.a, r.b, r.c, r.d])
        line = x[r.neighbour] - x[r.base]
        assert np.allclose(np.cross((v - x[r.base])[1:], line[1:]), 0, atol=1e-12) and r.a == 2.0
        closest = minor[((x[minor] - v) ** 2).sum(1).argmin()]
        assert r.grp == f"g{closest % 37}"
