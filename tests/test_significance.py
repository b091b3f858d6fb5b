"""Chances against tables, closed forms and numerical integration; statistics against plain computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import significance as S


def integral(f, a, b, n=4000):
    x, w = np.polynomial.legendre.leggauss(60)
    edges = np.linspace(a, b, n // 60 + 2)
    return sum((hi - lo) / 2 * (w * f((hi + lo) / 2 + (hi - lo) / 2 * x)).sum() for lo, hi in zip(edges, edges[1:]))


def t_chance(t, k):
    c = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi)
    return 1 - 2 * integral(lambda x: c * (1 + x * x / k) ** (-(k + 1) / 2), 0, abs(t))


def test_gamma_and_tails(spark):
    z = [0.01, 0.5, 1, 2, 3.7, 50, 12345.5]
    df = spark.createDataFrame([(float(v),) for v in z], "v double")
    for r in df.select("v", S.log_gamma(F.col("v")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.v), abs=1e-10, rel=1e-12)
    x = [0.0, 1e-9, 0.3, 1, 1.96, 2.4999, 2.5, 3, 5, 8, 30, 40]
    df = spark.createDataFrame([(s * v,) for v in x for s in (1.0, -1.0)], "v double")
    for r in df.select("v", S.normal_tails(F.col("v")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.v) / math.sqrt(2)), rel=1e-10, abs=1e-300)


def test_student_tails(spark):
    cases = [(t, k) for t in (0.0, 0.1, 1.0, 1.8, 2.5, 6.0) for k in (1.0, 2.5, 7.0, 30.3, 400.0, 20_000.0)]
    df = spark.createDataFrame([(float(t), k) for t, k in cases], "t double, k double")
    for r in df.select("t", "k", S.t_tails(F.col("t"), F.col("k")).alias("p")).collect():
        assert r.p == pytest.approx(t_chance(r.t, r.k), abs=1e-9)
    # Closed forms for one and two degrees of freedom, far out.
    far = spark.createDataFrame([(50.0, 1.0), (50.0, 2.0)], "t double, k double").select(S.t_tails(F.col("t"), F.col("k")).alias("p")).collect()
    assert far[0].p == pytest.approx(1 - 2 / math.pi * math.atan(50), rel=1e-9) and far[1].p == pytest.approx(1 - 50 / math.sqrt(2502), rel=1e-9)


def data(spark, seed=3):
    rng = np.random.default_rng(seed)
    n = 260
    y = (rng.random(n) < 0.4).astype(int)
    cols = {"same": rng.normal(size=n), "moved": rng.normal(size=n) + y, "ties": np.floor(rng.normal(size=n) * 2 + 0.4 * y), "flat": np.full(n, 3.0)}
    rows = [(int(y[i]), *[float(c[i]) for c in cols.values()]) for i in range(n)] + [(7, 1e9, 1e9, 1e9, 1e9), (0, None, None, None, None)]
    return y, cols, spark.createDataFrame(rows, "y int, same double, moved double, ties double, flat double").repartition(5)


def test_group_statistics_and_ranks(spark):
    y, cols, df = data(spark)
    got = {r.feature: r for r in S.group_statistics(df, list(cols), "y", 1, 0).collect()}
    for name, v in cols.items():
        a, b, r = v[y == 1], v[y == 0], got[name]
        u = sum((a[:, None] > b).sum(1)) + (a[:, None] == b).sum() / 2
        assert r.u == pytest.approx(u) and (r.n_a, r.n_b) == (len(a), len(b))
        if name == "flat":
            assert r.t is None and r.t_p is None and r.z is None and r.u_p is None
            continue
        e0, e1 = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        t, dof = (a.mean() - b.mean()) / math.sqrt(e0 + e1), (e0 + e1) ** 2 / (e0**2 / (len(a) - 1) + e1**2 / (len(b) - 1))
        assert r.t == pytest.approx(t) and r.dof == pytest.approx(dof) and r.t_p == pytest.approx(t_chance(t, dof), abs=1e-9)
        n, ties = len(v), sum(c**3 - c for c in np.unique(v, return_counts=True)[1].tolist())
        sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / sd
        assert r.u_p == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), abs=1e-9)
    ranks = {r.feature: r for r in S.rank_significance(df, list(cols), "y", 1, 0).collect()}
    assert ranks["moved"].rank == 1 and ranks["flat"].rank == 4 and ranks["flat"].combined_p is None
    q = got["ties"].t_p * got["ties"].u_p
    assert ranks["ties"].combined_p == pytest.approx(q * (1 - math.log(q)))


def test_fisher_is_the_chi_square_tail(spark):
    row = spark.range(1).select(S.fisher_combined(F.lit(0.03), F.lit(0.2)).alias("p"), S.fisher_combined(F.lit(0.0), F.lit(0.2)).alias("z")).first()
    x = -2 * (math.log(0.03) + math.log(0.2))
    assert row.p == pytest.approx(math.exp(-x / 2) * (1 + x / 2)) and row.z == 0


def test_distance_from_normal(spark):
    _, cols, df = data(spark)
    got = {r.feature: r for r in S.normal_distance(df.where("y < 2"), list(cols)).collect()}
    for name in ("same", "ties"):
        v = np.sort(cols[name])
        below = np.array([0.5 * math.erfc(-(x - v.mean()) / v.std(ddof=1) / math.sqrt(2)) for x in v])
        n = len(v)
        want = max((np.searchsorted(v, v, side="right") / n - below).max(), (below - np.searchsorted(v, v, side="left") / n).max())
        assert got[name].distance == pytest.approx(want, abs=1e-12) and got[name].n == n
    assert got["same"].p > 0.05 > got["ties"].p and got["flat"].distance is None and got["flat"].p is None
    assert S.normal_distance(df.where("y > 9"), ["same"]).count() == 0


def scores(spark, n=700, seed=5):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(rng.normal(0.35 + 0.25 * y, 0.2), 0, 1), 2)
    p[rng.random(n) < 0.3] = 0.001  # most scores in one place
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    return y, p, df


def plain(y, p, threshold=0.5):
    hit = p >= threshold
    tp, fp, fn, tn = ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    ap, last = 0.0, 0.0
    for t in sorted(set(p.tolist()), reverse=True):
        h = p >= t
        recall = (h & (y == 1)).sum() / len(pos)
        ap, last = ap + (recall - last) * (h & (y == 1)).sum() / h.sum(), recall
    sens, spec = tp / (tp + fn), tn / (tn + fp)
    return {"accuracy": (tp + tn) / len(y), "precision": tp / (tp + fp), "recall": sens, "f1": 2 * tp / (2 * tp + fp + fn), "average_precision": ap, "roc_auc": auc, "balanced_accuracy": (sens + spec) / 2}


def test_the_seven_metrics(spark):
    y, p, df = scores(spark)
    got, want = V.metric_suite(df, "p", "y").first().asDict(), plain(y, p)
    v = np.array([want[m] for m in V.METRICS])
    assert got == pytest.approx(want | {"mean": v.mean(), "sd": v.std()})
    two = V.metric_suite(df.withColumn("k", F.lit("a")).union(df.where("y = 1").withColumn("k", F.lit("b"))), "p", "y", keys=["k"])
    rows = {r.k: r for r in two.collect()}
    assert rows["a"].roc_auc == pytest.approx(want["roc_auc"]) and rows["b"].roc_auc is None and rows["b"].mean is None and rows["b"].recall == pytest.approx(want["recall"])


def test_bootstrap_against_resampled_rows(spark):
    y, p, df = scores(spark)
    got = {r.metric: r for r in V.bootstrap(df, "p", "y", resamples=600, ranges=16).collect()}
    again = {r.metric: r for r in V.bootstrap(df.repartition(9), "p", "y", resamples=600, ranges=16).collect()}
    rng = np.random.default_rng(1)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    each = []
    for _ in range(300):
        i = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        each.append(plain(y[i], p[i]))
    point = plain(y, p)
    for m in V.METRICS:
        v = np.array([e[m] for e in each])
        r = got[m]
        assert abs(r.mean - v.mean()) < 3 * math.hypot(v.std(ddof=1) / math.sqrt(300), r.sd / math.sqrt(600))
        assert r.sd == pytest.approx(v.std(ddof=1), rel=0.25) and r.point == pytest.approx(point[m])
        assert r.upper - r.mean == pytest.approx(r.margin) and r.margin == pytest.approx(1.9639 * r.sd / math.sqrt(600), rel=1e-3)
        assert again[m].mean == pytest.approx(r.mean, abs=1e-12)
    assert V.bootstrap(df.where("y = 1"), "p", "y", resamples=5).count() == 0
