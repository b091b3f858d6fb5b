"""Runs that resume, calibration by groups, evaluation files and Boruta, on generated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import learning as L
from tidemark.operators import training as T


@pytest.fixture(scope="module")
def nights(spark):
    """40 people of 5 nights; two features tell the label, with noise, and one doesn't."""
    rng = np.random.default_rng(12)
    rows = []
    for who in range(40):
        y = who % 2
        for n in range(5):
            rows.append((f"p{who}", who * 10 + n, n, float(y), *map(float, (rng.normal() + 1.5 * y, rng.normal() - y, rng.normal()))))
    return spark.createDataFrame(rows, "who string, row long, night int, y double, a double, b double, c double").repartition(3, "row").cache()


def test_calibration_by_group_folds(nights, monkeypatch):
    seen, real_fit, real_calibrator = [], T.fit, T.calibrator
    people = lambda d: {r.who for r in d.select("who").distinct().collect()}
    monkeypatch.setattr(T, "fit", lambda d, *a, **k: (seen.append(("model", people(d))), real_fit(d, *a, **k))[1])
    monkeypatch.setattr(T, "calibrator", lambda d, *a, **k: (seen.append(("calibrator", people(d))), real_calibrator(d, *a, **k))[1])
    rows = nights.withColumn("w", F.lit(1.0))
    train, test = rows.where(~F.col("who").isin("p0", "p1", "p2", "p3", "p4", "p5", "p6", "p7")), rows.where(F.col("who").isin("p0", "p1", "p2", "p3", "p4", "p5", "p6", "p7"))
    for method in ("sigmoid", "isotonic"):
        seen.clear()
        model = T.calibrate_out_of_fold(train, "who", "svm", ["a", "b"], "y", {"regParam": 0.001}, method=method, weight="w")
        models, calibrators = [s for k, s in seen if k == "model"], [s for k, s in seen if k == "calibrator"]
        assert len(models) == len(calibrators) == 3 and all(not a & b and len(a | b) == 32 for a, b in zip(models, calibrators))
        raw = V.brier_ece(L.probabilities(real_fit(train, "svm", ["a", "b"], "y", {"regParam": 0.001}), test), "prob", "y").first().brier
        out = model.transform(test)
        assert out.columns == [*test.columns, "prob"]
        assert V.brier_ece(out, "prob", "y").first().brier < raw
    with pytest.raises(ValueError, match="both labels"):
        T.calibrate_out_of_fold(train.where("y = 1"), "who", "lr", ["a"], "y", {})
    with pytest.raises(ValueError, match="unknown"):
        T.calibrate_out_of_fold(train, "who", "lr", ["a"], "y", {}, method="none")


def test_a_killed_run_goes_on_without_fitting_finished_folds(nights, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/run"
    options = {"repeats": 2, "outer": 2, "inner": 2, "trials": 1}
    run = lambda **k: T.nested_runs(nights, path, "who", "lr", ["a", "b", "c"], "y", **(options | k))
    fits, real = [], T.fit

    def killed(*a, **k):
        fits.append(1)
        if len(fits) == 3:
            raise RuntimeError("killed")
        return real(*a, **k)

    monkeypatch.setattr(T, "fit", killed)
    with pytest.raises(RuntimeError, match="killed"):
        run()
    assert len(fits) == 3
    out = run()
    assert len(fits) == 5  # the third fold again, and the fourth
    rows = out.collect()
    assert sorted((r.repeat, r.outer_fold, r.level) for r in rows) == sorted((r, k, lv) for r in range(2) for k in range(2) for lv in ("night", "patient"))
    assert min(r.roc_auc for r in rows) > 0.8 and {r.level: 1 for r in T.run_summary(out).collect()} == {"night": 1, "patient": 1}
    run()
    assert len(fits) == 5
    with pytest.raises(ValueError, match="other arguments"):
        run(seed=5)
    monkeypatch.setattr(T, "fit", real)
    # An undisturbed run of the first repeat alone has its seeds, and so its rows.
    whole = T.nested_runs(nights, f"{path}2", "who", "lr", ["a", "b", "c"], "y", **(options | {"repeats": 1}))
    key = lambda r: (r.repeat, r.outer_fold, r.level)
    for a, b in zip(sorted((r for r in rows if r.repeat == 0), key=key), sorted(whole.collect(), key=key), strict=True):
        assert a.setting == b.setting and a.roc_auc == pytest.approx(b.roc_auc)


def test_boosted_trees_stop_early(nights):
    slow = {"maxIter": 30, "maxDepth": 3, "stepSize": 0.3, "seed": 1}
    early = T.fit(nights, "gbt", ["a", "b", "c"], "y", slow, "who", 0.3)
    assert early.stages[-1].getNumTrees < T.fit(nights, "gbt", ["a", "b", "c"], "y", slow).stages[-1].getNumTrees == 30


def test_evaluation_files(spark, nights, tmp_path):
    scored = nights.withColumn("p", 1 / (1 + F.exp(-(F.col("a") - 0.75))))
    path = f"file://{tmp_path}/e"
    for _ in range(2):  # a second run replaces the first
        T.evaluate(scored, path, "who", "night", "p", "y", 0.5, 0.5, resamples=50)
    read = lambda n: spark.read.json(f"{path}/{n}")
    row = read("night_scores").first()
    assert row.tp + row.fn == 100 and row.tn + row.fp == 100 and row.recall == pytest.approx(row.tp / 100)
    assert read("patient_scores").first().tp + read("patient_scores").first().fn == 20
    assert {r.metric for r in read("patient_intervals").collect()} == set(V.METRICS)
    assert read("curves").groupBy("level", "curve").count().collect()[0]["count"] == 100 and read("curves").count() == 400
    assert read("wrong_nights").agg(F.sum("wrong")).first()[0] == row.fp + row.fn
    assert read("nights").count() == 200 and read("patients").count() == 40 and read("diagnostics").first().brier < 0.25


def test_permuted_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("x"), (F.col("id") * 3).alias("z")).repartition(5)
    a = {r.id: (r.shadow_x, r.shadow_z) for r in T.permuted(df, "id", ["x", "z"], 1).collect()}
    assert sorted(v[0] for v in a.values()) == [2 * i for i in range(1000)] and all(v[0] * 3 == v[1] * 2 for v in a.values())
    assert a == {r.id: (r.shadow_x, r.shadow_z) for r in T.permuted(df.repartition(2), "id", ["x", "z"], 1).collect()}
    assert abs(np.corrcoef(list(a), [v[0] for v in a.values()])[0, 1]) < 0.1 and a != {r.id: (r.shadow_x, r.shadow_z) for r in T.permuted(df, "id", ["x", "z"], 2).collect()}


def test_boruta_takes_planted_features_and_leaves_noise(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 5))
    x[:, 1] += 1.5 * y
    x[:, 3] -= 1.2 * y
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(400)], "id long, y int, f0 double, f1 double, f2 double, f3 double, f4 double")
    features = [f"f{i}" for i in range(5)]
    got = {r.feature: r for r in T.boruta(df, "id", features, "y", repeats=9, trees=15).collect()}
    assert {f for f, r in got.items() if r.decision == "accepted"} == {"f1", "f3"} and all(got[f].hits <= 5 for f in ("f0", "f2", "f4"))
    for r in got.values():
        few = T.binomial_tail(9, 9 - r.hits) < 0.05 / 5
        assert r.decision == ("accepted" if r.hits == 9 else "rejected" if few else "tentative") and r.repeats == 9
    assert {got["f1"].rank, got["f3"].rank} == {1, 2}
    again = {r.feature: r for r in T.boruta(df.repartition(3), "id", features, "y", repeats=1, trees=15).collect()}
    same = {r.feature: r for r in T.boruta(df, "id", features, "y", repeats=1, trees=15).collect()}
    assert {f: (r.hits, r.importance) for f, r in again.items()} == {f: (r.hits, r.importance) for f, r in same.items()}
    assert T.binomial_tail(9, 9) == 1 / 512 and T.binomial_tail(4, 0) == 1


def test_boruta_depends_on_the_rows_alone(spark):
    """Files come back in the order of their sizes: a forest's samples must not follow it, nor how the rows were dealt before."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, i % 2, *map(float, rng.normal(size=3) + [i % 2, 0, 0])) for i in range(300)], "id long, y int, f0 double, f1 double, f2 double")
    tables = (df, df.repartition(3), df.orderBy(F.desc("id")))
    got = [sorted(T.boruta(d, "id", ["f0", "f1", "f2"], "y", repeats=1, trees=9).collect()) for d in tables]
    assert got[0] == got[1] == got[2]
