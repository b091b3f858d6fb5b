import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import learning as L
from tidemark.operators import nights as N
from tidemark.operators import results as R
from tidemark.operators import thresholds as T


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i % 7, f"d{i % 2}", ((i * 37) % 11) / 10, int((i * 53) % 97 > 40)) for i in range(80)]
    return spark.createDataFrame(data, "who long, ds string, p double, y int").cache()


def plain_curves(rows):
    """False and true positive rates, and recall and precision, in order of falling score."""
    data = [(r.p, r.y) for r in rows.collect()]
    pos = sum(y for _, y in data)
    roc, pr = [(0.0, 0.0)], [(0.0, 1.0)]
    for t in sorted({p for p, _ in data}, reverse=True):
        tp, fp = sum(y for p, y in data if p >= t), sum(1 - y for p, y in data if p >= t)
        roc.append((fp / (len(data) - pos), tp / pos))
        pr.append((tp / pos, tp / (tp + fp)))
    return np.array(roc), np.array(pr), pos / len(data)


def test_curves_on_a_grid_are_interpolated_curves(rows):
    roc, pr, share = plain_curves(rows)
    x = np.linspace(0, 1, 100)
    tpr, precision = np.interp(x, *roc.T), np.interp(x, *pr.T)
    tpr[0], precision[0], precision[-1] = 0, 1, share
    c = V.curve(rows, "p", "y")
    assert [r.tpr for r in T.roc_on_grid(c).orderBy("i").collect()] == pytest.approx(tpr)
    assert [r.precision for r in T.pr_on_grid(c).orderBy("i").collect()] == pytest.approx(precision)


def test_thresholds_by_name(spark, rows):
    of = lambda df, name: T.choose_threshold(df, "p", "y", name, "ds").first().threshold
    assert [of(rows, n) for n in ("default", "0.3", "fixed:0.42", "FIXED_0.1")] == [0.5, 0.3, 0.42, 0.1]
    each = [of(rows.where(F.col("ds") == d), "roc_dist") for d in ("d0", "d1")]
    assert of(rows, "roc_dist_per_dataset_mean") == pytest.approx(np.mean(each))
    one_class = rows.union(rows.where("y = 1").withColumn("ds", F.lit("d2")))
    assert of(one_class, "roc_dist_per_dataset_mean") == pytest.approx(np.mean(each))
    assert [of(rows.limit(0), n) for n in ("pr_f1", "roc_dist", "roc_dist_per_dataset_mean")] == [None, None, None]
    nulls = rows.union(spark.createDataFrame([(1, "d0", None, 1), (1, "d0", 0.9, None)], rows.schema))
    assert of(nulls, "roc_dist") == of(rows, "roc_dist")
    with pytest.raises(ValueError, match="unknown"):
        of(rows, "best")


def test_seeds_are_unique_and_settings_typed():
    for seed, repeats, folds in ((0, 5, 5), (42, 1, 5), (7, 2, 20), (1, 3, 15), (123456789, 50, 50), (-3, 2, 2)):
        s = R.seed_schedule(seed, repeats, folds)
        assert len(s) == repeats and all(len(v) == folds for v in s.values())
        every = [*s, *(x for v in s.values() for x in v)]
        assert len(set(every)) == repeats * (folds + 1) and all(0 <= x < 1 << 31 for x in every)
        assert s == R.seed_schedule(seed, repeats, folds) and s != R.seed_schedule(seed + 1, repeats, folds)
    assert list(R.seed_schedule(5, 9, 3))[:4] == list(R.seed_schedule(5, 4, 8))
    space = {"numTrees": [20, 50], "stepSize": [0.05, 0.1], "kind": ["a", "b"]}
    assert R.format_setting({"numTrees": 31.6, "stepSize": 0.123456, "kind": "a", "x": 1}, space) == {"numTrees": 32, "stepSize": 0.1235, "kind": "a", "x": 1}
    with pytest.raises(ValueError, match="kind"):
        R.format_setting({"kind": "c"}, space)


def test_folds_are_summed_up(spark):
    f = spark.createDataFrame([("a", 0, 0.5, ["u", "v"]), ("a", 1, 0.7, ["u", "u"]), ("b", 2, None, [])], "ds string, fold int, f1 double, chosen array<string>")
    assert {(r.ds, r.n) for r in R.score_summary(f, ["f1"], ["ds"]).collect()} == {("a", 2), ("b", 0)}
    assert {(r.feature, r.n) for r in R.selection_frequency(f, "chosen").collect()} == {("u", 2), ("v", 1)}
    assert [r.fold for r in R.best_folds(f, "f1", "fold").collect()] == [1]
    assert {r.ds: r.f1 for r in R.leave_one_out_summary(f, "ds", ["f1"]).collect()} == {"a": pytest.approx(0.6), "b": None, "all": pytest.approx(0.6)}
    assert R.score_summary(f.limit(0), ["f1"]).count() == 0


def test_run_log_and_models(spark, rows, tmp_path):
    log = f"file://{tmp_path}/log"
    R.log_run(spark, log, "x", "begun", folds=5)
    R.log_run(spark, log, "x", "done", folds=5, f1=0.5)
    assert [(r.run, r.status, r.fields) for r in R.last_states(spark.read.parquet(log)).collect()] == [("x", "done", '{"folds":5,"f1":0.5}')]
    model = L.pipeline("lr", ["p"], "y").fit(rows)
    for _ in range(3):
        R.save_model(model, f"file://{tmp_path}/model", spark)
    assert {p.name for p in tmp_path.iterdir()} >= {"model", "model.back"}


def test_density_peaks(spark):
    """Three clusters: the outer ones lie at the ends and don't count."""
    mids = [0.0, 0.01, 0.45, 0.5, 0.5, 0.52, 0.99, 1.0]
    b = spark.createDataFrame([("a", int(m * 1e6), int(m * 1e6)) for m in mids] + [("flat", 5, 5)], "k string, start_us long, end_us long")
    row = N.kde_peaks(b, ["k"]).collect()
    x = np.linspace(0, 1, 400)
    density = np.exp(-0.5 * ((x[:, None] - np.array(mids)) / 0.04) ** 2).mean(1) / (0.04 * np.sqrt(2 * np.pi))
    valley = max(density[20:200].min(), density[200:380].min())
    assert [(r.k, r.kde_n_peaks) for r in row] == [("a", 1)]
    assert row[0].kde_max_prom == pytest.approx(density[100:300].max() - valley)
