import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import learning as L
from tidemark.streaming import windows as ST


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("fold"), ((F.col("id") * 37) % 100 / 100).alias("a"), ((F.col("id") * 53) % 97 / 97).alias("b"))
    return df.withColumn("y", (F.col("a") + 0.3 * F.col("b") > 0.6).cast("double")).cache()


def test_models_separate_what_can_be_separated(rows):
    out = L.cross_validate(rows, "fold", "lr", ["a", "b"], "y", {"regParam": 0.0}).collect()
    assert len(out) == 3
    assert min(r.roc_auc for r in out) > 0.95


def test_prediction_levels_and_missing_features(rows):
    model = L.pipeline("svm", ["a", "b"], "y").fit(rows)
    nights = rows.withColumn("p", (F.col("id") % 10).cast("string"))
    assert L.predict(nights, model, ["a", "b"], "p", "id", "night").count() == 300
    assert L.predict(nights, model, ["a", "b"], "p", "id").count() == 10
    with pytest.raises(ValueError, match="missing"):
        L.predict(nights.drop("a"), model, ["a", "b"], "p", "id")


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_lowers_the_brier_score(rows, method):
    raw = rows.withColumn("p", F.col("a") * 0.5 + 0.25)
    out = L.calibrate(raw, "p", "y", method)(raw)
    assert V.brier_ece(out, "calibrated", "y").first().brier < V.brier_ece(raw, "p", "y").first().brier


def test_settings_and_names():
    assert len(L.settings("gbt")) == 27
    assert len(L.settings("gbt", 5)) == 5
    assert all(s["maxDepth"] == 2 for s in L.settings("gbt", fixed={"maxDepth": 2}))
    assert L.feature_names(["a", "b"], ["mean", "std"], ["g"], "aggregate") == ["a_mean", "b_mean", "a_std", "b_std", "g"]
    with pytest.raises(ValueError, match="unknown"):
        L.pipeline("none", [], "y")


def test_streaming_windows(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", 0.0 if s < 10 else float(s % 2)) for s in range(20)]
    df = spark.createDataFrame(rows, "k int, ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = ST.run_to_table(ST.stationary_windows(stream, "k", "ts", ["x"]), "still").orderBy("window").collect()
    assert [(r.n, r.still) for r in out] == [(10, True), (10, False)]
