"""A model per key against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ridge

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    parts = []
    for key, n, w in (("x", 900, (2.0, -1.0, 0.0)), ("y", 300, (0.0, 0.5, 100.0)), ("z", 40, (1.0, 1.0, 1.0))):
        p = pd.DataFrame(rng.normal(size=(n, 3)) * (1, 50, 0.01) + (1e6, 0, 3), columns=FEATURES)
        p["y"] = p[FEATURES].to_numpy() @ np.array(w) + 7 + rng.normal(size=n) * 0.3
        p["period"] = np.where(np.arange(n) < n * 0.6, "fit", np.where(np.arange(n) < n * 0.8, "calib", "test"))
        p["k"] = key
        parts.append(p)
    pdf = pd.concat(parts, ignore_index=True)
    rows = [(r.k, r.period, r.y, r.a, r.b, r.c, 5.0) for r in pdf.itertuples()]
    rows += [("x", "fit", None, 1.0, 1.0, 1.0, 5.0), ("x", "fit", 1e9, None, 1.0, 1.0, 5.0), ("only", "test", 1.0, 1.0, 1.0, 1.0, 5.0)]
    return pdf, spark.createDataFrame(rows, "k string, period string, y double, a double, b double, c double, flat double").repartition(5)


def plain(p, path):
    fit, calib = p[p.period == "fit"], p[p.period == "calib"]
    m, s = fit[FEATURES].mean(), fit[FEATURES].std(ddof=0)
    z = ((fit[FEATURES] - m) / s).to_numpy()
    best = (np.inf,)
    for penalty in path:
        w = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(3), z.T @ (fit.y - fit.y.mean()).to_numpy() / len(z)) / s.to_numpy()
        b = fit.y.mean() - w @ m.to_numpy()
        error = ((calib.y - b - calib[FEATURES].to_numpy() @ w) ** 2).mean()
        best = min(best, (error, penalty, b, w), key=lambda x: x[0])
    return best


def test_models_of_all_keys(frame):
    pdf, df = frame
    models = {r.k: r for r in ridge.fit_ridge(df, FEATURES, "y", ["k"]).collect()}
    assert set(models) == {"x", "y", "z"}
    for k, p in pdf.groupby("k"):
        error, penalty, b, w = plain(p, ridge.PATH)
        m = models[k]
        assert m.penalty == pytest.approx(penalty) and m.calib_mse == pytest.approx(error, rel=1e-6)
        np.testing.assert_allclose(m.weights, w, rtol=1e-6)
        assert m.intercept == pytest.approx(b, rel=1e-6)
    out = ridge.predict_ridge(ridge.fit_ridge(df, FEATURES, "y", ["k"]), df, FEATURES, ["k"])
    assert out.count() == df.count() and out.where("k = 'only' AND pred IS NOT NULL").isEmpty()
    off = out.where("period = 'test' AND k <> 'only'").agg(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0]
    assert off < 2


def test_features_that_do_not_vary_or_repeat(frame):
    pdf, df = frame
    one = df.where("k = 'x'").withColumn("again", F.col("a"))
    model = ridge.fit_ridge(one, ["a", "flat", "again"], "y", path=(0.0,)).first()
    assert model.weights[1] == 0.0 and model.weights[0] == pytest.approx(model.weights[2], rel=1e-3)
    assert ridge.fit_ridge(df.where("false"), FEATURES, "y", ["k"]).count() == 0
    none = df.where("period <> 'calib'")
    assert {r.k for r in ridge.fit_ridge(none, FEATURES, "y", ["k"]).collect()} == {"x", "y", "z"}
