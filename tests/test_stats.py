"""Metrics, calibration, bootstrap and feature filters against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import models as M
from tidegauge.operators import stats as S
from tidegauge.operators.aggregate import bias_report, concentration, weighted_sample


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(9)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    return pd.DataFrame({"id": np.arange(300), "p": p, "y": y, "w": rng.random(300) + 0.1})


def test_weighted_auc(spark, scored, tiny_slices):
    got = S.weighted_auc(spark.createDataFrame(scored), [], "y", "p", "w").first()[0]
    pos, neg = scored[scored.y == 1], scored[scored.y == 0]
    gap = pos["p"].to_numpy()[:, None] - neg["p"].to_numpy()[None]
    mass = pos["w"].to_numpy()[:, None] * neg["w"].to_numpy()[None]
    assert got == pytest.approx((((gap > 0) + 0.5 * (gap == 0)) * mass).sum() / mass.sum())


def test_one_class_has_no_auc(spark):
    frame = spark.createDataFrame([(1, 0.4, 1.0)], "y int, p double, w double")
    assert S.weighted_auc(frame, [], "y", "p", "w").first()[0] is None
    assert S.youden(frame, [], "y", "p", "w").first()["threshold"] == 0.5


def test_calibration_edges_follow_linspace(spark):
    p = [0.0, 0.1, 0.3, 0.6, 0.7, 1.0]
    got = [r["b"] for r in spark.createDataFrame([(x,) for x in p], "p double").select(S.bin_of(F.col("p"), 10).alias("b")).collect()]
    want = np.clip(np.digitize(p, np.linspace(0, 1, 11)) - 1, 0, 9)
    assert got == want.tolist()


def test_ks_statistic(spark, scored, tiny_slices):
    frame = spark.createDataFrame(scored)
    got = S.two_sample_ks(frame, [], "p", F.col("y") == 1).first()
    a, b = np.sort(scored[scored.y == 1]["p"]), np.sort(scored[scored.y == 0]["p"])
    grid = np.union1d(a, b)
    want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
    assert got["ks_stat"] == pytest.approx(want) and 0 <= got["ks_p"] <= 1


def test_bootstrap_brackets_the_point_and_ignores_partitioning(spark):
    rng = np.random.default_rng(2)
    truth = rng.normal(6, 1, 500)
    pdf = pd.DataFrame({"id": np.arange(500), "t": truth, "q": truth + rng.normal(0, 0.5, 500), "w": 1.0})
    frames = [spark.createDataFrame(pdf).repartition(n) for n in (1, 6)]
    draws = [S.bootstrap_regression(f, "id", "t", "q", "w", 200, 42).toPandas().sort_values("replicate") for f in frames]
    assert np.allclose(draws[0]["rmse"], draws[1]["rmse"])
    ci = S.percentile_interval(spark.createDataFrame(draws[0]), ["rmse"]).first()
    assert ci["low"] < np.sqrt(((pdf.t - pdf.q) ** 2).mean()) < ci["high"]


def test_poisson_draws_have_unit_mean():
    d = S.poisson_draws(np.arange(20000), 8, 1)
    assert d.mean() == pytest.approx(1.0, abs=0.01) and d.var() == pytest.approx(1.0, abs=0.03)


def test_concentration_matches_direct_gini(spark, tiny_slices):
    sizes = [1, 1, 1, 2, 2, 5, 9, 40]
    rows = [(f"g{i}",) for i, s in enumerate(sizes) for _ in range(s)]
    got = concentration(spark.createDataFrame(rows, "g string"), "g", {"half": 0.5, "most": 0.9}).first()
    v = np.sort(sizes)
    cum = np.cumsum(v)
    assert got["gini"] == pytest.approx((len(v) + 1 - 2 * cum.sum() / cum[-1]) / len(v))
    down = np.cumsum(v[::-1]) / v.sum()
    assert got["half"] == int(np.argmax(down >= 0.5)) + 1 and got["most"] == int(np.argmax(down >= 0.9)) + 1


def test_weighted_sample_is_exact_in_size_and_prefers_weight(spark, tiny_slices):
    frame = spark.range(400).withColumn("w", F.when(F.col("id") < 100, 10.0).otherwise(0.1))
    out = weighted_sample(frame, spark.createDataFrame([(80,)], "n bigint"), F.col("w"), "id", 7).toPandas()
    assert len(out) == 80 and (out["id"] < 100).mean() > 0.8


def test_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) * [1, 2, 3, 1, 1]
    x[:, 4] = 1.0
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "vector": [r.tolist() for r in x]}))
    got = M.mahalanobis(frame, frame, "vector").toPandas().sort_values("id")
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    d = np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.pinv(np.cov(z.T, ddof=0)), z))
    assert np.allclose(got["distance"], d, atol=1e-6)
    assert (got["in_domain"].to_numpy() == (d <= np.percentile(d, 97.5) + 1e-12)).mean() > 0.99


def test_correlation_and_inflation_prune():
    base = np.array([[1, .99, .1, .1], [.99, 1, .1, .1], [.1, .1, 1, .96], [.1, .1, .96, 1]])
    assert M.correlation_prune(base, 0.95) == [0, 2]
    assert M.inflation_prune(base, 10.0) in ([1, 3], [0, 2], [0, 3], [1, 2])


def test_ridge_stability_ranks_the_signal_first(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    pdf = pd.DataFrame({"id": np.arange(300), "vector": [r.tolist() for r in x], "y": 3 * x[:, 2] + rng.normal(0, 0.3, 300)})
    got = M.ridge_stability(spark.createDataFrame(pdf), "id", "vector", "y", resamples=8).orderBy(F.desc("stability")).first()
    assert got["feature"] == 2


def test_isotonic_is_monotone_and_platt_is_bounded(spark, scored):
    frame = spark.createDataFrame(scored)
    out = M.platt(frame, M.isotonic(frame, frame, "y", "p", "w"), "y", "p", "w").orderBy("p").toPandas()
    assert (out["p_isotonic"].diff().dropna() >= -1e-12).all() and out["p_platt"].between(0, 1).all()


def test_root_cause_order(spark):
    row = spark.range(1).select(
        M.root_cause(F.lit(0.9), F.lit(True), F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(0.9), F.lit(True)).alias("a"),
        M.root_cause(F.lit(0.1), F.lit(True), F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(0.9), F.lit(False)).alias("b"),
        M.root_cause(F.lit(0.1), F.lit(False), F.lit(0.1), F.lit(0.5), F.lit(0.0), F.lit(0.1), F.lit(False)).alias("c")).first()
    assert tuple(row) == ("resolved", "feature_collision", "model_averaging")


def test_bootstrap_auc_is_the_weighted_auc_of_its_draws(spark):
    rng = np.random.default_rng(5)
    n = 700
    pdf = pd.DataFrame({"id": np.arange(n), "y": rng.integers(0, 2, n), "p": np.round(rng.random(n), 1), "w": rng.random(n) + 0.1})
    frame = spark.createDataFrame(pdf).repartition(5)
    got = S.bootstrap_auc(frame, "id", "y", "p", "w", 40, 9).toPandas().set_index("replicate")["roc_auc"]
    weights = S.poisson_draws(pdf["id"].to_numpy(), 40, 9) * pdf["w"].to_numpy()[:, None]
    pos, neg = pdf["y"].to_numpy() == 1, pdf["y"].to_numpy() == 0
    p = pdf["p"].to_numpy()
    above = (p[pos][:, None] > p[neg][None, :]) + 0.5 * (p[pos][:, None] == p[neg][None, :])
    for k in range(40):
        a, b = weights[pos, k], weights[neg, k]
        assert got[k] == pytest.approx(a @ above @ b / (a.sum() * b.sum()))


def test_draws_pick_from_the_table_in_little_room():
    """Drawn for all rows at once, they took four times the room of the result."""
    import tracemalloc

    ids = np.arange(-3000, 5000) * 7919
    with np.errstate(over="ignore"):
        base = S._mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(9))
        bits = S._mix(base[:, None] + np.arange(1, 252, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    want = S._POISSON[bits.view(np.uint16)][:, :1001]
    tracemalloc.start()
    got = S.poisson_draws(ids, 1001, 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and peak < 2 * got.size


def test_bias_report_corrects_and_clips(spark):
    """The shifts were found but never taken off; a source without anchors has shift 0."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"key": rng.integers(0, 40, 300), "source": rng.choice(["a", "b", "c"], 300), "x": rng.normal(7, 4, 300).round(2)})
    rows = pd.concat([rows, pd.DataFrame({"key": [900, 901, 902], "source": ["alone"] * 3, "x": [1.0, 5.0, 13.0]})])
    got = bias_report(spark.createDataFrame(rows), "key", "source", "x").toPandas().set_index("source")
    anchored = rows[rows.groupby("key")["source"].transform("nunique") >= 2].copy()
    anchored["d"] = anchored["x"] - anchored.groupby("key")["x"].transform("median")
    shift = anchored.groupby("source")["d"].median()
    assert got.loc["alone", ["shift", "n_anchors", "corrected_min", "corrected_max"]].tolist() == [0.0, 0, 2.0, 12.0]
    for source, held in rows.groupby("source"):
        fixed = (held["x"] - shift.get(source, 0.0)).clip(2, 12)
        line = got.loc[source]
        assert line["shift"] == pytest.approx(shift.get(source, 0.0)) and line["n_corrected"] == len(held)
        assert line[["corrected_mean", "corrected_min", "corrected_max"]].tolist() == pytest.approx([fixed.mean(), fixed.min(), fixed.max()])
