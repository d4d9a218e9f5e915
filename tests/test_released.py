"""Released weight, gated domain and bootstrap agreement against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge import all_queries
from tidegauge.operators import domain as D
from tidegauge.operators import stats as S
from tidegauge.operators.weights import released_weight
from tidegauge.plans.curation import with_novelty


def prints(rng, n, width=24):
    return (rng.random((n, width)) < 0.4).astype(float)


def similarities(a, b):
    dot = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - dot
    return np.divide(dot, union, out=np.zeros_like(dot), where=union > 0)


def frame_of(spark, x, first=0, name="id"):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(first, first + len(x)), "vector": [r.tolist() for r in x]}))


def test_released_weight_and_its_defaults(spark):
    names = ["novelty", "diversity", "complexity", "consensus", "resolution", "stereo_penalty"]
    rows = [(0.8, 0.5, 0.2, 0.4, 0.6, 0.7, 0.5, 0.8, 0.3), (0.8, 0.5, 0.2, *[None] * 6), (0.9, 1.0, 0.1, 0.2, 0.1, 0.3, 1.0, 0.0, 2.0)]
    frame = spark.createDataFrame(rows, "f double, d double, u double, " + ", ".join(f"{n} double" for n in names))
    base = [F.col(c) for c in "fdu"]
    got = [r[0] for r in frame.select(released_weight(*base, **{n: F.col(n) for n in names})).collect()]
    assert got[0] == pytest.approx(0.8 * 0.5 * 0.8 * 1.08 * 1.06 * 1.035 * 1.075 * 1.08 * 0.82)
    assert got[1] == pytest.approx(0.8 * 0.5 * 0.8 * 1.1 * 1.05 * 1.015)
    assert got[2] == 0
    bare = [r[0] for r in frame.select(released_weight(*base)).collect()]
    assert bare[1] == got[1]
    with pytest.raises(ValueError):
        released_weight(*base, size=F.lit(1))


def test_novelty_counts_copies_and_leaves_rows_without_print(spark):
    x = prints(np.random.default_rng(3), 60)
    x[1] = x[2] = x[0]
    frame = frame_of(spark, x, name="row_id").withColumnRenamed("vector", "fingerprint")
    bare = spark.createDataFrame([(100, None)], frame.schema)
    got = {r.row_id: r.novelty for r in with_novelty(frame.unionByName(bare)).collect()}
    s = similarities(x, x)
    np.fill_diagonal(s, -1)
    want = 1 - np.sort(s, axis=1)[:, -5:].mean(axis=1)
    assert got.pop(100) is None
    assert np.allclose([got[i] for i in range(60)], want, atol=1.01e-4)
    assert {r.novelty for r in with_novelty(frame.limit(1)).collect()} == {None}


def test_gated_domain_adds_its_fifth(spark):
    rng = np.random.default_rng(8)
    train, query = prints(rng, 80, 12), np.vstack([prints(rng, 30, 12), np.ones((1, 12)), np.zeros((1, 12))])
    train[:, 3] = 1.0  # a feature that never varies
    train[:, 5] = train[:, 6]  # and two that are one: the covariance has no inverse
    got = D.gated_domain(frame_of(spark, train), frame_of(spark, query, 1000)).toPandas().set_index("id").sort_index()
    mean, scale = train.mean(0), np.where(train.std(0) > 0, train.std(0), 1)
    z, zq = (train - mean) / scale, (query - mean) / scale
    inverse = np.linalg.pinv(np.cov(z.T, ddof=0), hermitian=True)
    reach = lambda v: np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", v, inverse, v), 0))
    d = reach(zq)
    inside = d <= np.percentile(reach(z), 97.5)
    assert np.allclose(got["gate_distance"], d, atol=1e-6) and (got["gate_in_domain"].to_numpy() == inside).all() and 0 < inside.sum() < len(inside)
    top = np.sort(similarities(query, train), axis=1)[:, ::-1]
    mean5, density = top[:, :5].mean(1), (top[:, :10] > 0).mean(1) * top[:, :10].mean(1)
    score = np.minimum(mean5 / 0.35, 1) * 0.5 + np.minimum(density / max(density.mean(), 1e-6), 1) * 0.3 + inside * 0.2
    assert np.allclose(got["score"], np.clip(score, 0, 1), atol=1e-6)
    few = D.gated_domain(frame_of(spark, train[:9]), frame_of(spark, query, 1000)).toPandas()
    assert len(few) == len(query) and not few["gate_in_domain"].any() and few["gate_distance"].isna().all()


def test_knn_ad_counts_the_gate(spark, tmp_path):
    """Its score left the distance gate's fifth out."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 64)], i % 10) for i in range(1600)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    plain, gated = (all_queries()[q](spark, str(tmp_path)).toPandas().set_index("id").sort_index() for q in ("knn_ad", "knn_ad_gated"))
    similar = np.minimum(plain["nn_similarity"] / 0.35, 1) * 0.5
    dense = np.minimum(plain["local_density"] / plain["local_density"].mean(), 1) * 0.3
    assert 0 < gated["gate_in_domain"].sum() < len(gated) == len(plain)
    assert np.allclose(plain["score"], similar + dense + 0.2 * gated["gate_in_domain"], atol=1e-4)


def test_agreement_of_point_and_interval(spark):
    points = spark.createDataFrame(
        [("a", "r2", 0.50), ("b", "r2", 0.50), ("c", "r2", 0.40), ("a", "roc_auc", 0.80), ("a", "mae", 1.0), ("d", "r2", None)], "cell string, metric string, point double")
    intervals = spark.createDataFrame(
        [("a", "r2", 0.4, 0.54, 0.6), ("b", "r2", 0.1, 0.44, 0.7), ("a", "roc_auc", 0.7, 0.84, 0.9), ("a", "mae", 0.1, 5.0, 9.0), ("d", "r2", 0.1, 0.2, 0.3)],
        "cell string, metric string, low double, mid double, high double")
    cells = S.interval_agreement(points, intervals, ["cell"], {"r2": 0.05, "roc_auc": 0.03})
    got = {(r.cell, r.metric): (r.agrees, r.width and round(r.width, 9)) for r in cells.collect()}
    assert got == {("a", "r2"): (True, 0.2), ("b", "r2"): (False, 0.6), ("c", "r2"): (None, None), ("a", "roc_auc"): (False, 0.2), ("a", "mae"): (True, 8.9), ("d", "r2"): (None, 0.2)}
    audit = {(r.check, r.metric): r for r in S.agreement_audit(cells).collect()}
    assert (audit["interval_present", None].verdict, audit["interval_present", None].n_bad) == ("WARN", 1)
    assert (audit["point_near_middle", None].verdict, audit["point_near_middle", None].n, audit["point_near_middle", None].n_bad) == ("WARN", 4, 2)
    wide = audit["interval_width", "r2"]
    assert (wide.verdict, wide.n, round(wide.low, 9), round(wide.mid, 9), round(wide.high, 9)) == ("INFO", 3, 0.2, 0.2, 0.6)
    clean = {r.check: r.verdict for r in S.agreement_audit(cells.filter("cell = 'a' AND metric = 'r2'")).collect()}
    assert clean == {"interval_present": "PASS", "point_near_middle": "PASS", "interval_width": "INFO"}
