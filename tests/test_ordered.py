"""Order statistics against NumPy, with tiny slices, ties and a dominant key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import dedup as D
from tidegauge.operators import ordered as O


def skewed(n=400, seed=3):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))
    return pd.DataFrame({"id": np.arange(n), "k": key, "v": np.round(rng.normal(6, 1.2, n), 1), "w": rng.random(n) + 0.01})


def test_quantiles_match_numpy(spark, tiny_slices):
    pdf = skewed()
    levels = {"q10": 0.1, "med": 0.5, "q99": 0.99}
    got = O.quantiles(spark.createDataFrame(pdf), ["k"], "v", levels).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for name, q in levels.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(g["v"], q))


def test_weighted_median_is_first_value_at_half_weight(spark, tiny_slices):
    pdf = skewed()
    got = O.ladder(spark.createDataFrame(pdf), ["k"], "v", F.col("w")).groupBy("k").agg(O.at_weighted_median().alias("m")).toPandas().set_index("k")["m"]
    for k, g in pdf.groupby("k"):
        s = g.groupby("v")["w"].sum().sort_index()
        assert got[k] == s.index[np.searchsorted(s.cumsum().to_numpy(), s.sum() / 2)]


def test_mad_is_zero_for_single_values(spark, tiny_slices):
    pdf = pd.concat([skewed(), pd.DataFrame({"id": [9999], "k": [77], "v": [5.0], "w": [1.0]})])
    got = O.group_mad(spark.createDataFrame(pdf), ["k"], "v", 1.4826).toPandas().set_index("k")["mad"]
    assert got[77] == 0.0
    for k, g in pdf.groupby("k"):
        if len(g) > 1:
            assert got[k] == pytest.approx(1.4826 * (g["v"] - g["v"].median()).abs().median())


@pytest.mark.parametrize("partitions", [1, 5])
def test_positions_are_dense_and_deterministic(spark, tiny_slices, partitions):
    pdf = skewed()
    got = O.positions(spark.createDataFrame(pdf).repartition(partitions), ["k"], "v", "id").toPandas().set_index("id")["pos"]
    want = pdf.sort_values(["k", "v", "id"]).groupby("k").cumcount()
    assert (got.sort_index() == want.set_axis(pdf.sort_values(["k", "v", "id"])["id"]).sort_index()).all()


def test_one_giant_tie_is_still_ordered(spark, tiny_slices):
    pdf = pd.DataFrame({"id": np.arange(200), "k": 1, "v": 1.0})
    got = O.positions(spark.createDataFrame(pdf), ["k"], "v", "id").toPandas().sort_values("id")
    assert got["pos"].tolist() == list(range(200))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_string_ids_and_any_number_of_ranges(spark, monkeypatch, parts):
    monkeypatch.setattr(O, "PARTS", parts)
    pdf = skewed()
    pdf["id"] = "IK" + pdf["id"].astype(str)
    got = O.positions(spark.createDataFrame(pdf), ["k"], "v", "id").toPandas().set_index("id")["pos"].sort_index()
    ordered = pdf.sort_values(["k", "v", "id"])
    want = ordered.groupby("k").cumcount().set_axis(ordered["id"]).sort_index()
    assert (got == want).all()


def test_average_ranks(spark, tiny_slices):
    pdf = skewed()
    got = O.average_ranks(spark.createDataFrame(pdf), ["k"], "v", "r").toPandas().set_index("id")["r"].sort_index()
    assert got.to_numpy() == pytest.approx(pdf.groupby("k")["v"].rank().to_numpy())


@pytest.mark.parametrize("size,wanted", [(1, 1), (10, 1), (10, 10), (97, 13), (100, 0)])
def test_linspace_hits(spark, size, wanted):
    frame = spark.range(size).withColumnRenamed("id", "p")
    got = [r["p"] for r in frame.filter(D.linspace_hit(F.col("p"), F.lit(size), F.lit(wanted))).orderBy("p").collect()]
    want = sorted({(i * (size - 1)) // (wanted - 1) for i in range(wanted)}) if wanted > 1 else ([0] if wanted else [])
    assert got == want


def test_quantile_bins_match_qcut(spark, tiny_slices):
    pdf = skewed()
    got = D.quantile_bins(spark.createDataFrame(pdf), "v", 5, "b").toPandas().set_index("id")["b"].sort_index()
    assert (got.to_numpy() == pd.qcut(pdf["v"], 5, labels=False, duplicates="drop").to_numpy()).all()


def test_priority_dedup(spark):
    rows = [("a", "undefined", 9.0, 0), ("a", "defined", 1.0, 1), ("b", "achiral", 1.0, 2), ("b", "achiral", 2.0, 3), ("c", "?", None, 4)]
    frame = spark.createDataFrame(rows, "k string, flag string, w double, ord int")
    kept = {r["k"]: r["ord"] for r in D.dedup_by_priority(frame, "k", "flag", "w", "ord", max_loss=0.5).collect()}
    assert kept == {"a": 1, "b": 3, "c": 4}
    with pytest.raises(RuntimeError, match="dedup would remove"):
        D.dedup_by_priority(frame, "k", "flag", "w", "ord", max_loss=0.25)


def test_outlier_flags_small_groups(spark):
    rows = [(1, 5.0), (1, 5.1), (1, 5.0), (1, 9.0), (2, 4.0), (2, 6.0), (3, 1.0)]
    out = D.outlier_flags(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").toPandas()
    assert out[(out.k == 1) & (out.v == 9.0)]["is_iqr_outlier"].item()
    assert not out[out.k == 2]["is_iqr_outlier"].any()
    assert out[out.k == 3]["is_iqr_outlier"].isna().all()


def test_totals_are_rounded_as_running_sums_are(spark):
    """Half of a total is compared with running sums: weights 0.1 to 0.7 sum to other doubles in other orders."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(k, float(v), float(w)) for k in range(400) for v, w in enumerate(rng.integers(1, 8, 9) / 10)], columns=["k", "v", "w"])
    mixed = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(6)
    got = O.running_totals(mixed, ["k"], "v", ["w"]).toPandas()
    last = got[got.v == 8].set_index("k")
    want = pdf.groupby("k")["w"].apply(lambda w: w.cumsum().iloc[-1])
    # a key at the edge of two ranges adds up in two steps
    assert ((last["cum_w"] == last["all_w"]) & (last["all_w"] == want)).sum() >= 392
    assert (last["all_w"] - want).abs().max() < 1e-12
