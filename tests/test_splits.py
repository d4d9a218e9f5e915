"""Split invariants: disjoint groups, budgets, determinism, edge cases."""

import math

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import splits as S


@pytest.fixture(scope="module")
def compounds():
    rng = np.random.default_rng(42)
    sizes = 1.0 / np.arange(1, 81) ** 0.9
    group = rng.choice(80, 500, p=sizes / sizes.sum())
    return pd.DataFrame({"id": np.arange(500), "key": [f"IK{i:012d}" for i in range(500)], "scaffold": [f"SCAF_{g:03d}" for g in group],
                         "activity": np.round(rng.normal(6.5, 1.2, 500), 3)})


def by_split(pdf):
    return {s: set(g["id"]) for s, g in pdf.groupby("split")}


def test_scaffold_split_keeps_groups_whole(spark, compounds, tiny_slices):
    out = S.scaffold_split(spark.createDataFrame(compounds), "id", "scaffold", "activity").toPandas()
    assert len(out) == 500 and out["id"].is_unique
    assert (out.groupby("scaffold")["split"].nunique() == 1).all()
    cap = math.ceil(0.08 * math.ceil(0.15 * 500))
    assert out[out.split == "test"].groupby("scaffold").size().max() <= cap
    assert abs((out.split == "test").mean() - 0.15) < 0.10


def test_same_seed_same_assignment_for_any_partitioning(spark, compounds):
    one = S.scaffold_split(spark.createDataFrame(compounds), "id", "scaffold", "activity").toPandas().set_index("id")["split"]
    two = S.scaffold_split(spark.createDataFrame(compounds).repartition(7), "id", "scaffold", "activity").toPandas().set_index("id")["split"]
    assert one.sort_index().equals(two.sort_index())


def test_random_split_fractions(spark, compounds, tiny_slices):
    out = S.random_split(spark.createDataFrame(compounds), "id", "activity").toPandas()
    share = out["split"].value_counts(normalize=True)
    assert abs(share["test"] - 0.15) < 0.05 and abs(share["val"] - 0.10) < 0.05


def test_lead_split_shares_groups_but_not_keys(spark, compounds):
    out = S.lead_split(spark.createDataFrame(compounds), "id", "key", "scaffold", "activity").toPandas()
    train, test = out[out.split == "train"], out[out.split == "test"]
    assert set(train.scaffold) & set(test.scaffold)
    assert not set(train.key) & set(test.key)


def test_all_singletons_and_dominant_group(spark):
    single = spark.range(30).select("id", F.concat(F.lit("S"), "id").alias("scaffold"), (F.col("id") * 0.1).alias("activity"))
    assert len(by_split(S.scaffold_split(single, "id", "scaffold", "activity").toPandas())["test"]) == math.ceil(0.15 * 30)
    heavy = spark.range(100).select("id", F.when(F.col("id") < 80, "BIG").otherwise(F.concat(F.lit("S"), "id")).alias("scaffold"), (F.col("id") * 0.1).alias("activity"))
    out = S.scaffold_split(heavy, "id", "scaffold", "activity").toPandas()
    assert set(out[out.scaffold == "BIG"]["split"]) == {"train"}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id bigint, scaffold string, activity double")
    assert S.scaffold_split(empty, "id", "scaffold", "activity").count() == 0


def test_folds_cover_rows_and_balance(spark, compounds):
    out = S.scaffold_folds(spark.createDataFrame(compounds), "id", "scaffold", 5).toPandas()
    assert len(out) == 500 and (out.groupby("scaffold")["fold"].nunique() == 1).all()
    assert set(out["fold"]) == {0, 1, 2, 3, 4}


def test_deal_equals_step_by_step():
    rng = np.random.default_rng(0)
    for _ in range(50):
        deficits = [float(d) for d in rng.integers(-20, 200, 4)]
        size, count = int(rng.integers(1, 9)), int(rng.integers(0, 60))
        left, got = list(deficits), [0] * 4
        for _ in range(count):
            best = max(range(4), key=lambda i: (left[i], hashlib.md5(f"{size}|{i}|7".encode()).hexdigest()))
            got[best] += 1
            left[best] -= size
        assert S._deal(size, count, deficits, 7) == got


def test_cliff_split_votes_and_fallback(spark, compounds):
    frame = spark.createDataFrame(compounds)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 120, 2)], "src bigint, dst bigint")
    out, info = S.cliff_split(frame, pairs, "id", "scaffold", "activity")
    got = out.toPandas()
    assert len(got) == 500 and got["id"].is_unique and info["n_pairs_usable"] == 60
    act, split = compounds.set_index("id")["activity"], got.set_index("id")["split"]
    for a in range(0, 120, 2):
        lower, upper = (a, a + 1) if act[a] <= act[a + 1] else (a + 1, a)
        assert split[lower] == "test" and split[upper] == "train"
    assert (got.split == "test").sum() == 75 and (got.split == "val").sum() == 50
    _, info = S.cliff_split(frame, None, "id", "scaffold", "activity")
    assert info["fallback_reason"] == "no_file_provided"


def test_align_and_audit(spark, compounds):
    frame = spark.createDataFrame(compounds).withColumn("label", (F.col("activity") >= 6).cast("int"))
    base = S.stage(S.scaffold_split(frame.filter("id < 350"), "id", "scaffold", "activity"))
    out = S.stage(S.align_split(frame, base, "id", "scaffold", "label", group_only=True))
    assert out.count() == 500
    report = S.audit_split(out, "id", "scaffold", "activity").first()
    assert report["group_train_test_overlap"] == 0
    leaky = out.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    with pytest.raises(RuntimeError, match="leakage"):
        S.audit_split(leaky, "id", "scaffold", "activity")


def test_similarity_split_is_disjoint_by_cluster(spark):
    items = spark.range(200).select("id", F.array(*[F.concat(F.lit(f"x{k}-"), (F.col("id") / (3 + k)).cast("int")) for k in range(4)]).alias("tokens"))
    rows, info = S.adaptive_similarity_split(items, "tokens", cutoffs=(0.6, 0.4))
    got = rows.toPandas()
    assert len(got) == 200 and got["id"].is_unique and info["n_test"] <= info["test_budget"]


def test_similarity_split_tries_the_cutoffs_in_order(spark, monkeypatch):
    from tidegauge.plans import splits as plans

    def registered(items):
        monkeypatch.setattr(plans, "documents_as_sets", lambda t: items)
        return plans.similarity_split(None).toPandas()

    # pairs of ids share one of three tokens: a sound partition at the first cut-off
    pairs = spark.range(400).select("id", F.array(*[F.concat(F.lit(f"x{k}-"), (F.col("id") / 2).cast("int")) for k in range(3)]).alias("tokens"))
    got = registered(pairs)
    assert len(got) == 400 and set(got["cutoff"]) == {0.40} and not got["degenerate"].any()
    assert all(list(t) == [0.40] for t in got["tried"])
    # too few sets for a sound partition at any cut-off
    few = registered(pairs.filter("id < 40"))
    assert few["degenerate"].all() and all(list(t) == S.K.CLUSTER_CUTOFFS for t in few["tried"])


def test_written_pairs_give_the_same_clusters(spark):
    from tidegauge.operators.pairwise import similar_pairs, token_sets

    items = spark.range(120).select("id", F.array(*[F.concat(F.lit(f"x{k}-"), (F.col("id") / (2 + k)).cast("int")) for k in range(5)]).alias("tokens"))
    sets = S.stage(token_sets(items, "tokens"))
    low = S.stage(similar_pairs(sets, 0.25))
    for cutoff in (0.25, 0.40, 0.65):
        assert {tuple(r) for r in S.centroid_clusters(sets, cutoff).collect()} == {tuple(r) for r in S.centroid_clusters(sets, cutoff, low).collect()}


def test_stratified_sample_size(spark, compounds):
    frame = spark.createDataFrame(compounds).withColumn("c", F.col("id") % 3)
    out = S.stratified_sample(frame, "id", "c", 60).toPandas()
    assert len(out) == 60 and out["c"].value_counts().min() >= 18


def test_folds_expand(spark, compounds):
    folds = S.scaffold_folds(spark.createDataFrame(compounds), "id", "scaffold", 5)
    long = S.with_folds(folds, 5).toPandas()
    assert len(long) == 2500 and (long[long.cv_split == "val"].groupby("id").size() == 1).all()
