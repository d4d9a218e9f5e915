"""Split diagnostics against plain counts, and a validator that sees what is wrong."""

import collections

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import splits as X


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"c{i}", f"s{i * i % 151}", 4 + (i * 7919 % 1000) / 200) for i in range(400)]
    return spark.createDataFrame(data, "id string, scaffold string, activity double").repartition(5)


def verdict(rows, split):
    return X.validate_splits(rows, {"random": split}, "id", "scaffold", "activity").collect()[0]


def test_sound_strategy(rows):
    found = verdict(rows, lambda r, seed: X.random_split(r, "id", "activity", seed=seed))
    assert found.deterministic and found.n_seeds == 3 and found.test_size_spread == 0 and found.id_overlap == 0
    assert "two runs differ" not in found.issues and found.passed == (not found.issues)


def test_order_of_rows_is_found(rows):
    found = verdict(rows, lambda r, seed: r.withColumn("split", F.when(F.monotonically_increasing_id() % 5 == 0, "test").otherwise("train")))
    assert not found.deterministic and not found.passed and "two runs differ" in found.issues


def test_sizes_that_follow_the_seed_are_found(rows):
    found = verdict(rows, lambda r, seed: r.withColumn("split", F.when(F.pmod(F.xxhash64("id"), F.lit(100)) < 10 * (seed - 40), "test").otherwise("train")))
    assert found.deterministic and "test size" in found.issues and found.test_size_spread > 0.1


def test_leaks_are_found(rows):
    found = verdict(rows.unionByName(rows), lambda r, seed: r.withColumn("split", F.when(F.rand(seed) < 0.5, "test").otherwise("train")))
    assert found.id_overlap > 0 and "ids in train and test" in found.issues


def test_a_split_without_test_rows(rows):
    found = verdict(rows, lambda r, seed: r.withColumn("split", F.lit("train")))
    assert found.deterministic and found.ks_spread is None and found.test_size_spread is None


def test_diagnostics_are_counts(rows):
    split = X.scaffold_split(rows, "id", "scaffold", "activity").select(F.lit("scaffold").alias("strategy"), "id", "scaffold", "activity", "split").persist()
    got = X.split_diagnostics(split, ["strategy"], "id", "scaffold", "activity", "strategy").collect()[0]
    own = split.collect()
    sizes = collections.Counter(r.split for r in own)
    groups = collections.defaultdict(set)
    for r in own:
        groups[r.split].add(r.scaffold)
    share = {s: 100 * sum(r.activity >= 6 for r in own if r.split == s) / sizes[s] for s in ("train", "test")}
    assert sizes["test"]
    assert (got.n_train, got.n_val, got.n_test) == (sizes["train"], sizes["val"], sizes["test"])
    assert got.n_groups_test == len(groups["test"]) and got.group_overlap == 0 and got.id_overlap == 0
    assert got.drift_pp == pytest.approx(abs(share["train"] - share["test"]), abs=0.051)
    train, test = (sorted(r.activity for r in own if r.split == s) for s in ("train", "test"))
    gap = max(abs(sum(a <= v for a in train) / len(train) - sum(a <= v for a in test) / len(test)) for v in train + test)
    assert got.ks_stat == pytest.approx(gap) and got.diversity == pytest.approx(len(groups["test"]) / sizes["test"])
    assert 0 <= got.health_score <= 100 and got.health_label
