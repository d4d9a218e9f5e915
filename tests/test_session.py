"""What staged tables leave behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tidegauge import session as N
from tidegauge.operators import pairwise as P
from tidegauge.plans import curation as C


def test_a_staged_write_leaves_no_shuffle_files(spark):
    """They stayed until the JVM collected the plan, so all steps of a query lay on disk together."""
    held = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = {k for k in str(held.keySet()).strip("Set()").split(", ") if k}
    done = N.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.max("id").alias("m")))
    for _ in range(20):
        left = {k for k in str(held.keySet()).strip("Set()").split(", ") if k} - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and done.count() == 7 and spark.conf.get(N._CLEANUP, None) in (None, "false")


def test_since_deletes_only_the_steps(spark):
    kept = N.stage(spark.range(3))
    mark = N.staged()
    step = N.stage(spark.range(5))
    end = N.stage(step.filter("id > 1"), since=mark)
    folders = [Path(f.removeprefix("file:")).parent for t in (kept, end) for f in t.inputFiles()[:1]]
    assert all(f.exists() for f in folders) and kept.count() == 3 and end.count() == 3
    assert not Path(step.inputFiles()[0].removeprefix("file:")).exists()


def test_records_meet_before_they_are_annotated(spark, monkeypatch):
    """Twice as many columns went through the two exchanges of the duplicates."""
    seen = []
    meet = C.deduplicate
    monkeypatch.setattr(C, "deduplicate", lambda rows, order: seen.append(rows.columns) or meet(rows, order))
    from tidegauge.plans.released import contract_rows
    from tidegauge.registry import Tables

    folder = "/root/testdata/sf0.001"
    if Path(folder).is_dir():
        rows = contract_rows(Tables(spark, folder))
        C.curate(rows, organism={"M": "mouse", "H": "human"})
        assert set(seen[0]) == {*rows.columns, "_ord"}


def test_pairs_leave_their_steps_behind(spark, monkeypatch):
    """Profiles and placed candidates of both passes stayed to the end."""
    tables = []
    plain = P.stage
    monkeypatch.setattr(P, "stage", lambda df: tables.append(plain(df)) or tables[-1])
    rows = [(i, [f"t{j}" for j in range(i % 5, 30)]) for i in range(60)]
    pairs = P.similar_sets(spark.createDataFrame(rows, "id bigint, tokens array<string>"), "tokens", 0.8)
    assert pairs.count() == 10
    there = {c for t in tables if Path(t.inputFiles()[0].removeprefix("file:")).exists() for c in t.columns}
    assert there == {"set_key", "pid", "n_members", "tokens", "left", "right", "similarity"}
