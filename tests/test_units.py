"""Units by spelling: the verdicts, and one search a row however often they are read."""

import pytest
from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.functions import expressions as X


def plain(raw, value):
    clean = (raw or "").strip(" ").lower().replace(" ", "")
    near = value is not None and 0.001 <= value <= 1e6
    far = value is not None and not 0.001 <= value <= 1e7
    hits = [s for s in K.UNIT_FACTORS if clean == s or clean.replace("molar", "") == s.replace("molar", "")]
    unit = ("inferred_nm" if near else "unknown") if clean in ("", "nan", "none", "unknown") else hits[0] if hits else "unknown"
    sure = K.UNIT_CONFIDENCE.get(unit, K.UNIT_CONFIDENCE_DEFAULT)
    flag = {"unknown": "unknown", "inferred_nm": "inferred"}.get(unit, "suspicious" if far else "ok")
    return unit, min(sure, 0.5) if unit == "nm" and far else sure, flag


def test_verdicts_of_every_spelling(spark):
    raws = [None, "", " ", "NaN", "none", "unknown", "nM", " Nano Molar", "furlong", "molarnm", "umolar", "molarmolar", *K.UNIT_FACTORS]
    rows = [(r, v) for r in raws for v in (None, -1.0, 0.0009, 0.001, 1e6, 1.1e6, 1e7, 1.1e7)]
    frame = spark.createDataFrame(rows, "raw string, v double")
    got = {(r.raw, r.v): (r.unit, pytest.approx(r.unit_confidence), r.unit_flag) for r in X.with_unit(frame, F.col("raw"), F.col("v")).collect()}
    assert len(got) == len(rows) and all(plain(*key) == verdict for key, verdict in got.items())


def test_a_filter_on_the_verdict_does_not_repeat_the_search(spark):
    frame = spark.createDataFrame([("nM", 1.0)], "raw string, v double")
    flagged = X.with_unit(frame, F.col("raw"), F.col("v"))
    usable = flagged.withColumn("tier", X.first_rule([(F.col("unit_flag").isin("ok", "inferred"), "T1"), (F.col("unit") == "unknown", "T3")], "T2"))
    plan = usable.filter("tier = 'T1'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(trim(") <= 2
