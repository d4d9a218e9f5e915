"""Model evaluation: metrics, calibration, distribution tests, domain statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.operators import ordered as O
from tidegauge.operators import rules
from tidegauge.operators import stats as S
from tidegauge.plans.standins import pred_sql, predictions
from tidegauge.registry import query
from tidegauge.session import stage


def rounded(df, *keep, digits=6, cols=()):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in cols])


@query("A19", f"""
WITH {pred_sql()}, v AS (SELECT strategy, y_true AS v, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split <> 'train') AS b FROM pred GROUP BY 1, 2),
c AS (SELECT *, sum(a) OVER w / sum(a) OVER k::DOUBLE AS fa, sum(b) OVER w / sum(b) OVER k::DOUBLE AS fb, sum(a) OVER k AS na, sum(b) OVER k AS nb FROM v
  WINDOW w AS (PARTITION BY strategy ORDER BY v ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY strategy)),
s AS (SELECT strategy, max(abs(fa - fb)) AS d, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, sqrt(max(na) * max(nb) / (max(na) + max(nb))::DOUBLE) * max(abs(fa - fb)) AS l FROM c GROUP BY 1)
SELECT strategy, round(d, 6) AS ks_stat, n_a, n_b, CASE WHEN l < 2e-1 THEN 1e0 ELSE round(least(greatest(2e0 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2e0 * k * k * l * l)) FROM range(1, 21) r(k)), 0e0), 1e0), 6) END AS ks_p FROM s""")
def ks_two_sample(t):
    out = S.two_sample_ks(predictions(t, "strategy", "split", "y_true"), ["strategy"], "y_true", F.col("split") == "train")
    return rounded(out, "strategy", "n_a", "n_b", cols=("ks_stat", "ks_p"))


@query("A20 A21", f"""
WITH {pred_sql()}, m AS (SELECT strategy, count(*) FILTER (WHERE variant = 'F') AS n_a, count(*) FILTER (WHERE variant <> 'F') AS n_b, avg(y_pred) FILTER (WHERE variant = 'F') AS ma, avg(y_pred) FILTER (WHERE variant <> 'F') AS mb,
 var_samp(y_pred) FILTER (WHERE variant = 'F') AS va, var_samp(y_pred) FILTER (WHERE variant <> 'F') AS vb FROM pred GROUP BY 1)
SELECT strategy, n_a, n_b, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS d FROM m""")
def cohens_d(t):
    out = S.cohens_d(predictions(t, "strategy", "variant", "y_pred"), ["strategy"], "y_pred", F.col("variant") == "F")
    return rounded(out, "strategy", "n_a", "n_b", cols=("d",))


@query("A34", f"""
WITH {pred_sql()}, b AS (SELECT strategy, (p >= 1 * 1e-1)::INT + (p >= 2 * 1e-1)::INT + (p >= 3 * 1e-1)::INT + (p >= 4 * 1e-1)::INT + (p >= 5 * 1e-1)::INT + (p >= 6 * 1e-1)::INT + (p >= 7 * 1e-1)::INT + (p >= 8 * 1e-1)::INT + (p >= 9 * 1e-1)::INT AS bin, p, y, w FROM pred),
g AS (SELECT strategy, bin, sum(w) AS m, abs(sum(p * w) / sum(w) - sum(y * w) / sum(w)) AS gap FROM b GROUP BY 1, 2)
SELECT strategy, round(sum(m * gap) / sum(m), 6) AS ece, round(max(gap), 6) AS mce FROM g GROUP BY 1""")
def ece_mce(t):
    out = S.calibration_error(predictions(t, "strategy", "p", "y", "w"), ["strategy"], "y", "p", "w")
    return rounded(out, "strategy", cols=("ece", "mce"))


@query("A34", f"""
WITH {pred_sql()}, b AS (SELECT least(floor(p * 5)::INT, 4) AS bin, p, y, w FROM pred)
SELECT bin, count(*) AS n, round(sum(w), 4) AS mass, round(sum(p * w) / sum(w), 6) AS avg_proba, round(sum(y * w) / sum(w), 6) AS obs_rate, round(abs(sum(p * w) / sum(w) - sum(y * w) / sum(w)), 6) AS gap FROM b GROUP BY 1""")
def reliability_bins(t):
    out = S.reliability_bins(predictions(t, "p", "y", "w"), [], "y", "p", "w", 5)
    return out.select("bin", "n", F.round("mass", 4).alias("mass"), *[F.round(c, 6).alias(c) for c in ("avg_proba", "obs_rate", "gap")])


@query("A35", f"""
WITH {pred_sql()}, b AS (SELECT strategy, CASE WHEN similarity <= 4e-1 THEN 'very novel' WHEN similarity <= 55e-2 THEN 'novel' WHEN similarity <= 7e-1 THEN 'moderate' WHEN similarity <= 85e-2 THEN 'near' ELSE 'very near' END AS ad_bin,
  abs(p - y) AS gap, p, y, (p >= 1 * 1e-1)::INT + (p >= 2 * 1e-1)::INT + (p >= 3 * 1e-1)::INT + (p >= 4 * 1e-1)::INT + (p >= 5 * 1e-1)::INT + (p >= 6 * 1e-1)::INT + (p >= 7 * 1e-1)::INT + (p >= 8 * 1e-1)::INT + (p >= 9 * 1e-1)::INT AS bin FROM pred),
g AS (SELECT strategy, ad_bin, bin, count(*) AS n, sum(gap) AS sg, abs(avg(p) - avg(y)) AS c FROM b GROUP BY 1, 2, 3)
SELECT strategy, ad_bin, sum(n)::BIGINT AS n, round(sum(sg) / sum(n), 6) AS mean_gap, CASE WHEN sum(n) >= 5 THEN round(sum(n * c) / sum(n), 6) END AS ece FROM g GROUP BY 1, 2""")
def ad_bins(t):
    rows = predictions(t, "strategy", "similarity", "p", "y").withColumn("ad_bin", S.domain_bin(F.col("similarity"))).withColumn("one", F.lit(1.0))
    keys = ["strategy", "ad_bin"]
    gap = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mean_gap"))
    ece = S.calibration_error(rows, keys, "y", "p", "one")
    return gap.join(ece, keys).select(*keys, "n", "mean_gap", F.when(F.col("n") >= 5, F.round("ece", 6)).alias("ece"))


RANK_SQL = """rx AS (SELECT strategy, {x} AS x, {y} AS y, rank() OVER (PARTITION BY strategy ORDER BY {x}) + (count(*) OVER (PARTITION BY strategy, {x}) - 1) / 2e0 AS a,
  rank() OVER (PARTITION BY strategy ORDER BY {y}) + (count(*) OVER (PARTITION BY strategy, {y}) - 1) / 2e0 AS b FROM pred),
rho AS (SELECT strategy, round(corr(a, b), 6) AS rho FROM rx GROUP BY 1)"""


@query("A36", f"""
WITH {pred_sql()}, {RANK_SQL.format(x='similarity', y='abs(p - y)')}, s AS (SELECT strategy, count(*) AS n, round(corr(similarity, abs(p - y)), 6) AS pearson, round(avg((abs(p - y) > 5e-1)::INT), 6) AS high_error_rate,
 round(avg((similarity > 85e-2)::INT) FILTER (WHERE abs(p - y) > 5e-1), 6) AS high_error_in_domain, round(avg((abs(p - y) > 5e-1)::INT) FILTER (WHERE similarity > 85e-2), 6) AS false_confidence_rate, round(median(similarity), 6) AS sim_median,
 round(quantile_cont(similarity, 75e-2) - quantile_cont(similarity, 25e-2), 6) AS sim_iqr FROM pred GROUP BY 1)
SELECT s.*, rho AS spearman FROM s JOIN rho USING (strategy)""")
def ad_stats(t):
    rows = predictions(t, "strategy", "similarity", "p", "y").withColumn("gap", F.abs(F.col("p") - F.col("y")))
    out = S.domain_statistics(rows, ["strategy"], "similarity", "gap")
    q = O.quantiles(rows, ["strategy"], "similarity", {"sim_median": 0.5, "_lo": 0.25, "_hi": 0.75})
    q = q.select("strategy", F.round("sim_median", 6).alias("sim_median"), F.round(F.col("_hi") - F.col("_lo"), 6).alias("sim_iqr"))
    return rounded(out, "strategy", "n", cols=("pearson", "spearman", "high_error_rate", "high_error_in_domain", "false_confidence_rate")).join(q, "strategy")


@query("A38 W10", f"""
WITH {pred_sql()}, {RANK_SQL.format(x='y_true', y='y_pred')}, s AS (SELECT strategy, count(*) AS n, sqrt(sum(w * pow(y_true - y_pred, 2)) / sum(w)) AS rmse, sum(w * abs(y_true - y_pred)) / sum(w) AS mae, sum(w * y_true) / sum(w) AS m FROM pred GROUP BY 1),
r AS (SELECT strategy, 1 - sum(w * pow(y_true - y_pred, 2)) / sum(w * pow(y_true - m, 2)) AS r2 FROM pred JOIN s USING (strategy) GROUP BY 1)
SELECT s.strategy, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, rho AS spearman_rho FROM s JOIN r USING (strategy) JOIN rho USING (strategy)""")
def reg_metrics(t):
    out = S.regression_metrics(predictions(t, "strategy", "y_true", "y_pred", "w"), ["strategy"], "y_true", "y_pred", "w")
    return rounded(out, "strategy", "n", cols=("rmse", "mae", "r2", "spearman_rho"))


@query("W10", f"""
WITH {pred_sql()}, {RANK_SQL.format(x='p', y='y_true')} SELECT strategy, rho FROM rho""")
def spearman(t):
    return rounded(S.spearman(predictions(t, "strategy", "p", "y_true"), ["strategy"], "p", "y_true"), "strategy", cols=("rho",))


@query("A39", f"""
WITH {pred_sql()}, c AS (SELECT strategy, count(*) AS n, sum(CASE WHEN p >= 5e-1 AND y = 1 THEN w ELSE 0e0 END) AS tp, sum(CASE WHEN p >= 5e-1 AND y = 0 THEN w ELSE 0e0 END) AS fp, sum(CASE WHEN p < 5e-1 AND y = 1 THEN w ELSE 0e0 END) AS fn,
 sum(CASE WHEN p < 5e-1 AND y = 0 THEN w ELSE 0e0 END) AS tn, sum(w * pow(p - y, 2)) / sum(w) AS brier, sum(w * y) / sum(w) AS pos_rate FROM pred GROUP BY 1)
SELECT strategy, n, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1_macro,
 round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(brier, 6) AS brier, round(pos_rate, 6) AS pos_rate FROM c""")
def clf_metrics(t):
    out = S.classification_metrics(predictions(t, "strategy", "p", "y", "w"), ["strategy"], "y", "p", "w", 0.5)
    return rounded(out, "strategy", "n", cols=("balanced_accuracy", "f1_macro", "mcc", "brier", "pos_rate"))


ROC_SQL = f"""{pred_sql()}, v AS (SELECT strategy, p AS v, sum(CASE WHEN y = 1 THEN w ELSE 0e0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0e0 END) AS neg FROM pred GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER k AS ap, sum(neg) OVER k AS an FROM v WINDOW w AS (PARTITION BY strategy ORDER BY v ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY strategy))"""


@query("A39", f"WITH {ROC_SQL} SELECT strategy, round(sum(neg * (ap - cp + pos / 2)) / (max(ap) * max(an)), 6) AS roc_auc FROM c GROUP BY 1")
def weighted_auc(t):
    return rounded(S.weighted_auc(predictions(t, "strategy", "p", "y", "w"), ["strategy"], "y", "p", "w"), "strategy", cols=("roc_auc",))


@query("A40 M13", f"""
WITH {ROC_SQL}, j AS (SELECT strategy, v, round((ap - cp + pos) / ap - (an - cn + neg) / an, 9) AS j FROM c), b AS (SELECT strategy, j, v, row_number() OVER (PARTITION BY strategy ORDER BY j DESC, v DESC) AS rn FROM j)
SELECT strategy, round(j, 6) AS j, CASE WHEN j > 0 THEN v ELSE 5e-1 END AS threshold FROM b WHERE rn = 1""")
def youden(t):
    out = S.youden(predictions(t, "strategy", "p", "y", "w"), ["strategy"], "y", "p", "w")
    return out.select("strategy", F.round("j", 6).alias("j"), "threshold")


@query("M13 A39", f"""
WITH {ROC_SQL.replace('FROM pred GROUP', "FROM pred WHERE split = 'val' GROUP")}, j AS (SELECT strategy, v, round((ap - cp + pos) / ap - (an - cn + neg) / an, 9) AS j FROM c),
b AS (SELECT strategy, v AS t, row_number() OVER (PARTITION BY strategy ORDER BY j DESC, v DESC) AS rn FROM j),
e AS (SELECT strategy, t, sum(CASE WHEN p >= t AND y = 1 THEN w ELSE 0e0 END) AS tp, sum(CASE WHEN p >= t AND y = 0 THEN w ELSE 0e0 END) AS fp, sum(CASE WHEN p < t AND y = 1 THEN w ELSE 0e0 END) AS fn, sum(CASE WHEN p < t AND y = 0 THEN w ELSE 0e0 END) AS tn
  FROM pred JOIN b USING (strategy) WHERE split = 'test' AND rn = 1 GROUP BY 1, 2)
SELECT strategy, t AS threshold, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM e""")
def threshold_recalibration(t):
    rows = predictions(t, "strategy", "split", "p", "y", "w")
    cuts = S.youden(rows.filter("split = 'val'"), ["strategy"], "y", "p", "w").select("strategy", "threshold")
    test = rows.filter("split = 'test'").join(cuts, "strategy")
    out = S.classification_metrics(test, ["strategy", "threshold"], "y", "p", "w", F.col("threshold"))
    return out.select("strategy", "threshold", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query("A37 Q09")
def bootstrap_ci(t):
    rows = predictions(t, "id", "y_true", "y_pred", "w")
    draws = S.bootstrap_regression(rows, "id", "y_true", "y_pred", "w", replicates=1000, seed=42)
    return S.percentile_interval(draws, ["rmse", "mae", "r2"])


@query("A37")
def bootstrap_auc_ci(t):
    draws = S.bootstrap_auc(predictions(t, "id", "p", "y", "w"), "id", "y", "p", "w", replicates=1000, seed=42)
    return S.percentile_interval(draws, ["roc_auc"])


def _cells_with_intervals(t):
    """R2 and AUC of each strategy on all its rows, beside their bootstrap intervals."""
    names = ("A", "N", "R")
    rows = predictions(t, "strategy", "id", "y_true", "y_pred", "p", "y", "w")
    points = S.regression_metrics(rows, ["strategy"], "y_true", "y_pred", "w").select("strategy", F.lit("r2").alias("metric"), F.col("r2").alias("point")).unionByName(
        S.weighted_auc(rows, ["strategy"], "y", "p", "w").select("strategy", F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("point")))
    intervals = None
    for name in names:
        part = rows.filter(F.col("strategy") == name)
        for draws, metric in ((S.bootstrap_regression(part, "id", "y_true", "y_pred", "w", 1000, 42), "r2"), (S.bootstrap_auc(part, "id", "y", "p", "w", 1000, 42), "roc_auc")):
            found = S.percentile_interval(draws, [metric]).withColumn("strategy", F.lit(name))
            intervals = found if intervals is None else intervals.unionByName(found)
    return S.interval_agreement(points, stage(intervals), ["strategy"], K.POINT_LIMITS)


@query("Q09 A37")
def bootstrap_agreement(t):
    return rounded(_cells_with_intervals(t), "strategy", "metric", "limit", "agrees", cols=("point", "low", "mid", "high", "width", "gap"))


@query("Q09")
def bootstrap_audit(t):
    return S.agreement_audit(stage(_cells_with_intervals(t)))


@query("X12 Q11", f"""
WITH {pred_sql()}, m AS (SELECT CASE strategy WHEN 'A' THEN 'random' WHEN 'N' THEN 'scaffold' ELSE 'cliff_aware' END AS split_name, round(abs(100e0 * avg((p >= 4e-1)::INT) FILTER (WHERE split = 'train') - 1e2 * avg((p >= 4e-1)::INT) FILTER (WHERE split = 'test')) * 20, 1) AS drift,
  count(*) FILTER (WHERE split = 'val') AS n_val, 18e-2 AS ks, 3e-2 AS pv FROM pred GROUP BY 1),
s AS (SELECT *, greatest(0, 100 - (CASE WHEN drift > 35 THEN 30 WHEN drift > 20 THEN 20 WHEN drift > 10 THEN 10 WHEN drift > 5 THEN 4 WHEN drift > 2 THEN 2 ELSE 0 END) - (CASE WHEN n_val = 0 THEN 25 ELSE 0 END)
  - (CASE split_name WHEN 'random' THEN 4 WHEN 'scaffold' THEN 0 ELSE 5 END) - 2 - (CASE WHEN split_name = 'cliff_aware' THEN 8 ELSE 0 END)) AS h FROM m)
SELECT split_name, drift, h AS health_score, CASE WHEN h >= 90 THEN 'EXCELLENT' WHEN h >= 75 THEN 'GOOD' WHEN h >= 60 THEN 'ACCEPTABLE' WHEN h >= 40 THEN 'WEAK' ELSE 'DEGENERATE' END AS health_label FROM s""")
def health_score(t):
    share = lambda s: 100.0 * F.avg(F.when(F.col("split") == s, (F.col("p") >= 0.4).cast("int")))
    name = F.when(F.col("strategy") == "A", "random").when(F.col("strategy") == "N", "scaffold").otherwise("cliff_aware")
    m = predictions(t, "strategy", "split", "p").groupBy(name.alias("split_name")).agg(
        F.round(F.abs(share("train") - share("test")) * 20, 1).alias("drift"), F.count_if(F.col("split") == "val").alias("n_val"))
    out = rules.split_health(F.col("split_name"), F.lit(False), F.col("drift"), F.col("n_val"), F.lit(0.18), F.lit(0.03),
                             F.lit(0.1), F.lit(0.4), F.lit(35.0))
    return m.select("split_name", "drift", *[c.alias(n) for n, c in out.items()])
