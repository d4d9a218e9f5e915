"""Feature filters, model grids, calibration and root causes on the given tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.operators import boosting as B
from tidegauge.operators import models as M
from tidegauge.operators import pairwise as P
from tidegauge.operators import splits as SP
from tidegauge.operators import stats as S
from tidegauge.operators.ordered import attach_scalars
from tidegauge.plans.pairwise import vectors
from tidegauge.plans.standins import compounds, hash_sql, measurements, pred_sql, predictions, split_rows, split_sql
from tidegauge.registry import query
from tidegauge.session import stage

LONG_SQL = "u AS (SELECT vec_id AS id, label, unnest(generate_series(0, 63))::INT AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings), bits AS (SELECT id, feature, label >= 5 AS y, x > 0 AS b FROM u)"


def labelled_bits(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), P.bits(F.col("embedding")).alias("vector"), (F.col("label") >= 5).alias("y"))


@query("M04", f"WITH {LONG_SQL} SELECT feature, round(var_pop(x), 9) AS variance, var_pop(x) > 1e-6 AS keep FROM u GROUP BY 1")
def variance_filter(t):
    return M.feature_variance(vectors(t), "vector").withColumn("variance", F.round("variance", 9))


@query("M05 T07", f"""
WITH {LONG_SQL}, j AS (SELECT feature, b, y, count(*) AS n FROM bits GROUP BY 1, 2, 3), k AS (SELECT *, sum(n) OVER (PARTITION BY feature, b) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM j),
m AS (SELECT feature, sum(n / t::DOUBLE * ln(n * t / (nx * ny)::DOUBLE)) AS mi FROM k GROUP BY 1) SELECT feature, round(greatest(mi, 0e0), 9) AS mi FROM m ORDER BY mi DESC, feature LIMIT 16""")
def mutual_information(t):
    return M.top_features(M.mutual_information(labelled_bits(t), "vector", "y"), "mi", 16).withColumn("mi", F.round("mi", 9))


@query("M06", f"WITH {LONG_SQL} SELECT feature, count(*) FILTER (WHERE b) AS support, count(*) FILTER (WHERE b) >= greatest(1, ceil(48e-2 * count(*))) AS keep FROM bits GROUP BY 1")
def support_filter(t):
    return M.feature_support(labelled_bits(t), "vector", 0.48)


@query("M06", f"""WITH {LONG_SQL}, s AS (SELECT feature, CASE WHEN feature < 32 THEN 'bits' ELSE 'values' END AS block, count(*) FILTER (WHERE b) AS support, count(*) AS n FROM bits GROUP BY 1)
SELECT feature, block, support, block <> 'bits' OR support >= greatest(1, ceil(48e-2 * n)) AS keep FROM s""")
def support_by_block(t):
    """Only bit blocks need a minimum support."""
    block = F.when(F.col("feature") < 32, "bits").otherwise("values")
    held = M.feature_support(labelled_bits(t), "vector", 0.48)
    return held.select("feature", block.alias("block"), "support", ((block != "bits") | F.col("keep")).alias("keep"))


@query("M11", f"WITH {LONG_SQL} SELECT id, count(*) AS n_features, round(sum(x), 6) AS total FROM u WHERE feature // 16 IN (1, 3) GROUP BY 1")
def family_projection(t):
    rows = vectors(t)
    dictionary = M.feature_variance(rows, "vector").select(F.col("feature").alias("index"), F.concat(F.lit("family-"), F.floor(F.col("feature") / 16).cast("string")).alias("family"))
    cut = M.project_family(rows, "vector", dictionary, ["family-1", "family-3"])
    return cut.select("id", F.size("vector").cast("long").alias("n_features"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("M07 M08")
def correlation_prune(t):
    rows = vectors(t).select("id", F.concat("vector", F.transform(F.slice("vector", 1, 4), lambda x: x * 2 + 1)).alias("vector"))
    matrix = M.correlation_matrix(rows, "vector")
    kept = M.correlation_prune(matrix, 0.95)
    lean = M.inflation_prune(matrix, 10.0, kept)
    features = F.sequence(F.lit(0), F.lit(len(matrix) - 1))
    means = M.long_form(rows, "vector").groupBy("feature").agg(F.avg("x").alias("mean"))
    return means.select("feature", F.round("mean", 9).alias("mean"), F.col("feature").isin(kept).alias("kept_correlation"),
                        F.col("feature").isin(lean).alias("kept_inflation"), (F.size(features)).alias("n_features"))


@query("M03", r"""
WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(trim(lower(text)), '\s+'))) AS token FROM documents), v AS (SELECT token, count(*) AS df FROM w WHERE doc_id % 10 < 7 GROUP BY 1 ORDER BY df DESC, token LIMIT 50),
h AS (SELECT doc_id, count(*) AS n FROM w SEMI JOIN v USING (token) GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n_bits FROM documents LEFT JOIN h USING (doc_id)""")
def token_vocabulary(t):
    docs = t("documents").select("doc_id", F.split(F.trim(F.lower("text")), r"\s+").alias("tokens"))
    vocab = M.vocabulary(docs.filter("doc_id % 10 < 7"), "tokens", 50)
    return M.encode_tokens(docs, "doc_id", "tokens", vocab).select("doc_id", F.size("bits").cast("bigint").alias("n_bits"))


@query("M09 M10")
def stability_selection(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("double").alias("y"))
    scores = M.ridge_stability(rows, "id", "vector", "y", resamples=50)
    return scores.orderBy(F.desc("stability"), "feature").limit(20)


@query("M10 M09", f"""
WITH {LONG_SQL}, f AS (SELECT unnest(range(0, 5)) AS fold), j AS (SELECT fold, feature, b, y, count(*) AS n FROM bits, f WHERE id % 5 <> fold GROUP BY 1, 2, 3, 4),
k AS (SELECT *, sum(n) OVER (PARTITION BY fold, feature, b) AS nx, sum(n) OVER (PARTITION BY fold, feature, y) AS ny, sum(n) OVER (PARTITION BY fold, feature) AS t FROM j),
m AS (SELECT fold, feature, round(greatest(sum(n / t::DOUBLE * ln(n * t / (nx * ny)::DOUBLE)), 0e0), 12) AS mi FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mi DESC, feature) AS rn FROM m)
SELECT feature, count(*) AS n_folds FROM r WHERE rn <= 16 GROUP BY 1 HAVING count(*) >= 3""")
def consensus_features(t):
    rows = labelled_bits(t).withColumn("fold", (F.col("id") % 5).cast("int"))
    picked = None
    for fold in range(5):
        top = M.top_features(M.mutual_information(rows.filter(F.col("fold") != fold), "vector", "y"), "mi", 16)
        part = top.select("feature", F.lit(fold).alias("fold"))
        picked = part if picked is None else picked.unionByName(part)
    return M.consensus(picked, 3)


def training_rows(t):
    return t("embeddings").select(
        F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"), (F.col("vec_id") % 5).cast("int").alias("fold"))


@query("M12 W11 D12")
def elastic_net_grid(t):
    grid = [(f"reg={r},l1={a}", {"regParam": r, "elasticNetParam": a}) for r in K.NET_PENALTIES for a in K.NET_MIXES]
    _, best, oof = M.grid_search(training_rows(t), grid, lambda s: LinearRegression(labelCol="y", weightCol="w", maxIter=50, **s))
    return S.regression_metrics(oof, [], "y", "p", "w").withColumn("config", F.lit(best["config"]))


@query("M12 D12")
def logistic_grid(t):
    rows = training_rows(t).withColumn("y", (F.col("y") >= 5).cast("double"))
    size = rows.count()
    grid = [(f"c={c},l1={a}", {"regParam": 1.0 / (c * size), "elasticNetParam": a}) for c in K.NET_INVERSES for a in K.NET_MIXES]
    scores, best, _ = M.grid_search(rows, grid, lambda s: LogisticRegression(labelCol="y", weightCol="w", maxIter=50, **s), probability=True)
    return scores.select("config", F.round(-F.col("score"), 6).alias("roc_auc"), (F.col("config") == best["config"]).alias("best"))


def compound_rows(t):
    """One row a compound: id, fold, weight, mean activity of its measurements, its features."""
    seen = measurements(t, "compound_id", "price", "assay_confidence").groupBy("compound_id").agg(
        F.avg(9 - F.log10("price")).alias("activity"), F.count("*").alias("n"), F.avg("assay_confidence").alias("confidence"))
    features = F.array(*[F.col(c).cast("double") for c in ("size", "weight", "n", "confidence")], (F.col("compound_id") % 5).cast("double"))
    return compounds(t, "compound_id", "weight", "size").join(seen, "compound_id").select(
        F.col("compound_id").alias("id"), F.log1p("n").alias("w"), "activity",
        F.xxhash64("compound_id").alias("draw"), features.alias("features"))


@query("M12 W11 D12")
def boosted_trees_oof(t):
    """The whole grid, 18 settings by 5 folds, each fitted to its own best round."""
    rows = compound_rows(t).select("id", F.pmod("draw", F.lit(5)).cast("int").alias("fold"), "w", F.array("activity").alias("labels"), "features")
    settings = [(d, w, a) for d in K.TREE_DEPTHS for w in K.TREE_CHILD_WEIGHTS for a in K.TREE_ALPHAS]
    return B.cross_validated(stage(rows), settings, range(5), B.Rounds(most=K.TREE_ROUNDS, patience=K.TREE_PATIENCE))


@query("M16")
def calibration_repair(t):
    rows = predictions(t, "split", "p", "y", "w")
    return M.calibration_report(rows.filter("split = 'val'"), rows.filter("split = 'test'"), "y", "p", "w")


@query("M14 J18 J19")
def stacking(t):
    """A tree grid over out-of-fold predictions, and its lift over the classifier alone."""
    fold = F.expr("CASE WHEN pmod(draw, 20) < 14 THEN cast(pmod(draw, 20) % 5 AS int) WHEN pmod(draw, 20) < 17 THEN -1 ELSE -2 END")
    value = F.when(F.col("id") % 9 < 7, F.col("activity")).otherwise(F.lit(float("nan")))
    chance = 1 / (1 + F.exp(5 - F.col("activity")))
    active = (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000 < chance).cast("double")
    rows = stage(compound_rows(t).select("id", fold.alias("fold"), "w", F.array(value, active).alias("labels"), "features"))
    settings = [(d, w, a) for d in K.STACK_DEPTHS for w in K.STACK_CHILD_WEIGHTS for a in K.STACK_ALPHAS]
    done = B.stack(rows, (K.TREE_DEPTHS[0], 1.0, 0.0), settings, range(5), B.Rounds(most=K.TREE_ROUNDS, patience=K.TREE_PATIENCE),
                   B.Rounds(most=K.STACK_ROUNDS, patience=K.TREE_PATIENCE, column_share=1.0))
    out = stage(done.predictions)
    test = out.where("fold = -2")
    cut = S.youden(out.where("fold = -1"), [], "y", "p", "w").select("threshold")
    base = S.weighted_auc(test, [], "y", "base", "w").select(F.col("roc_auc").alias("base_auc"))
    tuned = S.classification_metrics(attach_scalars(test, cut), ["threshold"], "y", "p", "w", F.col("threshold")).select("threshold", F.col("mcc").alias("tuned_mcc"))
    scores = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(a).alias("cv_auc")) for c, a in done.scores.items()])
    share = out.groupBy().agg(*[F.avg(F.when(F.expr(f"fold {test}"), F.col("covered").cast("int"))).alias(f"coverage_{n}") for n, test in (("train", ">= 0"), ("val", "= -1"), ("test", "= -2"))])
    joined = attach_scalars(attach_scalars(S.weighted_auc(test, [], "y", "p", "w").select(F.col("roc_auc").alias("stacked_auc")), base), share)
    return attach_scalars(joined, tuned).select(
        "*", (F.col("stacked_auc") - F.col("base_auc")).alias("lift"), F.lit(done.best).alias("config"), F.lit(done.rounds).alias("rounds"), scores.alias("settings"))


def _seed_sql(seed):
    return f"""(WITH {split_sql()}, e AS (SELECT quantile_cont(activity, [0e0, 2e-1, 4e-1, 6e-1, 8e-1, 1e0]) AS e FROM rows),
q AS (SELECT activity, greatest(len(list_filter(e, lambda x: x < activity)) - 1, 0) AS q, {hash_sql('id', seed)} AS h, id FROM rows, e), r AS (SELECT activity, row_number() OVER (PARTITION BY q ORDER BY h, id) - 1 AS p, count(*) OVER (PARTITION BY q) AS n FROM q),
s AS (SELECT activity, CASE WHEN p < round_even(n * 15e-2, 0) THEN 'test' WHEN p < round_even(n * 15e-2, 0) + round_even(n * 1e-1, 0) THEN 'val' ELSE 'train' END AS split FROM r)
SELECT round(abs(100e0 * avg((activity >= 6)::INT) FILTER (WHERE split = 'train') - 100e0 * avg((activity >= 6)::INT) FILTER (WHERE split = 'test')), 1) AS d FROM s)"""


@query("M15 X14 A33", f"""
WITH d AS ({_seed_sql(42)} UNION ALL {_seed_sql(43)} UNION ALL {_seed_sql(44)}) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max FROM d""")
def seed_robustness(t):
    rows = split_rows(t, "id", "activity")
    parts = None
    for seed in (42, 43, 44):
        drift = S.class_drift(SP.random_split(rows, "id", "activity", seed=seed), "split", "activity", 6.0).withColumn("seed", F.lit(seed))
        parts = drift if parts is None else parts.unionByName(drift)
    return parts.agg(F.count(F.lit(1)).alias("n"), *[F.round(f(F.col("drift_pp")), 6).alias(n) for n, f in (
        ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


@query("M20")
def mahalanobis_gate(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    out = M.mahalanobis(v.filter("label < 7"), v.filter("label >= 7"), "vector")
    return out.select("id", F.round("distance", 6).alias("distance"), "in_domain")


@query("M17 M18", f"""
WITH {pred_sql()}, a AS (SELECT id, strategy, abs(y_pred - y_true) / (2e-1 + similarity) AS share, similarity < 5e-2 AS collision, abs(p - 5e-1) * 2e0 AS density, w * 15e-1 AS uncertainty, abs(p - similarity) AS disagreement, id % 7 = 0 AS memorised FROM pred),
v AS (SELECT strategy, CASE WHEN share >= 7e-1 THEN 'resolved' WHEN memorised AND share < 5e-1 THEN 'overfit_memorized' WHEN collision THEN 'feature_collision' WHEN disagreement > 5e-1 THEN 'model_instability'
 WHEN uncertainty > 1 AND density < 4e-1 THEN 'epistemic_uncertainty' WHEN density > 4e-1 THEN 'sparse_region' ELSE 'model_averaging' END AS verdict FROM a) SELECT strategy, verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def root_cause_case(t):
    rows = predictions(t)
    share = M.attenuation(0.2 + F.col("similarity"), F.col("y_pred") - F.col("y_true"))
    verdict = M.root_cause(share, F.col("similarity") < 0.05, F.abs(F.col("p") - 0.5) * 2.0, F.lit(0.4), F.col("w") * 1.5,
                           F.abs(F.col("p") - F.col("similarity")), F.col("id") % 7 == 0)
    return rows.groupBy("strategy", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
