"""Similarity pairs and neighbours over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.operators import domain as DM
from tidegauge.operators import ordered as O
from tidegauge.operators import pairwise as P
from tidegauge.operators.rules import remediation
from tidegauge.operators.weights import group_decay, min_max_weight, released_weight
from tidegauge.plans.standins import comp_sql, compounds
from tidegauge.registry import query

DOC_SQL = r"""doc AS (SELECT doc_id AS id, list_sort(list_distinct(string_split_regex(trim(lower(text)), '\s+'))) AS s, 4e0 + (doc_id % 9) * 5e-1 AS v FROM documents),
sets AS (SELECT s, min(id) AS pid, len(s) AS n FROM doc GROUP BY s), tok AS (SELECT pid, n, unnest(s) AS t FROM sets),
inter AS (SELECT a.pid AS l, b.pid AS r, a.n AS na, b.n AS nb, count(*) AS k FROM tok a JOIN tok b ON a.t = b.t AND a.pid < b.pid WHERE least(a.n, b.n) >= 8e-1 * greatest(a.n, b.n) - 1e-9 GROUP BY 1, 2, 3, 4),
sim AS (SELECT l, r, k / (na + nb - k)::DOUBLE AS similarity FROM inter WHERE k / (na + nb - k)::DOUBLE >= 8e-1)"""

CLIFF_SQL = f"""{DOC_SQL}, cls AS (SELECT pid, v, min(id) AS m, count(*) AS c FROM doc JOIN sets USING (s) GROUP BY 1, 2), e AS (SELECT * FROM sim UNION ALL SELECT pid, pid, 1e0 FROM sets),
cliff AS (SELECT least(a.m, b.m) AS id_1, greatest(a.m, b.m) AS id_2, round(similarity, 6) AS similarity, CASE WHEN a.m < b.m THEN a.v ELSE b.v END AS value_1, CASE WHEN a.m < b.m THEN b.v ELSE a.v END AS value_2, abs(a.v - b.v) AS delta,
  CASE WHEN abs(a.v - b.v) >= 3 THEN 'severe' WHEN abs(a.v - b.v) >= 2 THEN 'moderate' ELSE 'mild' END AS severity, a.c * b.c AS n_pairs, a.m AS ma, b.m AS mb, a.c AS ca, b.c AS cb
  FROM e JOIN cls a ON l = a.pid JOIN cls b ON r = b.pid WHERE abs(a.v - b.v) >= 15e-1 AND (l <> r OR a.m < b.m))"""


def documents_as_sets(t):
    words = F.split(F.trim(F.lower("text")), r"\s+")
    return t("documents").select(F.col("doc_id").alias("id"), words.alias("tokens"), (4.0 + (F.col("doc_id") % 9) * 0.5).alias("value"))


@query("J08", f"WITH {DOC_SQL} SELECT l AS \"left\", r AS \"right\", round(similarity, 6) AS similarity FROM sim")
def similar_sets(t):
    return P.similar_sets(documents_as_sets(t), "tokens", K.CLIFF_SIMILARITY).select("left", "right", F.round("similarity", 6).alias("similarity"))


@query("J08 D6", f"WITH {CLIFF_SQL} SELECT id_1, id_2, similarity, value_1, value_2, delta, severity, n_pairs FROM cliff")
def pair_cliffs(t):
    return P.cliff_classes(documents_as_sets(t), "tokens", "value").withColumn("similarity", F.round("similarity", 6)).drop("n_1", "n_2")


@query("J08", f"""
WITH {CLIFF_SQL}, u AS (SELECT ma AS id, cb AS c, delta FROM cliff UNION ALL SELECT mb, ca, delta FROM cliff)
SELECT id, sum(c)::BIGINT AS n_partners, max(delta) AS max_delta, CASE WHEN max(delta) >= 3 THEN 'severe' WHEN max(delta) >= 2 THEN 'moderate' ELSE 'mild' END AS severity FROM u GROUP BY 1""")
def cliff_compounds(t):
    return P.cliff_statistics(documents_as_sets(t), "tokens", "value")


BIT_SQL = """onb AS (SELECT vec_id AS id, label, unnest(list_transform(generate_series(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN i END)) AS b FROM embeddings),
ob AS (SELECT id, label, b FROM onb WHERE b IS NOT NULL), sz AS (SELECT id, label, count(*) AS n FROM ob GROUP BY 1, 2),
dots AS (SELECT x.id AS q, y.id AS r, count(*) AS k FROM ob x JOIN ob y ON x.b = y.b GROUP BY 1, 2),
tan AS (SELECT a.id AS q, a.label AS ql, c.id AS r, c.label AS rl, coalesce(k, 0) / nullif(a.n + c.n - coalesce(k, 0), 0)::DOUBLE AS s FROM sz a CROSS JOIN sz c LEFT JOIN dots d ON d.q = a.id AND d.r = c.id)"""


def fingerprints(t, where=None):
    e = t("embeddings")
    e = e.filter(where) if where else e
    return e.select(F.col("vec_id").alias("id"), P.bits(F.col("embedding")).alias("vector"))


@query("J09 T04", f"""
WITH {BIT_SQL}, rk AS (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY round(1 - s, 9), r) AS rn FROM tan WHERE q <> r) SELECT q AS id, round(avg(s), 6) AS self_similarity, round(1 - avg(s), 6) AS novelty FROM rk WHERE rn <= 5 GROUP BY 1""")
def knn_self(t):
    f = fingerprints(t)
    out = P.neighbour_means(P.nearest(f, f, K.NEIGHBOURS, exclude_self=True), K.NEIGHBOURS)
    return out.select("id", F.round("mean_sim", 6).alias("self_similarity"), F.round(1 - F.col("mean_sim"), 6).alias("novelty"))


#: distance to the standardised training cloud: correlations, their inverse by elimination, one limit
GATE_SQL = """lf AS (SELECT vec_id AS id, label, unnest(generate_series(1, 64)) AS i, unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END)) AS x FROM embeddings),
ms AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM lf WHERE label < 5 GROUP BY 1), zs AS (SELECT id, label, i, CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0e0 END AS z FROM lf JOIN ms USING (i)),
co AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1e0 ELSE avg(a.z * b.z) END AS c FROM zs a JOIN zs b USING (id) WHERE a.label < 5 GROUP BY 1, 2),
ro AS (SELECT i, list(c ORDER BY j) || list_transform(generate_series(1, 64), lambda j: CASE WHEN i = j THEN 1e0 ELSE 0e0 END) AS r FROM co GROUP BY 1),
gj(k, m) AS (SELECT 1, list(r ORDER BY i) FROM ro UNION ALL
 SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= 64),
iv AS (SELECT list_transform(m, lambda r: r[65:128]) AS p FROM gj WHERE k = 65), zl AS (SELECT id, label, list(z ORDER BY i) AS z FROM zs GROUP BY 1, 2),
gd AS (SELECT id, label, sqrt(greatest(list_sum(list_transform(p, lambda r, i: z[i] * list_dot_product(r, z))), 0e0)) AS d FROM zl, iv),
lim AS (SELECT quantile_cont(d, 975e-3) AS top FROM gd WHERE label < 5 HAVING count(*) >= 10),
gate AS (SELECT id AS q, coalesce(d <= (SELECT top FROM lim), false) AS inside FROM gd WHERE label >= 5)"""


@query("J10", f"""
WITH RECURSIVE {BIT_SQL}, {GATE_SQL}, rk AS (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY round(1 - s, 9), r) AS rn FROM tan WHERE ql >= 5 AND rl < 5),
g AS (SELECT q, avg(s) FILTER (WHERE rn <= 5) AS m, var_pop(s) FILTER (WHERE rn <= 5) AS v, avg((s > 0)::INT) FILTER (WHERE rn <= 10) * avg(s) FILTER (WHERE rn <= 10) AS d FROM rk GROUP BY 1),
c AS (SELECT *, least(m / 35e-2, 1e0) * 5e-1 + least(d / (SELECT avg(d) FROM g), 1e0) * 3e-1 + CASE WHEN inside THEN 2e-1 ELSE 0e0 END AS c FROM g JOIN gate USING (q))
SELECT q AS id, round(m, 5) AS nn_similarity, round(v, 5) AS knn_variance, round(d, 5) AS local_density, round(c, 5) AS score, m >= 35e-2 AS in_domain,
 CASE WHEN m < 2e-1 THEN 'out_of_domain' WHEN m >= 4e-1 AND c >= 6e-1 AND v < 5e-2 THEN 'high' WHEN m >= 3e-1 THEN 'medium' ELSE 'low' END AS reliability FROM c""")
def knn_ad(t):
    return DM.gated_domain(fingerprints(t, "label < 5"), fingerprints(t, "label >= 5")).select(
        "id", F.round("mean_sim", 5).alias("nn_similarity"), F.round("var_sim", 5).alias("knn_variance"),
        F.round("density", 5).alias("local_density"), F.round("score", 5).alias("score"), "in_domain", "reliability")


@query("J10 M20")
def knn_ad_gated(t):
    out = DM.gated_domain(fingerprints(t, "label < 5"), fingerprints(t, "label >= 5"))
    return out.select(
        "id", *[F.round(c, 5).alias(n) for c, n in (
            ("mean_sim", "nn_similarity"), ("var_sim", "knn_variance"), ("density", "local_density"), ("gate_distance", "gate_distance"), ("score", "score"))],
        "gate_in_domain", "in_domain", "reliability")


@query("P26 P18 P19 J09", f"""
WITH {BIT_SQL}, rk AS (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY round(1 - s, 9), r) AS rn FROM tan WHERE q <> r),
nov AS (SELECT q AS compound_id, round(1 - round(avg(s), 4), 4) AS novelty FROM rk WHERE rn <= 5 GROUP BY 1),
{comp_sql('compound_id', 'scaffold', 'weight', 'size')}, g AS (SELECT scaffold, count(*) AS n FROM comp GROUP BY 1), mx AS (SELECT max(n) AS top FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY weight DESC, compound_id) - 1 AS rk FROM comp JOIN g USING (scaffold), mx),
f AS (SELECT compound_id, weight AS fw, CASE WHEN n <= 15 OR rk < 15 THEN 1e0 ELSE round(greatest(pow(5e-1, rk - 14), 1e-2), 4) END AS decay, (compound_id % 11) / 5e1 AS lu, coalesce(novelty, 5e-1) AS nov,
  round(1e0 - n / top::DOUBLE, 4) AS sdiv, CASE WHEN compound_id % 10 = 0 THEN 3e-1 ELSE (compound_id % 10) / 1e1 END AS comp, (compound_id % 3) / 2e0 AS csc, CASE WHEN compound_id % 9 = 0 THEN 8e-1 ELSE 0e0 END AS res,
  round(CASE WHEN compound_id % 9 = 0 AND compound_id % 4 >= 2 THEN 1e-1 WHEN compound_id % 4 >= 2 AND compound_id % 6 > 3 THEN 55e-2 WHEN compound_id % 4 = 3 THEN 5e-1
    WHEN compound_id % 4 = 2 THEN least((compound_id % 6) / greatest(compound_id % 7, 1)::DOUBLE, 1e0) * 3e-1 ELSE 0e0 END, 3) AS smp FROM k LEFT JOIN nov USING (compound_id)),
w AS (SELECT compound_id, nov, decay, greatest(fw * decay * (1e0 - lu) * (1e0 + 2e-1 * nov) * (1e0 + 1e-1 * sdiv) * (1e0 + 5e-2 * comp) * (1e0 + 15e-2 * csc) * (1e0 + 1e-1 * res) * (1e0 - 6e-1 * smp), 0e0) AS w FROM f),
mm AS (SELECT min(w) AS lo, max(w) AS hi FROM w)
SELECT compound_id, nov AS novelty, round(least(greatest(w, 1e-2), 15e-1), 4) AS ml_weight_raw, CASE WHEN hi > lo THEN round(1e-2 + 99e-2 * (w - lo) / (hi - lo), 4) ELSE 5e-1 END AS ml_weight FROM w, mm""")
def released_weights(t):
    from tidegauge.plans.curation import with_novelty
    ranked = group_decay(compounds(t, "compound_id", "scaffold", "weight"), "scaffold", "weight", "compound_id").withColumnRenamed("compound_id", "row_id")
    prints = fingerprints(t).select(F.col("id").alias("row_id"), F.col("vector").alias("fingerprint"))
    # the novelty of a compound counts all that have a fingerprint, listed or not
    novelty = with_novelty(prints).select("row_id", "novelty")
    rows = ranked.join(novelty, "row_id", "left")
    part, crossed = F.col("row_id"), F.col("row_id") % 9 == 0
    flag = F.element_at(F.array(*[F.lit(n) for n in ("defined", "achiral", "partial_undefined", "fully_undefined")]), (part % 4 + 1).cast("int"))
    penalty = remediation(flag, (part % 7).cast("int"), (part % 6).cast("int"), crossed, F.lit(6.0))["penalty"]
    raw = released_weight(
        F.col("weight"), F.col("decay_weight"), (part % 11) / 50.0, novelty=F.col("novelty"), diversity=F.col("diversity"),
        complexity=F.nullif((part % 10) / 10.0, F.lit(0.0)), consensus=(part % 3) / 2.0, resolution=F.when(crossed, 0.8), stereo_penalty=penalty)
    out = min_max_weight(rows.withColumn("_raw", raw), "_raw", "ml_weight_raw", "ml_weight")
    return out.select(part.alias("compound_id"), F.coalesce("novelty", F.lit(0.5)).alias("novelty"), "ml_weight_raw", "ml_weight")


@query("J11", f"""
WITH {BIT_SQL}, rk AS (SELECT q, ql, s, row_number() OVER (PARTITION BY q ORDER BY round(1 - s, 9), r) AS rn FROM tan WHERE rl < 4 AND q <> r),
g AS (SELECT q, ql < 4 AS member, avg(s) AS m, var_pop(s) AS v, avg((s > 0)::INT) * avg(s) AS d FROM rk WHERE rn <= 10 GROUP BY 1, 2),
c AS (SELECT *, greatest(least(least(m / 25e-2, 1e0) * 6e-1 + least(d / (SELECT avg(d) FROM g), 1e0) * 25e-2 - least(v / 5e-2, 1e0) * 15e-2, 1e0), 0e0) AS c FROM g)
SELECT q AS id, round(c, 5) AS self_score, m >= 25e-2 AS in_domain, CASE WHEN m < 15e-2 THEN 'out_of_domain' ELSE (CASE WHEN m >= 35e-2 AND c >= 55e-2 AND v < 4e-2 THEN 'high' WHEN m >= 25e-2 THEN 'medium' ELSE 'low' END) || (CASE WHEN member THEN '' ELSE '_vs_reference' END) END AS reliability FROM c""")
def knn_loo(t):
    near = P.nearest(fingerprints(t), fingerprints(t, "label < 4"), K.SELF_NEIGHBOURS, exclude_self=True)
    member = t("embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 4).alias("member"))
    return DM.self_domain(near, member).select("id", F.round("score", 5).alias("self_score"), "in_domain", "reliability")


NN_SQL = f"""{BIT_SQL}, rk AS (SELECT q, r, s, row_number() OVER (PARTITION BY q ORDER BY round(1 - s, 9), r) AS rn FROM tan WHERE ql >= 8 AND rl < 7), nn AS (SELECT q, r, s FROM rk WHERE rn = 1)"""


def nearest_train(t):
    return P.nearest(fingerprints(t, "label >= 8"), fingerprints(t, "label < 7"), 1).select("id", "ref", (1 - F.col("distance")).alias("similarity"))


@query("J12", f"WITH {NN_SQL} SELECT q AS id, r AS ref, round(s, 6) AS similarity FROM nn")
def nn_max(t):
    return nearest_train(t).withColumn("similarity", F.round("similarity", 6))


@query("A27", f"""
WITH {NN_SQL} SELECT count(*) AS n, round(avg(s), 6) AS mean, round(max(s), 6) AS max, round(median(s), 6) AS median, round(quantile_cont(s, 1e-1), 6) AS p10, round(quantile_cont(s, 9e-1), 6) AS p90,
 round(100e0 * avg((s > 7e-1)::INT), 1) AS pct_above_70, round(100e0 * avg((s < 4e-1)::INT), 1) AS pct_below_40, round(1 - avg(s), 3) AS difficulty FROM nn""")
def nn_summary(t):
    from tidegauge.session import stage
    nn = stage(nearest_train(t))
    s = F.col("similarity")
    basic = nn.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.max(s), 6).alias("max"),
                   F.round(100.0 * F.avg((s > 0.7).cast("int")), 1).alias("pct_above_70"), F.round(100.0 * F.avg((s < 0.4).cast("int")), 1).alias("pct_below_40"),
                   F.round(1 - F.avg(s), 3).alias("difficulty"))
    q = O.quantiles(nn, [], "similarity", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return O.attach_scalars(basic, q.select(*[F.round(c, 6).alias(c) for c in q.columns]))


DIST_SQL = """u AS (SELECT vec_id AS id, label, unnest(generate_series(1, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
dist AS (SELECT a.id AS q, b.id AS r, any_value(b.label) AS rl, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM u a JOIN u b ON a.i = b.i AND a.id <> b.id GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), r) AS rn FROM dist)"""


def vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def euclidean_neighbours(t):
    return P.nearest(vectors(t), vectors(t), K.NEIGHBOURS, metric="euclidean", exclude_self=True)


@query("A49", f"""
WITH {DIST_SQL}, m AS (SELECT q, avg(d) AS mean_d, min(d) AS nearest_d FROM rk WHERE rn <= 5 GROUP BY 1), z AS (SELECT avg(nearest_d) AS mu, stddev_pop(nearest_d) AS sd, quantile_cont(mean_d, 95e-2) AS p95 FROM m)
SELECT q AS id, round(mean_d, 6) AS mean_distance, round((nearest_d - mu) / sd, 3) AS z_score, (nearest_d - mu) / sd < -1 AS is_collision, mean_d > p95 AS is_sparse FROM m, z""")
def knn_distance(t):
    from tidegauge.session import stage
    per_id = stage(euclidean_neighbours(t).groupBy("id").agg(F.avg("distance").alias("mean_d"), F.min("distance").alias("near_d")))
    base = per_id.agg(F.avg("near_d").alias("mu"), F.stddev_pop("near_d").alias("sd"))
    rows = O.attach_scalars(O.attach_scalars(per_id, base), O.quantiles(per_id, [], "mean_d", {"p95": 0.95}))
    z = (F.col("near_d") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))
    return rows.select("id", F.round("mean_d", 6).alias("mean_distance"), F.round(z, 3).alias("z_score"),
                       (z < -1).alias("is_collision"), (F.col("mean_d") > F.col("p95")).alias("is_sparse"))


@query("A43", f"WITH {DIST_SQL} SELECT q AS id, round(stddev_pop(rl), 6) AS label_std FROM rk WHERE rn <= 5 GROUP BY 1")
def knn_label_std(t):
    labels = t("embeddings").select(F.col("vec_id").alias("ref"), "label")
    return euclidean_neighbours(t).join(labels, "ref").groupBy("id").agg(F.round(F.stddev_pop("label"), 6).alias("label_std"))
