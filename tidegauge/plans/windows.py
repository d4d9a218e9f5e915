"""Deduplication, ordered picks, ranks, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import audit as Q
from tidegauge.operators import dedup as D
from tidegauge.operators import ordered as O
from tidegauge.plans.standins import comp_sql, compounds, meas_sql, measurements, pred_sql, predictions
from tidegauge.registry import query

DEDUP_KEYS = ["compound_id", "source_id", "kind", "qualifier_raw", "dedup_value"]


@query("W02", """
WITH m AS (SELECT *, value - median(value) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_id, round(c, 6) AS centred FROM m""")
def center_median(t):
    e = t("events").select("event_id", "event_type", "value")
    return e.join(O.quantiles(e, ["event_type"], "value", {"m": 0.5}), "event_type").select(
        "event_id", F.round(F.col("value") - F.col("m"), 6).alias("centred"))


@query("W03", """
WITH q AS (SELECT o_custkey, quantile_cont(o_totalprice, 25e-2) AS q1, quantile_cont(o_totalprice, 75e-2) AS q3, avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd, count(*) AS n FROM orders GROUP BY 1),
j AS (SELECT o_orderkey, o_totalprice AS v, q.*, abs(o_totalprice - mu) / nullif(sd, 0) AS z, greatest(0e0, q1 - o_totalprice, o_totalprice - q3) / (q3 - q1 + 1e-6) AS f FROM orders JOIN q USING (o_custkey))
SELECT o_orderkey, CASE WHEN n >= 2 THEN n >= 3 AND (v < q1 - 15e-1 * (q3 - q1) OR v > q3 + 15e-1 * (q3 - q1)) END AS is_iqr_outlier, CASE WHEN n >= 2 THEN n >= 3 AND coalesce(z > 25e-1, false) END AS is_z_outlier,
 CASE WHEN n >= 2 THEN CASE WHEN n >= 3 AND sd > 0 THEN round(least(5e-1 * least(z, 5e0) / 5 + 5e-1 * least(f, 5e0) / 5, 1e0), 6) ELSE 0e0 END END AS outlier_score FROM j""")
def replicate_outliers(t):
    out = D.outlier_flags(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice")
    return out.select("o_orderkey", "is_iqr_outlier", "is_z_outlier", F.round("outlier_score", 6).alias("outlier_score"))


DEDUP_SQL = f"""{meas_sql('compound_id', 'source_id', 'kind', 'qualifier_raw', 'value_nm', 'pct', 'ord', 'price')},
d AS (SELECT *, floor(CASE WHEN kind = 'pct_inhibition' THEN pct ELSE price / 2e4 END)::INT AS dedup_value FROM meas)"""


def dedup_rows(t):
    rows = measurements(t, "compound_id", "source_id", "kind", "qualifier_raw", "value_nm", "pct", "ord", "price")
    value = F.when(F.col("kind") == "pct_inhibition", F.col("pct")).otherwise(F.col("price") / 2e4)
    return rows.withColumn("dedup_value", F.floor(value).cast("int"))


@query("W04", f"""
WITH {DEDUP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY compound_id, source_id, kind, qualifier_raw, dedup_value ORDER BY ord, price) AS rn FROM d)
SELECT compound_id, source_id, kind, qualifier_raw, dedup_value, ord FROM r WHERE rn = 1""")
def dedup_keep_first(t):
    return D.keep_first(dedup_rows(t), DEDUP_KEYS, F.col("ord"), F.col("price")).select(*DEDUP_KEYS, "ord")


@query("W04", f"""
WITH {DEDUP_SQL}, f AS (SELECT *, count(*) OVER (PARTITION BY compound_id, kind, qualifier_raw, dedup_value) > 1 AND kind IN ('IC50', 'Ki') AS dup FROM d)
SELECT kind, dup AS cross_source_dup, count(*) AS n, sum(ord)::BIGINT AS ord_sum FROM f GROUP BY 1, 2""")
def dup_flag_all(t):
    out = D.flag_repeated(dedup_rows(t), ["compound_id", "kind", "qualifier_raw", "dedup_value"], "dup")
    return out.groupBy("kind", (F.col("dup") & F.col("kind").isin("IC50", "Ki")).alias("cross_source_dup")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ord_sum"))


@query("W05 T06", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END, o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn = 1""")
def dedup_priority(t):
    flag = F.when(F.col("o_orderstatus") == "F", "Defined").when(F.col("o_orderstatus") == "O", " achiral ").otherwise("other")
    rows = t("orders").withColumn("flag", flag)
    return D.dedup_by_priority(rows, "o_custkey", "flag", "o_totalprice", "o_orderkey", max_loss=None).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("W06 A23", """
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT n AS size, count(*) AS k, count(*) * n AS rows FROM s GROUP BY 1)
SELECT size, k AS n_groups, round(sum(k) OVER (ORDER BY size) / sum(k) OVER ()::DOUBLE, 6) AS group_share, round(sum(rows) OVER (ORDER BY size) / sum(rows) OVER ()::DOUBLE, 6) AS row_share FROM h""")
def lorenz_curve(t):
    sizes = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    shape = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("rows"))
    run = O.running_totals(shape, [], "size", ["n_groups", "rows"])
    return run.select("size", "n_groups", F.round(F.col("cum_n_groups") / F.col("all_n_groups"), 6).alias("group_share"),
                      F.round(F.col("cum_rows") / F.col("all_rows"), 6).alias("row_share"))


@query("W08", f"""
WITH {comp_sql('compound_id', 'activity')}, r AS (SELECT compound_id, row_number() OVER (ORDER BY activity, compound_id) - 1 AS pos, count(*) OVER () AS m FROM comp), k AS (SELECT DISTINCT floor(i * (m - 1) / 149)::BIGINT AS pos FROM range(0, 150) x(i), (SELECT any_value(m) AS m FROM r))
SELECT compound_id, pos FROM r SEMI JOIN k USING (pos)""")
def linspace_pick(t):
    rows = O.positions(compounds(t, "compound_id", "activity"), [], "activity", "compound_id")
    size = rows.agg(F.count(F.lit(1)).alias("m"))
    hit = D.linspace_hit(F.col("pos"), F.col("m"), F.lit(150))
    return O.attach_scalars(rows, size).filter(hit).select("compound_id", "pos")


@query("W09", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0e0, 2e-1, 4e-1, 6e-1, 8e-1, 1e0]) AS e FROM orders)
SELECT o_orderkey, greatest((o_totalprice > e[1])::INT + (o_totalprice > e[2])::INT + (o_totalprice > e[3])::INT + (o_totalprice > e[4])::INT + (o_totalprice > e[5])::INT - 1, 0) AS bin FROM orders, e""")
def qcut_bins(t):
    return D.quantile_bins(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5, "bin").select("o_orderkey", "bin")


@query("W11", f"""
WITH {pred_sql()}, c AS (SELECT strategy, CAST(p * 20 AS INT) AS grid, round(avg(abs(y_true - y_pred)), 3) AS score FROM pred GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score, grid) AS rn FROM c)
SELECT strategy, grid, score FROM r WHERE rn = 1""")
def best_config(t):
    rows = predictions(t, "strategy", "p", "y_true", "y_pred")
    cells = rows.groupBy("strategy", F.round(F.col("p") * 20).cast("int").alias("grid")).agg(
        F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 3).alias("score"))
    return D.keep_first(cells, ["strategy"], F.col("score"), F.col("grid"))


@query("T01 T05", """
SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, p_brand, p_type""")
def ordered_categories(t):
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in ("SMALL", "MEDIUM", "LARGE")]), F.col("p_type")), F.lit(0)), F.lit(9))
    return t("part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(rank, "p_brand", "p_type")


@query("T03 T04", """
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) SELECT user_id, event_id, value FROM r WHERE rn <= 3""")
def top_k_rows(t):
    e = t("events").select("user_id", "event_id", "value")
    return D.keep_first(e, ["user_id"], F.desc("value"), F.col("event_id"), k=3)


def two_sides(t):
    return t("orders").select(F.col("o_custkey").alias("id")).distinct(), t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))


@query("U02", "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(t):
    a, b = two_sides(t)
    return a.intersect(b)


@query("U03", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except(t):
    a, b = two_sides(t)
    return a.subtract(b)


@query("U04 Q08", """
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), j AS (SELECT a.id AS l, b.id AS r FROM a FULL JOIN b USING (id))
SELECT count(l) AS n_left, count(r) AS n_right, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_shared, count(*) FILTER (WHERE r IS NULL) AS n_left_only, count(*) FILTER (WHERE l IS NULL) AS n_right_only,
 count(*) AS n_union, count(*) FILTER (WHERE r IS NULL) = 0 AS is_subset, count(*) FILTER (WHERE r IS NULL OR l IS NULL) = 0 AS is_equal FROM j""")
def set_relation(t):
    a, b = two_sides(t)
    o = Q.overlap(a, b, "id")
    return o.select("*", (F.col("n_shared") + F.col("n_left_only") + F.col("n_right_only")).alias("n_union"),
                    (F.col("n_left_only") == 0).alias("is_subset"), (F.col("n_left_only") + F.col("n_right_only") == 0).alias("is_equal"))
