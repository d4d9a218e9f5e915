"""Vote, fallback, guard, routing and overlap joins on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.functions import expressions as X
from tidegauge.operators import audit as Q
from tidegauge.operators import joins as J
from tidegauge.plans.standins import comp_sql, compounds, meas_sql, measurements, pred_sql, predictions
from tidegauge.registry import query

# Orders play stereo records: the customer is the short key, the priority the full id.
ISO_SQL = """iso AS (SELECT o_orderkey AS ord, o_custkey AS k14, o_orderpriority AS full_id, o_orderstatus AS flag, 'S' || o_orderkey AS smiles, o_custkey % 40 * 100 + o_orderkey % 90 AS scaffold,
  CASE o_orderkey % 3 WHEN 0 THEN 'BindingDB' WHEN 1 THEN 'ChEMBL' ELSE 'PubChem' END AS source_db FROM orders)"""


def isomers(t):
    db = F.when(F.col("o_orderkey") % 3 == 0, "BindingDB").when(F.col("o_orderkey") % 3 == 1, "ChEMBL").otherwise("PubChem")
    return t("orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("k14"), F.col("o_orderpriority").alias("full_id"),
        F.col("o_orderstatus").alias("flag"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("smiles"),
        (F.col("o_custkey") % 40 * 100 + F.col("o_orderkey") % 90).alias("scaffold"), db.alias("source_db"))


VOTE_SQL = f"""{ISO_SQL}, v AS (SELECT k14, full_id, round(count(*) + sum(CASE source_db WHEN 'BindingDB' THEN 1e0 WHEN 'ChEMBL' THEN 9e-1 ELSE 6e-1 END), 9) AS score, arg_min(smiles, ord) AS smiles, arg_min(source_db, ord) AS src FROM iso WHERE flag = 'F' GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY k14 ORDER BY score DESC, full_id) AS rn, count(*) OVER (PARTITION BY k14) AS k FROM v)"""


def voted(t):
    weight = X.lookup(F.col("source_db"), K.SOURCE_RELIABILITY, K.SOURCE_RELIABILITY_DEFAULT)
    return J.vote_resolve(isomers(t), "k14", "full_id", "smiles", "source_db", F.col("flag") == "F", F.col("flag") != "F", weight, "ord")


@query("J01", f"""
WITH {VOTE_SQL} SELECT i.ord, coalesce(i.flag <> 'F' AND b.k14 IS NOT NULL, false) AS resolved, CASE WHEN i.flag <> 'F' THEN b.full_id END AS resolved_id, CASE WHEN i.flag <> 'F' THEN b.smiles END AS resolved_payload,
 CASE WHEN i.flag <> 'F' THEN CASE WHEN k > 1 THEN 'conflicting(' || src || ')' ELSE src END END AS resolved_source FROM iso i LEFT JOIN b ON i.k14 = b.k14 AND b.rn = 1""")
def vote_resolve(t):
    return voted(t).select("ord", "resolved", "resolved_id", "resolved_payload", "resolved_source")


@query("J02", f"""
WITH {VOTE_SQL}, r AS (SELECT i.*, i.flag <> 'F' AND b.k14 IS NOT NULL AND i.k14 % 2 = 0 AS resolved, CASE WHEN i.flag <> 'F' AND i.k14 % 2 = 0 THEN b.full_id END AS rid FROM iso i LEFT JOIN b ON i.k14 = b.k14 AND b.rn = 1),
u AS (SELECT scaffold, min(full_id) AS only_id FROM iso WHERE flag = 'F' GROUP BY 1 HAVING count(*) = 1)
SELECT ord, resolved OR (flag <> 'F' AND only_id IS NOT NULL) AS resolved, coalesce(rid, CASE WHEN NOT resolved AND flag <> 'F' THEN only_id END) AS resolved_id,
 CASE WHEN resolved THEN 95e-2 WHEN flag <> 'F' AND only_id IS NOT NULL THEN 65e-2 END AS resolved_confidence FROM r LEFT JOIN u USING (scaffold)""")
def unique_fallback(t):
    even = F.col("k14") % 2 == 0
    weight = X.lookup(F.col("source_db"), K.SOURCE_RELIABILITY, K.SOURCE_RELIABILITY_DEFAULT)
    first = J.vote_resolve(isomers(t), "k14", "full_id", "smiles", "source_db", F.col("flag") == "F", (F.col("flag") != "F") & even, weight, "ord")
    out = J.unique_fallback(first, "scaffold", "full_id", F.col("flag") == "F", F.col("flag") != "F")
    return out.select("ord", "resolved", "resolved_id", "resolved_confidence")


@query("P04", """
WITH v AS (SELECT p_brand, p_name, sum(p_size % 3) AS q FROM part GROUP BY 1, 2), m AS (SELECT p_brand, p_name AS chosen, row_number() OVER (PARTITION BY p_brand ORDER BY q, length(p_name), p_name) AS rn FROM v)
SELECT p_partkey, chosen FROM part JOIN m USING (p_brand) WHERE rn = 1""")
def conflict_min_by(t):
    values = t("part").groupBy("p_brand", "p_name").agg(F.sum(F.col("p_size") % 3).alias("q"))
    best = values.groupBy("p_brand").agg(F.min_by("p_name", F.struct("q", F.length("p_name"), "p_name")).alias("chosen"))
    return t("part").select("p_partkey", "p_brand").join(best, "p_brand").select("p_partkey", "chosen")


@query("J03 J04", """
WITH r AS (SELECT o_custkey, avg(o_totalprice) AS price, bool_or(o_orderstatus = 'F') AS final, min(o_orderpriority) AS priority FROM orders GROUP BY 1)
SELECT c_custkey, round(price, 6) AS price, final, priority FROM customer LEFT JOIN r ON c_custkey = o_custkey""")
def guarded_left_join(t):
    right = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"),
                               (F.col("o_orderstatus") == "F").alias("final"), F.col("o_orderpriority").alias("priority"))
    out = J.guarded_left_join(t("customer").select("c_custkey"), right, "c_custkey")
    return out.select("c_custkey", F.round("price", 6).alias("price"), "final", "priority")


@query("J06", f"""
WITH {meas_sql('compound_id', 'source_id', 'kind')} SELECT compound_id, count(*) AS n FROM meas WHERE compound_id IN (SELECT compound_id FROM meas WHERE kind = 'Ki' GROUP BY 1 HAVING count(DISTINCT source_id) >= 2) GROUP BY 1""")
def semi_anchor(t):
    from tidegauge.operators.aggregate import multi_source_keys
    rows = measurements(t, "compound_id", "source_id", "kind")
    anchors = multi_source_keys(rows.filter("kind = 'Ki'"), "compound_id", "source_id")
    return rows.join(anchors, "compound_id", "left_semi").groupBy("compound_id").agg(F.count(F.lit(1)).alias("n"))


@query("J07", """
WITH m AS (SELECT o_custkey, median(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o_orderkey, round(o_totalprice - m, 6) AS residual FROM orders JOIN m USING (o_custkey)""")
def group_median_resid(t):
    from tidegauge.operators.ordered import quantiles
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(quantiles(o, ["o_custkey"], "o_totalprice", {"m": 0.5}), "o_custkey").select(
        "o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 6).alias("residual"))


@query("J13 J15", """
WITH i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM customer WHERE c_custkey % 3 <> 0), g AS (SELECT c_nationkey AS k, min(CASE WHEN c_nationkey < 12 THEN 'train' ELSE 'val' END) AS split FROM customer WHERE c_nationkey < 20 GROUP BY 1)
SELECT c_custkey, coalesce(i.split, g.split, 'unassigned') AS split FROM customer LEFT JOIN i ON c_custkey = i.id LEFT JOIN g ON c_nationkey = g.k""")
def route_coalesce(t):
    c = t("customer").select("c_custkey", "c_nationkey")
    by_id = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 10 < 7, "train").otherwise("test").alias("split"))
    by_group = c.filter("c_nationkey < 20").select("c_nationkey", F.when(F.col("c_nationkey") < 12, "train").otherwise("val").alias("split"))
    return J.route(c, by_id, by_group, "c_custkey", "c_nationkey").select("c_custkey", "split")


@query("J14", """
WITH a AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, a.v AS left_value, b.v AS right_value FROM a JOIN b USING (k) WHERE a.v <> b.v""")
def consistency_inner(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_orderkey")
    return J.conflicting_pairs(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "k", "v")


@query("J15 J21 Q04", """
WITH s AS (SELECT l_partkey AS id, l_suppkey AS g, CASE WHEN l_orderkey % 20 < 17 THEN 'train' ELSE 'test' END AS split FROM lineitem), a AS (SELECT DISTINCT id FROM s WHERE split = 'train'), b AS (SELECT DISTINCT id FROM s WHERE split = 'test'), j AS (SELECT a.id AS l, b.id AS r FROM a FULL JOIN b USING (id))
SELECT count(l) AS n_left, count(r) AS n_right, count(*) FILTER (WHERE l = r) AS n_shared, count(*) FILTER (WHERE r IS NULL) AS n_left_only, count(*) FILTER (WHERE l IS NULL) AS n_right_only FROM j""")
def overlap_counts(t):
    s = t("lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") % 20 < 17).alias("train"))
    return Q.overlap(s.filter("train"), s.filter("NOT train"), "id")


# Edges: consecutive order pairs of one customer region, ends are parts.
EDGE_SQL = """edges AS (SELECT DISTINCT l_partkey AS src, (l_partkey * 3 + l_suppkey) % (SELECT count(*) FROM part) AS dst FROM lineitem)"""


def edges(t):
    from tidegauge.operators.ordered import attach_scalars
    line = t("lineitem").select("l_partkey", "l_suppkey")
    sized = attach_scalars(line, t("part").agg(F.count(F.lit(1)).alias("n")))
    return sized.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % F.col("n")).alias("dst")).distinct()


@query("J16", f"""
WITH {EDGE_SQL}, m AS (SELECT p_partkey AS id, p_partkey % 10 < 6 AS tr, p_partkey % 10 >= 8 AS te FROM part)
SELECT count(*) AS n_total, count(*) FILTER (WHERE a.tr OR a.te OR b.tr OR b.te) AS n_relevant, count(*) FILTER (WHERE a.tr AND b.tr) AS both_train, count(*) FILTER (WHERE a.te AND b.te) AS both_test,
 count(*) FILTER (WHERE (a.tr AND b.te) OR (a.te AND b.tr)) AS straddle, round(count(*) FILTER (WHERE (a.tr AND b.te) OR (a.te AND b.tr)) / greatest(count(*) FILTER (WHERE a.tr OR a.te OR b.tr OR b.te), 1)::DOUBLE, 4) AS straddle_share
FROM edges JOIN m a ON src = a.id JOIN m b ON dst = b.id""")
def pair_straddle(t):
    split = F.when(F.col("p_partkey") % 10 < 6, "train").when(F.col("p_partkey") % 10 < 8, "val").otherwise("test")
    return J.straddle_counts(edges(t), t("part").select(F.col("p_partkey").alias("id"), split.alias("split")), "src", "dst", "id")


@query("J17", f"""
WITH {EDGE_SQL}, {comp_sql()}, v AS (SELECT src, dst, CASE WHEN a.activity <= b.activity THEN 1 ELSE -1 END AS s FROM edges JOIN comp a ON src = a.compound_id JOIN comp b ON dst = b.compound_id),
u AS (SELECT src AS compound_id, s AS v FROM v UNION ALL SELECT dst, -s FROM v) SELECT compound_id, sum(v)::BIGINT AS votes, count(*) AS n_edges FROM u GROUP BY 1""")
def edge_votes(t):
    return J.edge_votes(edges(t), compounds(t, "compound_id", "activity"), "src", "dst", "compound_id", "activity")


@query("J18", """
WITH r AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT avg(v) AS m FROM r), j AS (SELECT o_orderkey AS id, o_orderstatus, coalesce(v, m) AS filled, v IS NOT NULL AS covered FROM orders LEFT JOIN r ON o_orderkey = id, f)
SELECT o_orderstatus, round(avg(filled), 4) AS mean_filled, round(avg(covered::INT), 6) AS coverage FROM j GROUP BY 1""")
def left_fill_coverage(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_totalprice").alias("v"))
    right = o.filter("id % 3 <> 0")
    out = J.left_fill(o.select("id", "o_orderstatus"), right, "id", "v", right.agg(F.avg("v")), "filled")
    return out.groupBy("o_orderstatus").agg(F.round(F.avg("filled"), 4).alias("mean_filled"), F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage"))


@query("J19", f"""
WITH {pred_sql()}, a AS (SELECT strategy, variant, avg(p) AS s FROM pred GROUP BY 1, 2), b AS (SELECT strategy, variant, avg(similarity) AS s FROM pred GROUP BY 1, 2)
SELECT a.strategy, a.variant, round(a.s - b.s, 6) AS lift FROM a JOIN b ON a.strategy = b.strategy AND a.variant = b.variant""")
def lift_join(t):
    rows = predictions(t, "strategy", "variant", "p", "similarity")
    a = rows.groupBy("strategy", "variant").agg(F.avg("p").alias("s1"))
    b = rows.groupBy("strategy", "variant").agg(F.avg("similarity").alias("s0"))
    return a.join(b, ["strategy", "variant"]).select("strategy", "variant", F.round(F.col("s1") - F.col("s0"), 6).alias("lift"))


@query("J20", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 3e5)")
def anti_outside(t):
    busy = t("orders").filter("o_totalprice > 3e5").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(busy, "c_custkey", "left_anti")


@query("J22 M19", """
WITH f AS (SELECT l_partkey AS k, avg(l_quantity) AS q, count(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_orderkey % 20 < 14 GROUP BY 1)
SELECT p_partkey, round(coalesce(q, 0), 6) AS mean_quantity, coalesce(s, 0) AS n_sources FROM part LEFT JOIN f ON p_partkey = k""")
def train_agg_apply(t):
    fitted = t("lineitem").filter("l_orderkey % 20 < 14").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.avg("l_quantity").alias("mean_quantity"), F.countDistinct("l_suppkey").alias("n_sources"))
    return J.apply_train_aggregates(t("part").select("p_partkey"), fitted, "p_partkey").withColumn("mean_quantity", F.round("mean_quantity", 6))


@query("J23", """
WITH r AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS n, count(o_custkey) AS n_covered, round(count(o_custkey) / count(*)::DOUBLE, 6) AS coverage FROM customer LEFT JOIN r ON c_custkey = o_custkey""")
def coverage_ratio(t):
    rep = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k")).filter("k >= 2")
    return t("customer").select("c_custkey").join(rep, "c_custkey", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("k").alias("n_covered"), F.round(F.count("k") / F.count(F.lit(1)), 6).alias("coverage"))


@query("J24", f"""
WITH {EDGE_SQL}, m AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), t AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 >= 8)
SELECT count(*) AS n_test, count(m.id) AS n_members, round(count(m.id) / count(*)::DOUBLE, 6) AS fraction FROM t LEFT JOIN m USING (id)""")
def edge_member_fraction(t):
    members = J.edge_members(edges(t), "src", "dst", "id").withColumn("hit", F.lit(1))
    test = t("part").filter("p_partkey % 10 >= 8").select(F.col("p_partkey").alias("id"))
    return test.join(members, "id", "left").agg(
        F.count(F.lit(1)).alias("n_test"), F.count("hit").alias("n_members"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("fraction"))


@query("J21", """
WITH a AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 < 6), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey * 7 % 10 >= 9 THEN 'val' WHEN p_partkey * 7 % 10 >= 7 THEN 'test' ELSE 'train' END AS split FROM part)
SELECT split, count(*) AS n, count(a.id) AS n_leaked, count(a.id) = 0 AS stacking_safe FROM b LEFT JOIN a USING (id) WHERE split <> 'train' GROUP BY 1""")
def cross_task_leakage(t):
    """Held-out ids of one task that another task trains on."""
    trained = t("part").filter("p_partkey % 10 < 6").select(F.col("p_partkey").alias("id"), F.lit(1).alias("hit"))
    turn = F.col("p_partkey") * 7 % 10
    held = t("part").select(F.col("p_partkey").alias("id"), F.when(turn >= 9, "val").when(turn >= 7, "test").otherwise("train").alias("split")).filter("split <> 'train'")
    return held.join(trained, "id", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_leaked"), (F.count("hit") == 0).alias("stacking_safe"))
