"""Findings, verdicts and narratives as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.functions import expressions as X
from tidegauge.operators import audit as Q
from tidegauge.operators import aggregate as A
from tidegauge.operators.ordered import attach_scalars
from tidegauge.plans.scalars import TIER_SQL, tier_table
from tidegauge.registry import query


@query("Q01", f"""
WITH {TIER_SQL}, t1 AS (SELECT * FROM tiered WHERE tier = 'T1'), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE activity NOT BETWEEN 2 AND 12) AS a, count(*) FILTER (WHERE kind = 'Ki') AS b, count(*) FILTER (WHERE unit_flag IN ('suspicious', 'unknown')) AS u,
 count(*) FILTER (WHERE stereo_flag NOT IN ('defined', 'achiral')) AS s FROM t1)
SELECT 'range' AS category, 'activity outside valid range' AS "check", CASE WHEN a > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, a AS value, n FROM c UNION ALL SELECT 'type', 'Ki in tier one', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, n FROM c
UNION ALL SELECT 'unit', 'suspicious or unknown units', CASE WHEN u > 0 THEN 'WARN' ELSE 'PASS' END, u, n FROM c UNION ALL SELECT 'stereo', 'undefined stereo', CASE WHEN s > 100 THEN 'WARN' ELSE 'PASS' END, s, n FROM c""")
def qc_findings(t):
    return Q.findings(tier_table(t, "activity", "kind", "unit_flag", "stereo_flag").filter("tier = 'T1'"), [
        ("range", "activity outside valid range", ~X.in_activity_range(F.col("activity")), "FAIL", 0),
        ("type", "Ki in tier one", F.col("kind") == "Ki", "FAIL", 0),
        ("unit", "suspicious or unknown units", F.col("unit_flag").isin("suspicious", "unknown"), "WARN", 0),
        ("stereo", "undefined stereo", ~F.col("stereo_flag").isin("defined", "achiral"), "WARN", 100)])


@query("Q02", """
SELECT 'positive' AS stage, (SELECT count(*) FROM orders) AS rows_in, (SELECT count(*) FROM orders WHERE o_totalprice > 1e5) AS rows_out, (SELECT count(*) FROM orders WHERE o_totalprice <= 1e5) AS dropped
UNION ALL SELECT 'final', (SELECT count(*) FROM orders WHERE o_totalprice > 1e5), (SELECT count(*) FROM orders WHERE o_totalprice > 1e5 AND o_orderstatus = 'F'), (SELECT count(*) FROM orders WHERE o_totalprice > 1e5 AND o_orderstatus <> 'F')""")
def stage_log(t):
    first, second = F.col("o_totalprice") > 1e5, F.col("o_orderstatus") == "F"
    return Q.stage_log(t("orders"), [("positive", first), ("final", second)])


@query("Q03 Q08 D15", """
WITH f AS (SELECT 'orders' AS category, 'customer missing from dimension' AS "check", count(*) FILTER (WHERE c_custkey IS NULL) AS value, 'FAIL' AS bad FROM orders LEFT JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'orders', 'duplicate order keys', count(*) - count(DISTINCT o_orderkey), 'FAIL' FROM orders UNION ALL SELECT 'lineitem', 'discount above 0.1', count(*) FILTER (WHERE l_discount > 1e-1), 'WARN' FROM lineitem
 UNION ALL SELECT 'part', 'sources without parts', count(*) FILTER (WHERE p_partkey IS NULL), 'WARN' FROM supplier LEFT JOIN part ON s_suppkey = p_partkey)
SELECT category, "check", CASE WHEN value > 0 THEN bad ELSE 'PASS' END AS verdict, value FROM f""")
def section_audit(t):
    def line(category, check, bad, counted):
        return counted.select(F.lit(category).alias("category"), F.lit(check).alias("check"),
                              F.when(F.col("value") > 0, bad).otherwise("PASS").alias("verdict"), "value")
    n = lambda df: df.agg(F.count(F.lit(1)).alias("value"))
    orphans = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    repeated = t("orders").groupBy("o_orderkey").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra").alias("value"))
    unmatched = t("supplier").join(t("part"), F.col("s_suppkey") == F.col("p_partkey"), "left_anti")
    return (line("orders", "customer missing from dimension", "FAIL", n(orphans))
            .unionByName(line("orders", "duplicate order keys", "FAIL", repeated))
            .unionByName(line("lineitem", "discount above 0.1", "WARN", n(t("lineitem").filter("l_discount > 0.1"))))
            .unionByName(line("part", "sources without parts", "WARN", n(unmatched))))


@query("Q05 J20", """
WITH c AS (SELECT o_orderpriority AS candidate, o_custkey AS id, o_totalprice AS v FROM orders UNION ALL SELECT 'empty', NULL, NULL UNION ALL SELECT 'inside', c_custkey, 1e0 FROM customer WHERE c_custkey % 3 <> 0),
m AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 0), s AS (SELECT candidate, count(DISTINCT c.id) AS n_ids, count(DISTINCT CASE WHEN m.id IS NULL THEN c.id END) AS n_outside, count(v) AS n_labelled FROM c LEFT JOIN m ON c.id = m.id GROUP BY 1)
SELECT *, CASE WHEN n_ids = 0 THEN 'EMPTY' WHEN n_outside = 0 THEN 'SUBSET' WHEN n_outside < 10 THEN 'TOO SMALL' WHEN n_labelled = 0 THEN 'INCOMPATIBLE LABELS' ELSE 'CURATION SENSITIVITY' END AS verdict FROM s""")
def external_verdict(t):
    orders = t("orders").select(F.col("o_orderpriority").alias("candidate"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"))
    nothing = t("region").agg(F.count(F.lit(1))).select(F.lit("empty").alias("candidate"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("value"))
    inside = t("customer").filter("c_custkey % 3 <> 0").select(F.lit("inside").alias("candidate"), F.col("c_custkey").alias("id"), F.lit(1.0).alias("value"))
    modelled = t("customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"))
    return Q.external_verdicts(orders.unionByName(nothing).unionByName(inside), modelled, "candidate", "id", "value")


TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "embeddings": [], "pages": ["url", "html"], "benchmark": ["text"], "labels": [], "conversations": ["role", "text"],
}


@query("Q06 S20", "WITH h AS (" + " UNION ALL ".join(
    f"SELECT '{table}' AS place, count(*) FILTER (WHERE {' OR '.join(f"contains({c}, 'license')" for c in columns) or 'false'}) AS n FROM {table}" for table, columns in TEXT_COLUMNS.items()) + """)
SELECT sum(n)::BIGINT AS total_hits, string_agg(place || '(' || n || ')', '; ' ORDER BY place) FILTER (WHERE n > 0) AS places, CASE WHEN sum(n) = 0 THEN 'B' ELSE 'C' END AS outcome FROM h""")
def presence_verdict(t):
    hits = None
    for name in TEXT_COLUMNS:
        frame = t(name)
        texts = [f.name for f in frame.schema.fields if f.dataType.typeName() == "string"]
        found = F.lit(False)
        for c in texts:
            found = found | X.yes(F.col(c).contains("license"))
        part = frame.agg(F.lit(name).alias("place"), F.count_if(found).alias("n"))
        hits = part if hits is None else hits.unionByName(part)
    return Q.presence_verdict(hits, flagged=F.lit(False))


@query("Q07", f"""
WITH {TIER_SQL} SELECT source_db, CASE WHEN dose_response THEN 'high' WHEN is_mouse THEN 'low' ELSE 'none' END AS confidence, count(*) AS n, count(DISTINCT compound_id) AS n_compounds FROM tiered WHERE tier IN ('T1', 'T2') GROUP BY 1, 2""")
def flag_inspection(t):
    level = X.first_rule([(F.col("dose_response"), "high"), (F.col("is_mouse"), "low")], "none")
    rows = tier_table(t, "source_db", "dose_response", "is_mouse", "compound_id")
    return rows.filter(F.col("tier").isin("T1", "T2")).groupBy("source_db", level.alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("compound_id").alias("n_compounds"))


@query("Q10", """
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, sum(n) OVER (ORDER BY n, o_custkey ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS t FROM s),
m AS (SELECT count(*) FILTER (WHERE n = 1) / count(*)::DOUBLE AS singles, (count(*) + 1 - 2 * sum(c) / max(t)) / count(*) AS gini, sum(n) FILTER (WHERE n >= 10) / sum(n)::DOUBLE AS frequent FROM r)
SELECT CASE WHEN singles > 7e-1 THEN 'Most groups hold one row.' WHEN singles > 5e-1 THEN 'Many groups hold one row.' ELSE 'Few groups hold one row.' END
 || CASE WHEN gini > 6e-1 THEN ' A few groups dominate.' ELSE '' END || CASE WHEN coalesce(frequent, 0) > 4e-1 THEN ' Frequent groups hold many rows.' ELSE '' END AS narrative FROM m""")
def narrative(t):
    rows = t("orders")
    sizes = A.group_sizes(rows, "o_custkey")
    shares = sizes.agg((F.count_if(F.col("size") == 1) / F.count(F.lit(1))).alias("singles"),
                       (F.sum(F.when(F.col("size") >= K.FREQUENT_GROUP_FROM, F.col("size")).otherwise(0)) / F.sum("size")).alias("frequent"))
    m = attach_scalars(shares, A.concentration(rows, "o_custkey", {"half": 0.5}))
    first = X.first_rule([(F.col("singles") > 0.7, "Most groups hold one row."), (F.col("singles") > 0.5, "Many groups hold one row.")], "Few groups hold one row.")
    return m.select(F.concat_ws(" ", first, F.when(F.col("gini") > 0.6, "A few groups dominate."),
                                F.when(F.col("frequent") > 0.4, "Frequent groups hold many rows.")).alias("narrative"))
