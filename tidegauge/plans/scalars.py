"""Projections, filters, scalar derivations and text scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.functions import expressions as X
from tidegauge.plans.standins import CLEAN_SQL, comp_sql, compounds, meas_sql, measurements
from tidegauge.registry import query
from tidegauge.session import stage


def with_activity(frame):
    """Clean qualifier and exact log activity next to the measurement columns."""
    frame = frame.withColumn("qualifier", X.normal_qualifier(F.col("qualifier_raw")))
    return frame.withColumn(
        "activity", X.exact_activity(F.col("value_nm"), F.col("qualifier"), F.col("kind"))
    )


FORMATS = {"ECONOMY": "A", "STANDARD": "B", "PROMO": "C", "SMALL": "D", "MEDIUM": "E"}


@query("S02", """
SELECT CASE p_type WHEN 'ECONOMY' THEN 'A' WHEN 'STANDARD' THEN 'B' WHEN 'PROMO' THEN 'C'
       WHEN 'SMALL' THEN 'D' WHEN 'MEDIUM' THEN 'E' ELSE '?' END AS format,
       count(*) AS n, sum(p_size)::BIGINT AS total_size
FROM part GROUP BY 1""")
def dispatch_case(t):
    kind = X.lookup(F.col("p_type"), FORMATS, "?")
    return t("part").groupBy(kind.alias("format")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total_size"))


@query("S04 S09", """
WITH r AS (SELECT o_orderkey, lower(o_orderpriority) AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'nm' WHEN o_orderstatus = 'O' THEN 'um' END AS unit,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_totalprice - 1e3 END AS std_val,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice / 1e3 END AS alt_val FROM orders),
v AS (SELECT *, CASE WHEN unit = 'nm' AND std_val IS NOT NULL THEN std_val
                     WHEN alt_val IS NOT NULL THEN alt_val * 1e3 END AS nm,
                CASE WHEN unit = 'nm' AND std_val IS NOT NULL THEN 1 WHEN alt_val IS NOT NULL THEN 1000 END AS factor
      FROM r)
SELECT o_orderkey, round(nm, 4) AS value_nm, factor,
       CASE WHEN kind LIKE '%high%' THEN 'IC50' WHEN kind LIKE '%low%' THEN 'Ki' ELSE upper(kind) END AS kind
FROM v WHERE nm > 0""")
def unit_coalesce(t):
    kind = F.lower("o_orderpriority")
    unit = F.when(F.col("o_orderstatus") == "F", "nm").when(F.col("o_orderstatus") == "O", "um")
    std = F.when(F.col("o_custkey") % 11 != 0, F.col("o_totalprice") - 1e3)
    alt = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") / 1e3)
    direct = (unit == "nm") & std.isNotNull()
    nm = F.when(direct, std).when(alt.isNotNull(), alt * 1e3)
    return t("orders").select(
        "o_orderkey", F.round(nm, 4).alias("value_nm"),
        F.when(direct, 1).when(alt.isNotNull(), 1000).alias("factor"),
        X.first_rule([(kind.contains("high"), "IC50"), (kind.contains("low"), "Ki")], F.upper(kind)).alias("kind"),
    ).filter(F.col("value_nm") > 0)


@query("S05 S06", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey,
   CASE WHEN l_discount > 3e-2 THEN (l_discount - 5e-2) * 1e3 END AS ki,
   CASE WHEN l_tax > 1e-2 THEN l_extendedprice END AS ic50 FROM lineitem),
v AS (SELECT *, CASE WHEN ki IS NOT NULL THEN 'Ki' WHEN ic50 IS NOT NULL THEN 'IC50' END AS kind,
                coalesce(ki, ic50) AS value FROM r)
SELECT l_partkey, kind, count(*) AS n, round(sum(value), 3) AS total
FROM v WHERE value > 0 GROUP BY 1, 2""")
def first_nonnull(t):
    ki = F.when(F.col("l_discount") > 0.03, (F.col("l_discount") - 0.05) * 1e3)
    ic50 = F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice"))
    tag = lambda c, name: F.when(c.isNotNull(), F.struct(F.lit(name).alias("kind"), c.alias("value")))
    first = F.coalesce(tag(ki, "Ki"), tag(ic50, "IC50"))
    return (t("lineitem").select("l_partkey", first.alias("r")).filter(F.col("r.value") > 0)
            .groupBy("l_partkey", F.col("r.kind").alias("kind"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r.value"), 3).alias("total")))


@query("S07", """
SELECT c_custkey, greatest(least(c_acctbal / 5e1, 1e2), 0e0) AS clipped,
       c_acctbal / 5e1 > 100 AS artifact_high, c_acctbal < 0 AS artifact_low
FROM customer WHERE abs(c_acctbal / 5e1) >= 5""")
def clip_flags(t):
    raw = F.col("c_acctbal") / 50.0
    return t("customer").filter(F.abs(raw) >= K.SCREEN_MIN_INFORMATIVE).select(
        "c_custkey", X.clip(raw, 0.0, 100.0).alias("clipped"),
        (raw > 100).alias("artifact_high"), (raw < 0).alias("artifact_low"))


PANEL_TARGETS = [("red", "T1"), ("blue", "T2"), ("small", "T3")]
PANEL_TAGS = [("ring", "G1"), ("widget", "G2")]


@query("S08", """
WITH m AS (SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 'T1' WHEN p_name LIKE '%blue%' THEN 'T2'
  WHEN p_name LIKE '%small%' THEN 'T3' WHEN p_name LIKE '%ring%' THEN 'G1' WHEN p_name LIKE '%widget%' THEN 'G2' END AS target
  FROM part)
SELECT * FROM m WHERE target IS NOT NULL""")
def panel_demux(t):
    rules = [(F.col("p_name").contains(w), label) for w, label in PANEL_TARGETS + PANEL_TAGS]
    return t("part").select("p_partkey", X.first_rule(rules).alias("target")).filter("target IS NOT NULL")


@query("S10 S11", """
WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey,
   CASE WHEN l_returnflag = 'R' THEN '>=' || l_quantity::INT WHEN l_returnflag = 'A' THEN '< ' || l_quantity::INT
        ELSE CAST(l_quantity::INT AS VARCHAR) END AS ic50,
   CASE WHEN l_linenumber = 1 THEN 'n.d.' WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS ki
   FROM lineitem),
u AS (SELECT l_partkey, 'IC50' AS kind, ic50 AS s FROM raw UNION ALL SELECT l_partkey, 'Ki', ki FROM raw),
p AS (SELECT l_partkey, kind, CASE WHEN regexp_extract(trim(s), '^(>=|<=|>|<)', 1) = '' THEN '='
             ELSE regexp_extract(trim(s), '^(>=|<=|>|<)', 1) END AS qualifier,
             TRY_CAST(trim(regexp_replace(trim(s), '^(>=|<=|>|<)', '')) AS DOUBLE) AS value FROM u)
SELECT l_partkey, kind, qualifier, count(*) AS n, sum(value) AS total FROM p WHERE value > 0 GROUP BY 1, 2, 3""")
def unpivot_parse(t):
    whole = F.col("l_quantity").cast("int").cast("string")
    ic50 = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(">="), whole)).when(
        F.col("l_returnflag") == "A", F.concat(F.lit("< "), whole)).otherwise(whole)
    ki = F.when(F.col("l_linenumber") == 1, "n.d.").when(
        F.col("l_linenumber") != 2, F.col("l_linenumber").cast("string"))
    wide = t("lineitem").select("l_partkey", ic50.alias("IC50"), ki.alias("Ki"))
    long = wide.unpivot(["l_partkey"], ["IC50", "Ki"], "kind", "text")
    sign, number = X.split_qualifier(F.col("text"))
    return (long.select("l_partkey", "kind", sign.alias("qualifier"), number.alias("value"))
            .filter(F.col("value") > 0).groupBy("l_partkey", "kind", "qualifier")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("S12 U01", """
SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, false AS flagged FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, '', false FROM supplier""")
def union_by_name(t):
    left = t("customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"),
                                F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    right = t("supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"),
                                 F.col("s_acctbal").alias("balance"))
    return left.unionByName(right, allowMissingColumns=True).select(
        "origin", "id", "balance", F.coalesce("segment", F.lit("")).alias("segment"),
        F.lit(False).alias("flagged"))


@query("S13", "SELECT 'lineitem.parquet' AS filename, count(*) AS n_rows, 'line' AS format FROM lineitem")
def ingest_manifest(t):
    return (t("lineitem").select(F.col("_metadata.file_name").alias("filename"))
            .groupBy("filename").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("format", F.lit("line")))


@query("S17", """
SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS props_k,
       max(CAST(json_extract(props, '$.k') AS BIGINT)) AS props_k_max FROM events GROUP BY 1""")
def json_flatten(t):
    parsed = t("events").select("event_type", F.from_json("props", "k BIGINT").alias("props"))
    flat = parsed.select("event_type", F.col("props.k").alias("props_k"))
    return flat.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("props_k").alias("props_k"),
                                          F.max("props_k").alias("props_k_max"))


@query("S20", """
SELECT p_partkey FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '12') OR contains(p_name, '12')
 OR contains(p_brand, '12') OR contains(p_type, '12') OR contains(CAST(p_size AS VARCHAR), '12') OR contains(CAST(p_retailprice AS VARCHAR), '12')""")
def any_column_contains(t):
    frame = t("part")
    hit = F.lit(False)
    for name in frame.columns:
        hit = hit | X.yes(F.col(name).cast("string").contains("12"))
    return frame.filter(hit).select("p_partkey")


@query("S21", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '[A-Z]{2,}.*[0-9]')) AS n_hits
FROM l GROUP BY 1""")
def grep_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("line").rlike("[A-Z]{2,}.*[0-9]")).alias("n_hits"))


@query("K01", """
SELECT p_partkey AS id, p_brand AS scaffold, CAST(NULL AS DOUBLE) AS activity, p_size AS size FROM part ORDER BY 1""")
def contract_project(t):
    from tidegauge.sources.writers import to_contract
    renamed = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("scaffold"),
                               F.col("p_size").alias("size"))
    return to_contract(renamed, {"id": "bigint", "scaffold": "string", "activity": "double", "size": "int"}, "id")


@query("P02", """
SELECT p_partkey, (CASE WHEN p_size > 25 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END)
 + (CASE WHEN p_name LIKE '%red%' THEN 1 ELSE 0 END) AS violations, p_size > 40 AS flag_size FROM part""")
def violation_count(t):
    return t("part").select(
        "p_partkey",
        X.true_count(F.col("p_size") > 25, F.col("p_retailprice") > 1000, F.col("p_name").contains("red")).alias("violations"),
        (F.col("p_size") > 40).alias("flag_size"))


HIGH_WORDS, MEDIUM_WORDS, LOW_WORDS = ["password", "secret"], ["license", "copyright"], ["the", "und"]
CONTEXT_WORDS = ["example"]


@query("P03", """
WITH d AS (SELECT doc_id, lower(text) AS s FROM documents),
m AS (SELECT doc_id, list_filter(['password', 'secret'], lambda w: contains(s, w)) AS hi,
       list_filter(['license', 'copyright'], lambda w: contains(s, w)) AS me,
       list_filter(['the', 'und'], lambda w: contains(s, w)) AS lo, contains(s, 'example') AS excl FROM d),
a AS (SELECT doc_id, excl, len(hi) > 0 AND NOT excl AS high, len(me) > 0 OR (excl AND len(hi) > 0) AS medium,
       list_concat(list_concat(hi, me), lo) AS found FROM m)
SELECT doc_id, CASE WHEN excl AND len(found) > 0 AND len(list_filter(found, lambda w: w NOT IN ('the', 'und'))) = 0 THEN 'none'
   WHEN high THEN 'high' WHEN medium THEN 'medium' WHEN len(found) > 0 THEN 'low' ELSE 'none' END AS confidence,
   CASE WHEN excl AND len(list_filter(found, lambda w: w NOT IN ('the', 'und'))) = 0 THEN ''
        ELSE array_to_string(found, ',') END AS matched,
   CASE WHEN excl AND len(list_filter(found, lambda w: w NOT IN ('the', 'und'))) = 0 THEN false
        ELSE len(found) > 0 AND len(list_filter(found, lambda w: w NOT IN ('the', 'und'))) = 0 END AS all_weak
FROM a""")
def rule_tiers(t):
    from tidegauge.operators.rules import confidence_tiers
    text = F.lower("text")
    found = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    tiers = confidence_tiers(found(HIGH_WORDS), found(MEDIUM_WORDS), found(LOW_WORDS),
                             X.contains_any(text, CONTEXT_WORDS), weak=LOW_WORDS, reversible=LOW_WORDS)
    return t("documents").select("doc_id", *[c.alias(n) for n, c in tiers.items()])


@query("P06 P39", """
SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 1e0 WHEN p_type = 'PROMO' THEN 0e0
  WHEN p_type = 'SMALL' THEN round(1e0 - (p_size % 7) / greatest(p_size, 1)::DOUBLE, 3) ELSE 5e-1 END AS completeness
FROM part""")
def ratio_case(t):
    kind, n = F.col("p_type"), F.col("p_size")
    return t("part").select("p_partkey", X.first_rule([
        (kind.isin("ECONOMY", "STANDARD"), 1.0), (kind == "PROMO", 0.0),
        (kind == "SMALL", F.round(1.0 - (n % 7) / F.greatest(n, F.lit(1)), 3))], 0.5).alias("completeness"))


@query("P07", f"""
WITH {meas_sql('ord', 'compound_id', 'kind', 'unit_raw', 'value_nm')},
c AS (SELECT *, replace(lower(trim(unit_raw)), ' ', '') AS u, coalesce(value_nm NOT BETWEEN 1e-3 AND 1e7, false) AS far FROM meas),
s AS (SELECT *, CASE WHEN u IN ('', 'nan', 'none', 'unknown') THEN CASE WHEN value_nm BETWEEN 1e-3 AND 1e6 THEN 'inferred_nm' ELSE 'unknown' END
  WHEN u = 'nm' THEN 'nm' WHEN replace(u, 'molar', '') = 'nano' THEN 'nanomolar' WHEN u IN ('um', 'µm', 'μm') THEN u
  WHEN replace(u, 'molar', '') = 'micro' THEN 'micromolar' WHEN u = 'mm' THEN 'mm' WHEN replace(u, 'molar', '') = 'milli' THEN 'millimolar'
  WHEN u = 'm' THEN 'm' WHEN replace(u, 'molar', '') = '' THEN 'molar' WHEN u = 'pm' THEN 'pm'
  WHEN replace(u, 'molar', '') = 'pico' THEN 'picomolar' ELSE 'unknown' END AS unit FROM c)
SELECT unit, CASE WHEN kind = 'pct_inhibition' THEN 'ok' WHEN unit = 'unknown' THEN 'unknown' WHEN unit = 'inferred_nm' THEN 'inferred'
   WHEN far THEN 'suspicious' ELSE 'ok' END AS unit_flag, count(*) AS n,
  round(sum(CASE WHEN kind = 'pct_inhibition' THEN 1e0 WHEN unit = 'nm' AND far THEN 5e-1 WHEN unit IN ('nm', 'nanomolar') THEN 1e0
   WHEN unit IN ('um', 'micromolar') THEN 95e-2 WHEN unit IN ('pm', 'picomolar') THEN 9e-1 WHEN unit = 'inferred_nm' THEN 6e-1 ELSE 3e-1 END), 4) AS confidence
FROM s GROUP BY 1, 2""")
def unit_flag(t):
    rows = X.with_unit(measurements(t, "kind", "unit_raw", "value_nm"), F.col("unit_raw"), F.col("value_nm"))
    percent = F.col("kind") == "pct_inhibition"
    return rows.select(
        "unit", F.when(percent, "ok").otherwise(F.col("unit_flag")).alias("unit_flag"),
        F.when(percent, 1.0).otherwise(F.col("unit_confidence")).alias("c"),
    ).groupBy("unit", "unit_flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c"), 4).alias("confidence"))


@query("P08 P10 P11 P12", f"""
WITH {meas_sql('compound_id', 'kind', 'qualifier_raw', 'value_nm')}, {CLEAN_SQL}
SELECT compound_id, qualifier, CASE kind WHEN 'IC50' THEN 'ic50_regression' WHEN 'Ki' THEN 'ki_regression'
  WHEN 'pct_inhibition' THEN 'classification' END AS task,
  count(*) AS n, count(activity) AS n_exact, round(sum(activity), 5) AS activity_sum, round(max(activity), 5) AS activity_max,
  count(*) FILTER (WHERE activity IS NOT NULL AND activity NOT BETWEEN 2 AND 12) AS n_outliers
FROM act GROUP BY 1, 2, 3""")
def log_activity(t):
    rows = with_activity(measurements(t, "compound_id", "kind", "qualifier_raw", "value_nm"))
    task = X.lookup(F.col("kind"), {"IC50": "ic50_regression", "Ki": "ki_regression",
                                    "pct_inhibition": "classification"}, "ic50_regression")
    outlier = F.col("activity").isNotNull() & ~X.in_activity_range(F.col("activity"))
    return rows.groupBy("compound_id", "qualifier", task.alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.count("activity").alias("n_exact"),
        F.round(F.sum("activity"), 5).alias("activity_sum"), F.round(F.max("activity"), 5).alias("activity_max"),
        F.count_if(outlier).alias("n_outliers"))


@query("P09", f"""
WITH {meas_sql('ord', 'compound_id', 'qualifier_raw', 'value_nm')},
c AS (SELECT *, trim(qualifier_raw) AS q FROM meas)
SELECT ord, compound_id, value_nm, CASE WHEN q = '>' THEN round(9e0 - log10(value_nm), 6) END AS activity_upper,
  CASE WHEN q = '<=' THEN round(9e0 - log10(value_nm), 6) END AS activity_lower,
  CASE WHEN q = '>' THEN value_nm ELSE 0e0 END AS lower_bound_nm,
  CASE WHEN q = '>' THEN 'Infinity'::DOUBLE ELSE value_nm END AS upper_bound_nm
FROM c WHERE q IN ('>', '<=')""")
def censor_bounds(t):
    rows = measurements(t, "ord", "compound_id", "qualifier_raw", "value_nm")
    sign = X.normal_qualifier(F.col("qualifier_raw"))
    bounds = X.censored_bounds(F.col("value_nm"), sign)
    logs = [F.round(bounds.pop(k), 6).alias(k) for k in ("activity_upper", "activity_lower")]
    return rows.filter(sign != "=").select("ord", "compound_id", "value_nm", *logs,
                                           *[c.alias(k) for k, c in bounds.items()])


@query("P13 P29", f"""
WITH {meas_sql('ord', 'compound_id', 'kind', 'pct')}
SELECT ord, compound_id, kind = 'pct_inhibition' AS is_weak_label,
  CASE WHEN kind = 'pct_inhibition' THEN 'T3_weak' ELSE 'T1_standard' END AS fidelity_level,
  CASE WHEN kind = 'pct_inhibition' THEN CASE WHEN pct >= 30 THEN 1 ELSE 0 END END AS binary_label FROM meas""")
def weak_labels(t):
    weak = F.col("kind") == "pct_inhibition"
    return measurements(t, "ord", "compound_id", "kind", "pct").select(
        "ord", "compound_id", weak.alias("is_weak_label"),
        F.when(weak, "T3_weak").otherwise("T1_standard").alias("fidelity_level"),
        F.when(weak, F.when(F.col("pct") >= K.SCREEN_ACTIVE_FROM, 1).otherwise(0)).alias("binary_label"))


@query("P14", r"""
SELECT doc_id, regexp_matches(text || ' ' || lang || ' ' || source, '(?i)(?:preincubat)|(?:time[\s\-]?depend)|(?:irreversib)|(?:covalent)|(?:jump[\s\-]?dilut)|(?:washout)|(?:kinact)') AS time_dependent,
       regexp_matches(text, '(?i)(licen[cs]e|copyright)') AS license_flag, regexp_matches(text, '[\w.]+@[\w.]+') AS contact_flag
FROM documents""")
def regex_flags(t):
    return t("documents").select(
        "doc_id", X.time_dependence(F.concat_ws(" ", "text", "lang", "source")).alias("time_dependent"),
        F.col("text").rlike(r"(?i)(licen[cs]e|copyright)").alias("license_flag"),
        F.col("text").rlike(r"[\w.]+@[\w.]+").alias("contact_flag"))


@query("P15 P16", """
WITH d AS (SELECT doc_id, lower(text) AS s, CASE doc_id % 4 WHEN 0 THEN 'HTS' WHEN 1 THEN 'panel' WHEN 2 THEN 'binding' ELSE 'other' END AS category,
   CASE WHEN doc_id % 3 = 0 THEN 'nan' WHEN doc_id % 3 = 1 THEN '10.1/x' END AS doi, CASE WHEN doc_id % 2 = 0 THEN '77' ELSE '' END AS pmid,
   n_chars > 2000 AS dose, lang = 'en' AS human FROM documents),
k AS (SELECT *, regexp_matches(s, 'confirm|dose') AS c1, regexp_matches(s, 'biochem|enzyme|recombinant|purified') AS c2,
   regexp_matches(s, 'cell|lysis|transfect') AS c3, category = 'HTS' AS c4, regexp_matches(s, 'rnai|sirna|shrna') AS c5 FROM d)
SELECT doc_id, CASE WHEN c1 THEN 'confirmatory' WHEN c2 THEN 'biochemical' WHEN c3 THEN 'cell-based' WHEN c4 THEN 'HTS' WHEN c5 THEN 'HTS' ELSE 'unknown' END AS assay_type,
 round(greatest(least((CASE category WHEN 'HTS' THEN 3e-1 WHEN 'panel' THEN 6e-1 WHEN 'binding' THEN 75e-2 ELSE 5e-1 END)
  + (CASE WHEN dose THEN 3e-1 ELSE 0e0 END) + (CASE WHEN doi = '10.1/x' THEN 2e-1 WHEN pmid = '77' THEN 1e-1 ELSE 0e0 END)
  + (CASE WHEN c1 OR c2 THEN 15e-2 WHEN c3 THEN 5e-2 WHEN c4 THEN -3e-1 WHEN c5 THEN -4e-1 ELSE 0e0 END)
  + (CASE WHEN human THEN 0e0 ELSE -5e-2 END), 1e0), 5e-2), 6) AS context_score,
 CASE WHEN doi = '10.1/x' THEN 1e0 WHEN pmid = '77' THEN 6e-1 ELSE 0e0 END AS literature_confidence
FROM k""")
def additive_score(t):
    category = X.lookup(F.col("doc_id") % 4, {0: "HTS", 1: "panel", 2: "binding"}, "other")
    doi = F.when(F.col("doc_id") % 3 == 0, "nan").when(F.col("doc_id") % 3 == 1, "10.1/x")
    pmid = F.when(F.col("doc_id") % 2 == 0, "77").otherwise("")
    out = X.assay_context(category, F.col("text"), F.col("n_chars") > 2000, doi, pmid, F.col("lang") == "en")
    return t("documents").select("doc_id", out["assay_type"].alias("assay_type"),
                                 F.round(out["context_score"], 6).alias("context_score"),
                                 out["literature_confidence"].alias("literature_confidence"))


TIER_SQL = f"""{meas_sql()}, {CLEAN_SQL},
unit AS (SELECT *, CASE WHEN unit_raw = 'furlong' THEN 'unknown' WHEN unit_raw = '' THEN CASE WHEN value_nm BETWEEN 1e-3 AND 1e6 THEN 'inferred' ELSE 'unknown' END
   WHEN value_nm NOT BETWEEN 1e-3 AND 1e7 THEN 'suspicious' ELSE 'ok' END AS unit_flag,
   CASE WHEN unit_raw = 'furlong' THEN 3e-1 WHEN unit_raw = '' THEN CASE WHEN value_nm BETWEEN 1e-3 AND 1e6 THEN 6e-1 ELSE 3e-1 END
   WHEN unit_raw IN ('nM', 'nm') AND value_nm NOT BETWEEN 1e-3 AND 1e7 THEN 5e-1 WHEN unit_raw = 'uM' THEN 95e-2 WHEN unit_raw = 'picomolar' THEN 9e-1 ELSE 1e0 END AS unit_confidence FROM act),
tiered AS (SELECT *, CASE WHEN kind = 'Ki' THEN 'Ki' WHEN kind = 'pct_inhibition' THEN 'T3'
   WHEN qualifier <> '=' AND value_nm > 0 AND filter_passed AND NOT is_mouse THEN 'T2'
   WHEN qualifier = '=' AND activity BETWEEN 2 AND 12 AND filter_passed AND NOT is_mouse AND unit_flag IN ('ok', 'inferred') THEN 'T1'
   ELSE 'T3' END AS tier FROM unit)"""


def tiered(t):
    """Measurements with activity, unit verdict and tier: input of the later stages."""
    rows = with_activity(measurements(t))
    rows = X.with_unit(rows, F.col("unit_raw"), F.col("value_nm"))
    return rows.withColumn("tier", X.tier(
        F.col("kind"), F.col("qualifier"), F.col("value_nm"), F.col("activity"),
        F.col("filter_passed"), F.col("is_mouse"), F.col("unit_flag")))


def tier_table(t, *names):
    """The tier table as the pipeline stores it: written once, the tier is a folder."""
    return stage(tiered(t).select(*names, "tier"), "tier")


@query("P17", f"""
WITH {TIER_SQL} SELECT tier, source_db, count(*) AS n, round(avg(activity), 5) AS mean_activity FROM tiered GROUP BY 1, 2""")
def tier_case(t):
    return tiered(t).groupBy("tier", "source_db").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("activity"), 5).alias("mean_activity"))


@query("P18", """
SELECT p_partkey, round(least((p_size % 8) / 6e0, 1e0) * 3e-1 + least((p_size % 5) / 4e0, 1e0) * 15e-2 - least(p_size / 12e0, 1e0) * 1e-1
  + (p_retailprice / 4123e0) * 25e-2 + least((p_partkey % 6) / 4e0, 1e0) * 2e-1, 4) AS complexity FROM part""")
def complexity_score(t):
    from tidegauge.operators.rules import complexity
    return t("part").select("p_partkey", complexity(
        rings=F.col("p_size") % 8, aromatic=F.col("p_size") % 5, rotatable=F.col("p_size"),
        sp3=F.col("p_retailprice") / 4123.0, chiral=F.col("p_partkey") % 6).alias("complexity"))


@query("P19", f"""
WITH {meas_sql('ord', 'compound_id', 'stereo_flag', 'weight', 'price', 'source_id')},
f AS (SELECT *, (ord % 7)::INT AS n_chiral, (ord % 6)::INT AS n_undef, source_id % 9 = 0 AS crossed, price / 1e4 AS activity,
  stereo_flag IN ('defined', 'achiral') AS resolved, stereo_flag = 'fully_undefined' AS fully, stereo_flag = 'partial_undefined' AS partly FROM meas),
g AS (SELECT *, (partly OR fully) AND n_undef <= 3 AND n_undef > 0 AS enumerable, (partly OR fully) AND n_undef > 3 AS complex FROM f)
SELECT ord, compound_id, CASE WHEN fully AND activity < 5 AND NOT crossed THEN 'unresolvable' WHEN crossed AND NOT resolved THEN 'cross_resolved'
   WHEN complex THEN 'complex' WHEN enumerable THEN 'enumerable' ELSE 'resolved' END AS status,
 round(CASE WHEN crossed AND NOT resolved THEN 1e-1 WHEN complex THEN 55e-2 WHEN fully THEN 5e-1
   WHEN partly THEN least(n_undef / greatest(n_chiral, 1)::DOUBLE, 1e0) * 3e-1 ELSE 0e0 END, 3) AS penalty,
 CASE WHEN n_undef > 0 THEN least(pow(2, n_undef), 64)::INT ELSE 1 END AS isomers FROM g""")
def mask_overwrite(t):
    from tidegauge.operators.rules import remediation
    rows = measurements(t, "ord", "compound_id", "stereo_flag", "price", "source_id")
    out = remediation(
        F.col("stereo_flag"), n_chiral=(F.col("ord") % 7).cast("int"), n_undefined=(F.col("ord") % 6).cast("int"),
        crossed=F.col("source_id") % 9 == 0, activity=F.col("price") / 1e4)
    return rows.select("ord", "compound_id", *[c.alias(n) for n, c in out.items()])


@query("P20 P21 P22", f"""
WITH {TIER_SQL} SELECT count(*) FILTER (WHERE kind = 'IC50' AND unit_flag = 'ok' AND assay_confidence >= 6e-1) AS n_strict,
 count(*) FILTER (WHERE tier = 'T1' AND stereo_flag IN ('defined', 'achiral')) AS n_confirmed,
 count(*) FILTER (WHERE source_db IN ('BindingDB', 'ChEMBL')) AS n_first, count(*) FILTER (WHERE NOT dose_response OR source_db = 'PubChem') AS n_second FROM tiered""")
def strict_filter(t):
    strict = (F.col("kind") == "IC50") & (F.col("unit_flag") == "ok") & (F.col("assay_confidence") >= 0.6)
    return tiered(t).agg(
        F.count_if(strict).alias("n_strict"),
        F.count_if((F.col("tier") == "T1") & F.col("stereo_flag").isin("defined", "achiral")).alias("n_confirmed"),
        F.count_if(F.col("source_db").isin("BindingDB", "ChEMBL")).alias("n_first"),
        F.count_if(~F.col("dose_response") | (F.col("source_db") == "PubChem")).alias("n_second"))


@query("P23", f"""
WITH {TIER_SQL}, two AS (SELECT 'T1' AS source_tier, compound_id, CASE WHEN activity >= 6 THEN 1 ELSE 0 END AS activity_class FROM tiered WHERE tier = 'T1'
 UNION ALL SELECT 'T2', compound_id, CASE WHEN qualifier IN ('<', '<=') AND 9e0 - log10(value_nm) > 6 THEN 1
   WHEN qualifier IN ('>', '>=') AND 9e0 - log10(value_nm) < 6 THEN 0 END FROM tiered WHERE tier = 'T2')
SELECT source_tier, activity_class, count(*) AS n, count(DISTINCT compound_id) AS n_compounds FROM two GROUP BY 1, 2""")
def interval_label(t):
    rows = tier_table(t, "compound_id", "value_nm", "qualifier", "activity")
    bounds = X.censored_bounds(F.col("value_nm"), F.col("qualifier"))
    label = F.when(F.col("tier") == "T1", (F.col("activity") >= K.ACTIVE_FROM).cast("int")).otherwise(
        X.interval_class(bounds["activity_lower"], bounds["activity_upper"]))
    return (rows.filter(F.col("tier").isin("T1", "T2"))
            .select(F.col("tier").alias("source_tier"), label.alias("activity_class"), "compound_id")
            .groupBy("source_tier", "activity_class")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("compound_id").alias("n_compounds")))


@query("P24", f"""
WITH {TIER_SQL} SELECT CASE tier WHEN 'T1' THEN CASE WHEN weight >= 40 THEN 'T1_high' WHEN weight >= 20 THEN 'T1_confirmed' ELSE 'T1_standard' END
  WHEN 'T2' THEN 'T2_censored' ELSE 'T3_weak' END AS fidelity_level, tier = 'T3' AS is_weak_label, count(*) AS n,
 round(sum(CASE tier WHEN 'T1' THEN CASE WHEN weight >= 40 THEN 1e0 WHEN weight >= 20 THEN 9e-1 ELSE 8e-1 END WHEN 'T2' THEN 5e-1 ELSE 3e-1 END), 4) AS fidelity_weight
FROM tiered WHERE tier <> 'Ki' GROUP BY 1, 2""")
def fidelity_union(t):
    rows = tier_table(t, "weight")
    level = X.first_rule([(F.col("weight") >= 40, "T1_high"), (F.col("weight") >= 20, "T1_confirmed")], "T1_standard")
    parts = [rows.filter(F.col("tier") == name).select(lvl.alias("fidelity_level"), F.lit(weak).alias("is_weak_label"))
             for name, lvl, weak in (("T1", level, False), ("T2", F.lit("T2_censored"), False), ("T3", F.lit("T3_weak"), True))]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    weight = X.lookup(F.col("fidelity_level"), K.FIDELITY_WEIGHTS, 0.3)
    return merged.groupBy("fidelity_level", "is_weak_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(weight), 4).alias("fidelity_weight"))


@query("P25", f"""
WITH {meas_sql('ord', 'assay_confidence', 'source_db', 'unit_raw', 'sd_reported', 'weight')}
SELECT ord, weight, round(35e-2 * least(coalesce(sd_reported, 0e0) / 1e3, 1e0) + 25e-2 * (1e0 - assay_confidence)
 + 15e-2 * (CASE source_db WHEN 'BindingDB' THEN 0e0 WHEN 'ChEMBL' THEN 1e-1 ELSE 4e-1 END) + 15e-2 * 2e-1 + 1e-1 * (1e0 - least(weight / 5e1, 1e0)), 4) AS uncertainty
FROM meas""")
def weighted_clip_sum(t):
    rows = measurements(t, "ord", "assay_confidence", "source_db", "sd_reported", "weight")
    score = X.label_uncertainty(
        F.col("sd_reported") / 1e3, F.col("assay_confidence"),
        X.lookup(F.col("source_db"), K.SOURCE_RELIABILITY, K.SOURCE_RELIABILITY_DEFAULT),
        F.lit(None).cast("double"), F.col("weight") / 50.0)
    return rows.select("ord", "weight", F.round(score, 4).alias("uncertainty"))


@query("P26 P27", f"""
WITH {comp_sql()}, raw AS (SELECT *, greatest(weight * (1 + 2e-1 * (size / 5e1)) * (1 - 6e-1 * (compound_id % 4) / 1e1), 0e0) AS w FROM comp),
mm AS (SELECT min(w) AS lo, max(w) AS hi, min(activity) AS alo, max(activity) AS ahi FROM raw)
SELECT compound_id, round(least(greatest(w, 1e-2), 15e-1), 4) AS weight_raw,
  CASE WHEN hi > lo THEN round(1e-2 + 99e-2 * (w - lo) / (hi - lo), 4) ELSE 5e-1 END AS weight_scaled,
  round(least(greatest(45e-2 * (activity - alo) / greatest(ahi - alo, 1e-6) + 3e-1 * (1 - size / 5e1) + 15e-2 * 9e-1
     + 1e-1 * (CASE WHEN kind = 'PROMO' THEN 1e-1 ELSE 0e0 END), 0e0), 1e0), 4) AS priority FROM raw, mm""")
def minmax_scale(t):
    from tidegauge.operators.weights import min_max_weight, priority_score
    rows = compounds(t).withColumn("w", F.greatest(
        F.col("weight") * (1 + 0.2 * (F.col("size") / 50.0)) * (1 - 0.6 * (F.col("compound_id") % 4) / 10.0), F.lit(0.0)))
    rows = min_max_weight(rows, "w", raw_out="weight_raw", out="weight_scaled")
    rows = priority_score(rows, "activity", F.col("size") / 50.0, F.lit(0.1), F.col("kind") == "PROMO", out="priority")
    return rows.select("compound_id", "weight_raw", "weight_scaled", "priority")


@query("P28", f"""
WITH {comp_sql()}, s AS (SELECT *, (compound_id % 5)::INT AS n, (compound_id % 13) / 2e1 AS std, (compound_id % 11) / 5e1 AS lu, compound_id % 17 = 0 AS crossed,
  kind IN ('SMALL', 'PROMO') AS undef FROM comp)
SELECT compound_id, CASE WHEN n >= 3 AND std <= 5e-1 AND lu < 15e-2 THEN 'T1_high' WHEN n >= 2 AND std <= 5e-1 THEN 'T1_confirmed' ELSE 'T1_standard' END AS fidelity_level,
  CASE WHEN crossed THEN 'cross_resolved' WHEN undef AND activity > 7 AND std > 3e-1 THEN 'enumerate_isomers' WHEN undef AND activity > 7 THEN 'flag_for_review'
   WHEN undef AND std > 3e-1 THEN 'enumerate_isomers' WHEN undef AND activity < 5 THEN 'low_priority' ELSE 'use_as_is' END AS recommendation FROM s""")
def fidelity_case(t):
    from tidegauge.operators.rules import recommendation
    std, lu = (F.col("compound_id") % 13) / 20.0, (F.col("compound_id") % 11) / 50.0
    return compounds(t).select(
        "compound_id", X.fidelity_level(F.col("compound_id") % 5, std, lu).alias("fidelity_level"),
        recommendation(F.col("kind").isin("SMALL", "PROMO"), F.col("activity"), std,
                       F.col("compound_id") % 17 == 0).alias("recommendation"))


@query("P30 P31 P36", """
SELECT p_partkey, regexp_replace(CAST(p_size AS VARCHAR) || '.0', '\\.0$', '') AS norm_key, substring(p_name || '-' || p_brand, 1, 14) AS prefix,
 regexp_matches(upper(p_type), '^[A-Z]{5,8}$') AS well_formed FROM part""".replace("\\\\", "\\"))
def norm_key(t):
    return t("part").select(
        "p_partkey", F.regexp_replace(F.concat(F.col("p_size").cast("string"), F.lit(".0")), r"\.0$", "").alias("norm_key"),
        F.substring(F.concat_ws("-", "p_name", "p_brand"), 1, 14).alias("prefix"),
        F.upper("p_type").rlike("^[A-Z]{5,8}$").alias("well_formed"))


@query("P32 P33", """
SELECT p_partkey, coalesce(TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE), -1e0) AS brand_number, coalesce(TRY_CAST(p_name AS DOUBLE), -1e0) AS name_number,
 CASE p_type WHEN 'ECONOMY' THEN 1e0 WHEN 'STANDARD' THEN 5e-1 WHEN 'PROMO' THEN 25e-2 ELSE 0e0 END AS ordinal FROM part""")
def safe_float(t):
    frame = t("part")
    return frame.select(
        "p_partkey", X.safe_double(F.regexp_replace("p_brand", "Brand#", ""), -1.0).alias("brand_number"),
        X.safe_double(X.first_existing(frame, ["label_text", "p_name"]), -1.0).alias("name_number"),
        X.lookup(F.col("p_type"), {"ECONOMY": 1.0, "STANDARD": 0.5, "PROMO": 0.25}, 0.0).alias("ordinal"))


@query("P34", """
SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS n_missing, count(DISTINCT quality) AS n_classes,
 bool_and(quality IN (0, 1)) AS is_binary, round(least(avg(quality), 1 - avg(quality)), 6) AS minority,
 least(avg(quality), 1 - avg(quality)) < 5e-2 AS imbalanced FROM labels""")
def target_balance(t):
    from tidegauge.operators.audit import target_report
    return target_report(t("labels"), "quality")


@query("P38", f"""
WITH {TIER_SQL}, w AS (SELECT compound_id, least(greatest((CASE WHEN assay_confidence = 0 THEN 5e-1 ELSE assay_confidence END)
  * (CASE source_db WHEN 'BindingDB' THEN 1e0 WHEN 'ChEMBL' THEN 9e-1 ELSE 6e-1 END)
  * (1e0 - CASE WHEN sd_reported > 0 AND value_nm > 0 THEN least(sd_reported / (ln(10e0) * value_nm), 1e0) ELSE 0e0 END) * unit_confidence, 1e-6), 1e0) AS rw FROM tiered)
SELECT compound_id, count(*) AS n, round(avg(rw), 6) AS mean_weight, round(max(rw), 6) AS max_weight FROM w GROUP BY 1""")
def rep_weight(t):
    return tiered(t).select("compound_id", weight_of_replicate().alias("rw")).groupBy("compound_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rw"), 6).alias("mean_weight"), F.round(F.max("rw"), 6).alias("max_weight"))


def weight_of_replicate():
    return X.replicate_weight(F.col("assay_confidence"), F.col("source_db"), F.col("sd_reported"),
                              F.col("value_nm"), F.col("unit_confidence"))


@query("P40", f"""
WITH {TIER_SQL} SELECT compound_id, CASE WHEN qualifier = '=' AND activity BETWEEN 2 AND 12 THEN CASE WHEN activity >= 6 THEN 1 ELSE 0 END END AS activity_class,
 count(*) AS n FROM tiered WHERE tier = 'Ki' GROUP BY 1, 2""")
def ki_label(t):
    usable = (F.col("qualifier") == "=") & X.in_activity_range(F.col("activity"))
    return tier_table(t, "compound_id", "qualifier", "activity").filter(F.col("tier") == "Ki").groupBy(
        "compound_id", F.when(usable, (F.col("activity") >= K.ACTIVE_FROM).cast("int")).alias("activity_class")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("P41", """
SELECT CASE WHEN contains(url, 'page=') THEN 'paged' WHEN contains(url, '#') THEN 'anchored' WHEN contains(url, 'm.') THEN 'mobile' ELSE 'plain' END AS role,
 count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1""")
def bucket_case(t):
    url = F.col("url")
    role = X.first_rule([(url.contains("page="), "paged"), (url.contains("#"), "anchored"), (url.contains("m."), "mobile")], "plain")
    return t("pages").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"))
