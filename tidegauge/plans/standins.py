"""Measurement-shaped views of the given tables.

The tables hold no assay data, so line items play the measurement records.  Each
view is one projection, written once as SQL text that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

MEASUREMENT = {
    "compound_id": "l_partkey",
    "source_id": "l_suppkey",
    "source_db": "CASE l_suppkey % 3 WHEN 0 THEN 'BindingDB' WHEN 1 THEN 'ChEMBL' ELSE 'PubChem' END",
    "ord": "l_orderkey * 10 + l_linenumber",
    "kind": "CASE WHEN l_linenumber = 7 THEN 'Ki' WHEN l_linenumber = 6 THEN 'pct_inhibition' ELSE 'IC50' END",
    "qualifier_raw": (
        "CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 AND l_returnflag = 'R' THEN '>' "
        "WHEN l_linestatus = 'F' AND l_linenumber = 2 AND l_returnflag = 'A' THEN ' <= ' "
        "WHEN l_linenumber = 3 AND l_returnflag = 'N' THEN NULL "
        "WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN '~' ELSE '=' END"
    ),
    "value_nm": (
        "l_extendedprice / CASE l_partkey % 5 WHEN 0 THEN 1e0 WHEN 1 THEN 1e1 WHEN 2 THEN 1e2 "
        "WHEN 3 THEN 1e3 ELSE 1e5 END"
    ),
    "pct": "CASE WHEN l_linenumber = 6 THEN l_quantity * 3e0 - 20e0 END",
    "unit_raw": (
        "CASE l_suppkey % 7 WHEN 0 THEN 'nM' WHEN 1 THEN ' Nano Molar' WHEN 2 THEN 'uM' "
        "WHEN 3 THEN '' WHEN 4 THEN 'furlong' WHEN 5 THEN 'picomolar' ELSE 'nm' END"
    ),
    "assay_confidence": "5e-1 + l_discount * 40123457e-7",
    "sd_reported": "CASE WHEN l_linenumber % 2 = 0 THEN l_tax * l_extendedprice / 1e1 END",
    "filter_passed": "l_quantity < 49e0",
    "is_mouse": "l_suppkey % 25 = 0",
    "dose_response": "l_linestatus = 'F'",
    "stereo_flag": (
        "CASE l_orderkey % 4 WHEN 0 THEN 'defined' WHEN 1 THEN 'achiral' "
        "WHEN 2 THEN 'partial_undefined' ELSE 'fully_undefined' END"
    ),
    "weight": "l_quantity",
    "price": "l_extendedprice",
}

# One row per compound, with a scaffold and an activity on the log scale.
COMPOUND = {
    "compound_id": "p_partkey",
    "scaffold": "p_brand",
    "activity": "4e0 + ((p_partkey * 7919) % 1000) / 2e2",
    "weight": "p_retailprice / 2e3",
    "size": "p_size",
    "kind": "p_type",
}


def measurements(tables, *names: str) -> DataFrame:
    return tables("lineitem").selectExpr(*[f"{MEASUREMENT[n]} AS {n}" for n in names or MEASUREMENT])


def compounds(tables, *names: str) -> DataFrame:
    return tables("part").selectExpr(*[f"{COMPOUND[n]} AS {n}" for n in names or COMPOUND])


def meas_sql(*names: str) -> str:
    cols = ", ".join(f"{MEASUREMENT[n]} AS {n}" for n in names or MEASUREMENT)
    return f"meas AS (SELECT {cols} FROM lineitem)"


def comp_sql(*names: str) -> str:
    cols = ", ".join(f"{COMPOUND[n]} AS {n}" for n in names or COMPOUND)
    return f"comp AS (SELECT {cols} FROM part)"


# Activity text shared by oracles: qualifier cleaned, exact log activity or null.
CLEAN_SQL = """clean AS (
  SELECT *, CASE WHEN trim(qualifier_raw) IN ('=', '>', '<', '>=', '<=') THEN trim(qualifier_raw)
                 ELSE '=' END AS qualifier FROM meas),
act AS (
  SELECT *, CASE WHEN qualifier = '=' AND kind IN ('IC50', 'Ki') AND value_nm > 0
                 THEN 9e0 - log10(value_nm) END AS activity FROM clean)"""


# Predictions: a score in [0, 1], a label that follows it loosely, a weight.
PREDICTION = {
    "id": "l_orderkey * 10 + l_linenumber",
    "strategy": "l_returnflag",
    "variant": "l_linestatus",
    "p": "((l_partkey * 31 + l_linenumber * 17 + CAST(l_quantity AS BIGINT) * 7) % 997) / 997e0",
    "y": (
        "CASE WHEN ((l_orderkey * 13 + l_suppkey) % 101) / 1e2 < 1e-1 + 8e-1 * "
        "((l_partkey * 31 + l_linenumber * 17 + CAST(l_quantity AS BIGINT) * 7) % 997) / 997e0 THEN 1 ELSE 0 END"
    ),
    "w": "1e0 - l_discount * 5e0",
    "y_true": "4e0 + ((l_partkey * 7919) % 1000) / 2e2",
    "y_pred": "4e0 + ((l_partkey * 7919) % 1000) / 2e2 + ((l_orderkey * 7 + l_linenumber) % 11 - 5) / 1e1",
    "similarity": "((l_suppkey * 37 + l_partkey * 11) % 1000) / 1e3",
    "split": "CASE WHEN l_orderkey % 20 < 14 THEN 'train' WHEN l_orderkey % 20 < 17 THEN 'val' ELSE 'test' END",
}


def predictions(tables, *names: str) -> DataFrame:
    return tables("lineitem").selectExpr(*[f"{PREDICTION[n]} AS {n}" for n in names or PREDICTION])


def pred_sql(*names: str) -> str:
    cols = ", ".join(f"{PREDICTION[n]} AS {n}" for n in names or PREDICTION)
    return f"pred AS (SELECT {cols} FROM lineitem)"


# Rows to split: one giant group, groups of growing size, and single-row groups.
SPLIT = {
    "id": "concat('IK', p_partkey)",
    "scaffold": (
        "CASE WHEN p_partkey % 3 = 0 THEN 'giant' "
        "WHEN p_partkey % 3 = 1 THEN concat('series-', CAST(CAST(floor(sqrt(p_partkey)) AS INT) AS VARCHAR(9))) "
        "ELSE concat('single-', CAST(p_partkey AS VARCHAR(19))) END"
    ),
    "activity": "4e0 + ((p_partkey * 7919) % 1009) / 2e2",
    "key14": "concat('K', CAST(p_partkey - p_partkey % 11 * (CASE WHEN p_partkey % 50 = 7 THEN 1 ELSE 0 END) AS VARCHAR(19)))",
    "label": "CASE WHEN p_size > 25 THEN 1 ELSE 0 END",
}


def split_rows(tables, *names: str) -> DataFrame:
    return tables("part").selectExpr(*[f"{SPLIT[n]} AS {n}" for n in names or SPLIT])


def split_sql(*names: str) -> str:
    cols = ", ".join(f"{SPLIT[n]} AS {n}" for n in names or SPLIT)
    return f"rows AS (SELECT {cols} FROM part)"


def hash_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 13))::BIGINT"
