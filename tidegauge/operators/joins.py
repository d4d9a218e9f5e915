"""Joins with vote, fallback, guard and overlap semantics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.dedup import keep_first


def vote_resolve(
    rows: DataFrame, group: str, candidate: str, payload: str, source: str,
    is_candidate: Column, needs: Column, source_weight: Column, order: str,
) -> DataFrame:
    """Give unresolved rows the candidate with most votes in their group.

    Score = occurrences + summed source weight; ties go to the smallest candidate.
    ``conflict`` marks groups with more than one candidate.
    """
    votes = rows.filter(is_candidate).withColumn("_w", source_weight).groupBy(group, candidate).agg(
        F.round(F.count(F.lit(1)) + F.sum("_w"), 9).alias("_score"),
        F.min_by(payload, order).alias("_payload"), F.min_by(source, order).alias("_source"))
    best = votes.groupBy(group).agg(
        F.min_by(F.struct(F.col(candidate).alias("c"), F.col("_payload").alias("p"), F.col("_source").alias("s")),
                 F.struct(-F.col("_score"), F.col(candidate))).alias("_best"),
        F.count(F.lit(1)).alias("_k"))
    joined = rows.join(best, group, "left")
    take = needs & F.col("_best").isNotNull()
    label = F.when(F.col("_k") > 1, F.concat(F.lit("conflicting("), F.col("_best.s"), F.lit(")"))).otherwise(F.col("_best.s"))
    return joined.withColumns({
        "resolved": F.coalesce(take, F.lit(False)), "resolved_id": F.when(take, F.col("_best.c")),
        "resolved_payload": F.when(take, F.col("_best.p")), "resolved_source": F.when(take, label),
        "resolved_confidence": F.when(take, 0.95)}).drop("_best", "_k")


def unique_fallback(
    rows: DataFrame, group: str, candidate: str, is_candidate: Column, needs: Column,
    resolved: str = "resolved", resolved_id: str = "resolved_id", confidence: str = "resolved_confidence",
) -> DataFrame:
    """Rows still open take the group's only candidate row, where there is exactly one."""
    single = rows.filter(is_candidate).groupBy(group).agg(
        F.count(F.lit(1)).alias("_k"), F.min(candidate).alias("_only")).filter("_k = 1")
    joined = rows.join(single.drop("_k"), group, "left")
    take = needs & ~F.col(resolved) & F.col("_only").isNotNull()
    return joined.withColumns({
        resolved: F.col(resolved) | F.coalesce(take, F.lit(False)),
        resolved_id: F.coalesce(F.col(resolved_id), F.when(take, F.col("_only"))),
        confidence: F.coalesce(F.col(confidence), F.when(take, 0.65))}).drop("_only")


def guarded_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that cannot fan out: the right side is first brought to one row per key.

    Numbers average, booleans become any-of, everything else keeps its smallest value.
    """
    aggs = []
    for field in right.schema.fields:
        if field.name == key:
            continue
        kind = field.dataType.typeName()
        c = F.col(field.name)
        if kind == "boolean":
            aggs.append(F.bool_or(c).alias(field.name))
        elif kind in ("string", "array", "struct", "binary", "timestamp", "date"):
            aggs.append(F.min(c).alias(field.name))
        else:
            aggs.append(F.avg(c).alias(field.name))
    return left.join(right.groupBy(key).agg(*aggs), key, "left")


def route(rows: DataFrame, by_id: DataFrame, by_group: DataFrame, id_col: str, group: str, group_only: bool = False) -> DataFrame:
    """Split of a row from its id, else from its group, else ``unassigned``."""
    ids = by_id.groupBy(id_col).agg(F.min("split").alias("_si"))  # one line an id, so rows never multiply
    groups = by_group.groupBy(group).agg(F.min("split").alias("_sg"))
    joined = rows.join(ids, id_col, "left").join(groups, group, "left")
    chosen = F.coalesce(*([] if group_only else [F.col("_si")]), F.col("_sg"), F.lit("unassigned"))
    return joined.withColumn("split", chosen).drop("_si", "_sg")


def conflicting_pairs(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys present on both sides with different values."""
    a = left.select(key, F.col(value).alias("_a")).distinct()
    b = right.select(key, F.col(value).alias("_b")).distinct()
    return a.join(b, key).filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        key, F.col("_a").alias("left_value"), F.col("_b").alias("right_value"))


def straddle_counts(edges: DataFrame, members: DataFrame, src: str, dst: str, id_col: str) -> DataFrame:
    """One row: edges inside train, inside test, across, and touching either."""
    side = members.filter(F.col("split").isin("train", "test")).groupBy(id_col).agg(
        F.bool_or(F.col("split") == "train").alias("tr"), F.bool_or(F.col("split") == "test").alias("te"))
    named = lambda p, c: side.select(F.col(id_col).alias(c), F.col("tr").alias(f"{p}_tr"), F.col("te").alias(f"{p}_te"))
    joined = edges.select(src, dst).join(named("a", src), src, "left").join(named("b", dst), dst, "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    across = (f("a_tr") & f("b_te")) | (f("a_te") & f("b_tr"))
    touching = f("a_tr") | f("a_te") | f("b_tr") | f("b_te")
    counted = joined.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(touching).alias("n_relevant"),
        F.count_if(f("a_tr") & f("b_tr")).alias("both_train"), F.count_if(f("a_te") & f("b_te")).alias("both_test"),
        F.count_if(across).alias("straddle"))
    return counted.withColumn("straddle_share", F.round(F.col("straddle") / F.greatest(F.col("n_relevant"), F.lit(1)), 4))


def edge_votes(edges: DataFrame, nodes: DataFrame, src: str, dst: str, id_col: str, value: str) -> DataFrame:
    """Per node: +1 for each edge where it is the less active end, -1 where the more active."""
    named = lambda c, v: nodes.select(F.col(id_col).alias(c), F.col(value).alias(v))
    joined = edges.select(src, dst).join(named(src, "_a"), src).join(named(dst, "_b"), dst)
    lower = F.col("_a") <= F.col("_b")
    ends = F.array(
        F.struct(F.col(src).alias(id_col), F.when(lower, 1).otherwise(-1).alias("v")),
        F.struct(F.col(dst).alias(id_col), F.when(lower, -1).otherwise(1).alias("v")))
    return joined.select(F.explode(ends).alias("e")).groupBy(F.col(f"e.{id_col}").alias(id_col)).agg(
        F.sum("e.v").alias("votes"), F.count(F.lit(1)).alias("n_edges"))


def edge_members(edges: DataFrame, src: str, dst: str, id_col: str) -> DataFrame:
    """Distinct ids that occur on either end of the edge table."""
    return edges.select(F.explode(F.array(src, dst)).alias(id_col)).distinct()


def left_fill(left: DataFrame, right: DataFrame, key: str, value: str, fill: DataFrame, out: str) -> DataFrame:
    """Second prediction or the one-row mean in ``fill``; ``covered`` tells which."""
    from tidegauge.operators.ordered import attach_scalars

    joined = left.join(right.select(key, F.col(value).alias("_v")), key, "left")
    filled = attach_scalars(joined, fill.select(F.col(fill.columns[0]).alias("_fill")))
    return filled.withColumns({
        out: F.coalesce("_v", "_fill"), "covered": F.col("_v").isNotNull()}).drop("_v", "_fill")


def apply_train_aggregates(rows: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Left join of train-fitted numbers; unseen keys get zeros."""
    names = [c for c in fitted.columns if c != key]
    return rows.join(fitted, key, "left").fillna(0, subset=names)


def id_columns(names: Sequence[str]) -> tuple[str, str] | None:
    """Find the two id columns of an edge table: known pairs first, then by name ending."""
    # Known pairs of id columns, in search order.
    known = [("inchikey_1", "inchikey_2"), ("id_a", "id_b"), ("inchikey_14_a", "inchikey_14_b"),
             ("ik14_a", "ik14_b"), ("compound_a", "compound_b"), ("compound_id_a", "compound_id_b"),
             ("inchikey_a", "inchikey_b")]
    for a, b in known:
        if a in names and b in names:
            return a, b
    for suffix_a, suffix_b in (("_a", "_b"), ("_1", "_2"), ("1", "2")):
        for name in names:
            stem = name[: -len(suffix_a)]
            looks_like_id = any(w in name.lower() for w in ("id", "key", "compound"))
            if name.endswith(suffix_a) and looks_like_id and stem + suffix_b in names:
                return name, stem + suffix_b
    return None


def normalise_edges(edges: DataFrame, id_length: int = 14, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Edge table with ``src`` and ``dst`` cut to the id length."""
    found = id_columns(edges.columns)
    if found is None:
        raise ValueError(f"no id columns among {edges.columns}")
    cut = lambda c: F.substring(F.col(c).cast("string"), 1, id_length)
    rest = [c for c in edges.columns if c not in found]
    return edges.select(cut(found[0]).alias("src"), cut(found[1]).alias("dst"), *rest).withColumnsRenamed(dict(rename or {}))
