"""Quality findings, profiles and leakage reports as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.expressions import yes


def target_report(df: DataFrame, target: str) -> DataFrame:
    """One row: missing targets, class count, binary check, minority share."""
    y = F.col(target)
    minority = F.least(F.avg(y), 1 - F.avg(y))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y.isNull()).alias("n_missing"),
        F.countDistinct(y).alias("n_classes"), F.bool_and(y.isin(0, 1)).alias("is_binary"),
        F.round(minority, 6).alias("minority"), (minority < 0.05).alias("imbalanced"))


def findings(df: DataFrame, checks: Sequence[tuple[str, str, Column, str, int]]) -> DataFrame:
    """One pass over ``df``: each check counts offending rows.

    A check is (category, name, offending condition, verdict when above limit, limit).
    """
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(yes(condition)).alias(f"c{i}") for i, (_, _, condition, _, _) in enumerate(checks)])
    rows = [
        F.struct(
            F.lit(category).alias("category"), F.lit(name).alias("check"),
            F.when(F.col(f"c{i}") > limit, F.lit(verdict)).otherwise(F.lit("PASS")).alias("verdict"),
            F.col(f"c{i}").alias("value"), F.col("n").alias("n"))
        for i, (category, name, _, verdict, limit) in enumerate(checks)]
    return counted.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, missing, distinct values, smallest and largest text.

    Distinct values are counted from (column, value) pairs, so no key holds them all.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns
    ])).alias("p")).select("p.*")
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top_count"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on each side, shared, left only, right only.

    Both sides meet in one aggregation on the key; no set reaches the driver.
    """
    tagged = (left.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"))
              .unionByName(right.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).filter(F.col(key).isNotNull()))
    sides = tagged.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = (F.col("a") == 1) & (F.col("b") == 1)
    return sides.agg(
        F.count_if(F.col("a") == 1).alias("n_left"), F.count_if(F.col("b") == 1).alias("n_right"),
        F.count_if(both).alias("n_shared"), F.count_if(F.col("b") == 0).alias("n_left_only"),
        F.count_if(F.col("a") == 0).alias("n_right_only"))


def row_hashes(df: DataFrame) -> Column:
    """52-bit number per row from its columns in name order."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in sorted(df.columns)])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def frame_hash(df: DataFrame) -> DataFrame:
    """Order-free checksum: row count, xor and sum of row hashes."""
    h = row_hashes(df)
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def stage_log(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows in, rows out and dropped for a chain of filters, from one pass."""
    held = F.lit(True)
    counts = [F.count(F.lit(1)).alias("c0")]
    for i, (_, condition) in enumerate(steps, 1):
        held = held & yes(condition)
        counts.append(F.count_if(held).alias(f"c{i}"))
    lines = [
        F.struct(F.lit(name).alias("stage"), F.col(f"c{i}").alias("rows_in"), F.col(f"c{i + 1}").alias("rows_out"),
                 (F.col(f"c{i}") - F.col(f"c{i + 1}")).alias("dropped"))
        for i, (name, _) in enumerate(steps)]
    return df.agg(*counts).select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def external_verdicts(candidates: DataFrame, modelled: DataFrame, group: str, id_col: str, label: str) -> DataFrame:
    """Per candidate set: ids, ids outside the modelled universe, labels, ordered verdict."""
    known = modelled.select(id_col).distinct().withColumn("_in", F.lit(True))
    joined = candidates.join(known, id_col, "left")
    counts = joined.groupBy(group).agg(
        F.countDistinct(id_col).alias("n_ids"),
        F.countDistinct(F.when(F.col("_in").isNull(), F.col(id_col))).alias("n_outside"), F.count(label).alias("n_labelled"))
    verdict = (F.when(F.col("n_ids") == 0, "EMPTY").when(F.col("n_outside") == 0, "SUBSET").when(F.col("n_outside") < 10, "TOO SMALL")
               .when(F.col("n_labelled") == 0, "INCOMPATIBLE LABELS").otherwise("CURATION SENSITIVITY"))
    return counts.withColumn("verdict", verdict)


def presence_verdict(hits: DataFrame, flagged: Column) -> DataFrame:
    """A: found and flagged; B: nowhere; C: found without a flag.  ``hits`` has place, n."""
    landing = F.when(F.col("n") > 0, F.concat(F.col("place"), F.lit("("), F.col("n").cast("string"), F.lit(")")))
    total = hits.agg(F.sum("n").alias("total_hits"), F.nullif(F.array_join(F.sort_array(F.collect_list(landing)), "; "), F.lit("")).alias("places"))
    outcome = F.when((F.col("total_hits") == 0) & ~flagged, "B").when(flagged & (F.col("total_hits") > 0), "A").otherwise("C")
    return total.withColumn("outcome", outcome)
