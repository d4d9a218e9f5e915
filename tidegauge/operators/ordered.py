"""Exact order statistics that never hold a whole group in one task.

A window over ``partitionBy(key)`` sorts a key's rows in one task, and the
``percentile`` aggregate keeps a key's distinct values in one buffer.  Both fail
when one key owns a third of the table.  Here rows are dealt into ranges of
(key, value), so a large key is cut like everything else, whatever the type of the
value.  Ordered work happens inside (key, range); the sums of each range, a few rows
a task, give it its starting offset.  The plan is the same for every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import stage

#: ranges to deal into; by default Spark's number of shuffle partitions, small ones joined
PARTS: int | None = None


def _ranged(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` in ranges of ``columns``, sorted by them and numbered in ``_part``.

    Written once: a range's number must be the same for all that read it.  Sums over a
    key add up in this order, as running sums do, so both are rounded alike.
    """
    by = [F.col(c) for c in columns]
    dealt = df.repartitionByRange(PARTS, *by) if PARTS else df.repartitionByRange(*by)
    return stage(dealt.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))


def running_totals(df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str]) -> DataFrame:
    """Add ``cum_<m>`` (inclusive) and ``all_<m>`` per key along ascending ``order``.

    Rows must be unique on (keys, order), which may be of any orderable type; aggregate
    first.
    """
    keys = list(keys)
    ranged = _ranged(df, [*keys, order])
    per_part = ranged.groupBy(*keys, "_part").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_part.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_s_{m}").over(ahead), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(m).over(inside).alias(f"_l_{m}") for m in measures])
    joined = local.join(offsets, [*keys, "_part"])
    for m in measures:
        joined = joined.withColumn(f"cum_{m}", F.col(f"_o_{m}") + F.col(f"_l_{m}"))
    return joined.drop("_part", *[f"_o_{m}" for m in measures], *[f"_l_{m}" for m in measures])


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None
) -> DataFrame:
    """One row per (keys, value) with ``n`` and ``w``; partial sums collapse ties early."""
    held = [F.col(k).isNotNull() for k in keys] + [F.col(value).isNotNull()]
    for condition in held:
        df = df.filter(condition)
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w")
    )


def ladder(
    df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None
) -> DataFrame:
    """``value_counts`` with running and total counts and weights per key."""
    counts = value_counts(df, keys, value, weight)
    return running_totals(counts, keys, "v", ["n", "w"])


def at_quantile(q: float) -> Column:
    """Aggregate over a ladder: linear-interpolated quantile, as ``quantile_cont``."""
    position = F.lit(float(q)) * (F.col("all_n") - 1)
    low = F.min(F.when(F.col("cum_n") > F.floor(position), F.col("v")))
    high = F.min(F.when(F.col("cum_n") > F.ceil(position), F.col("v")))
    share = F.max(position - F.floor(position))
    return low + (high - low) * share


def at_weighted_median() -> Column:
    """Aggregate over a ladder: first value whose running weight reaches one half."""
    return F.min(F.when(F.col("cum_w") >= F.lit(0.5) * F.col("all_w"), F.col("v")))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles per key: ``wanted`` maps output column to level."""
    steps = ladder(df, keys, value)
    return steps.groupBy(*keys).agg(*[at_quantile(q).alias(name) for name, q in wanted.items()])


def mad_of_ladder(steps: DataFrame, keys: Sequence[str], factor: float, out: str = "mad") -> DataFrame:
    """Scaled median absolute deviation per key from a (staged) ladder; 0 for one value.

    Deviations are taken on counted values, so ties stay collapsed.
    """
    centre = steps.groupBy(*keys).agg(at_quantile(0.5).alias("_centre"))
    counted = join_back(steps.select(*keys, "v", "n"), centre, keys)
    away = counted.groupBy(*keys, F.abs(F.col("v") - F.col("_centre")).alias("v")).agg(F.sum("n").alias("n"))
    run = running_totals(away, keys, "v", ["n"])
    return run.groupBy(*keys).agg(
        F.when(F.max("all_n") < 2, F.lit(0.0)).otherwise(F.lit(factor) * at_quantile(0.5)).alias(out))


def group_mad(df: DataFrame, keys: Sequence[str], value: str, factor: float, out: str = "mad") -> DataFrame:
    """``mad_of_ladder`` of a frame; the ladder is staged because it is read three times."""
    return mad_of_ladder(stage(ladder(df, keys, value)), keys, factor, out)


def join_back(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach per-key values to rows; a one-row side without keys joins as one row.

    The per-key side is broadcast only when Spark's size check allows it; otherwise
    adaptive execution splits the skewed row side of the sort-merge join.
    """
    if keys:
        return rows.join(per_key, list(keys), how)
    return attach_scalars(rows, per_key)


def attach_scalars(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate (always exactly one row) next to rows."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("s"))
    return rows.withColumn("_scalars", packed.scalar()).select(
        *rows.columns, *[F.col(f"_scalars.{n}").alias(n) for n in names]
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rows with 1-based average ranks of ``value`` inside each key."""
    steps = ladder(df, keys, value).select(
        *keys, F.col("v").alias(value), (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(out)
    )
    return df.join(steps, [*keys, value])


def positions(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str = "pos"
) -> DataFrame:
    """0-based position of each row per key by (value, tie); ``tie`` must be unique.

    Two ladders: one counts the rows below a value, one orders the rows that share a
    value by ``tie``.  Neither needs a whole group, or a whole tie, in one task.
    """
    keys = list(keys)
    steps = ladder(df, keys, value).select(
        *keys, F.col("v").alias("_v"), (F.col("cum_n") - F.col("n")).alias("_below")
    )
    rows = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    placed = rows.join(steps, [*keys, "_v"]).withColumn("_one", F.lit(1))
    within = running_totals(placed, [*keys, "_v"], tie, ["_one"])
    return within.withColumn(
        out, (F.col("_below") + F.col("cum__one") - 1).cast("long")
    ).drop("_v", "_below", "_one", "cum__one", "all__one")
