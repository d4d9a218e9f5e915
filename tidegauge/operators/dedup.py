"""Duplicate handling and ordered picks that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.operators.ordered import at_quantile, attach_scalars, ladder, positions


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column, k: int = 1) -> DataFrame:
    """First ``k`` rows per key.  Spark cuts every key to ``k`` rows before the shuffle
    (group limit), so a hot key never travels whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def flag_repeated(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """True for every row whose key occurs more than once; null keys match each other."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    renamed = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hit"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = df.join(renamed, match, "left").withColumn(out, F.coalesce("_hit", F.lit(False)))
    return joined.drop("_hit", *[f"_k{i}" for i in range(len(keys))])


def dedup_by_priority(
    df: DataFrame, id_col: str, flag: str, weight: str, order: str, max_loss: float | None = 0.25
) -> DataFrame:
    """Best row per id: stereo rank, then weight, then row order; stop on excessive loss."""
    rank = F.lit(3)
    for name, value in reversed(K.STEREO_DEDUP_RANK.items()):
        rank = F.when(F.lower(F.trim(F.col(flag))) == name, value).otherwise(rank)
    if max_loss is not None:
        n, kept = df.agg(F.count(F.lit(1)), F.countDistinct(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).first()
        if n and (n - kept) / n > max_loss:
            raise RuntimeError(f"dedup would remove {100 * (n - kept) / n:.1f}% of rows")
    return keep_first(df, [id_col], rank.asc(), F.coalesce(F.col(weight), F.lit(0.0)).desc(), F.col(order).asc())


def quantile_bins(df: DataFrame, value: str, q: int, out: str) -> DataFrame:
    """Equal-frequency bins with right-closed exact edges; repeated edges collapse."""
    names = [f"_e{i}" for i in range(q + 1)]
    edges = ladder(df, [], value).agg(*[at_quantile(i / q).alias(n) for i, n in enumerate(names)])
    distinct = edges.select(F.array_distinct(F.array(*names)).alias("_edges"))
    inner = F.filter(F.col("_edges"), lambda e: e < F.col(value))
    rows = attach_scalars(df, distinct)
    index = F.greatest(F.size(inner) - 1, F.lit(0))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), index)).drop("_edges")


def linspace_hit(position: Column, size: Column, wanted: Column) -> Column:
    """True when ``position`` is one of ``wanted`` evenly spaced indices of 0..size-1.

    Index i lands on floor(i (size-1) / (wanted-1)); the only i that can land on a
    position is ceil(position (wanted-1) / (size-1)).
    """
    span, steps = size - 1, wanted - 1
    i = F.floor((position * steps + span - 1) / span)
    lands = (i <= steps) & (F.floor(i * span / steps) == position)
    return F.when(wanted <= 0, False).when((wanted == 1) | (size == 1), position == 0).otherwise(F.coalesce(lands, F.lit(False)))


def outlier_flags(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """IQR and z-score outliers and a score inside each key; null for single values."""
    steps = ladder(df, keys, value).groupBy(*keys).agg(
        at_quantile(0.25).alias("_q1"), at_quantile(0.75).alias("_q3"), F.max("all_n").alias("_n"))
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    rows = df.join(steps.join(moments, list(keys)), list(keys), "left")
    v, q1, q3, n = F.col(value), F.col("_q1"), F.col("_q3"), F.col("_n")
    spread, enough = q3 - q1, n >= 3
    z = F.abs(v - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))
    cap = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(5.0)) / 5.0
    far = F.greatest(F.lit(0.0), q1 - v, v - q3) / (spread + 1e-6)
    no = lambda c: F.coalesce(c, F.lit(False))
    held = n >= 2
    return rows.withColumns({
        "is_iqr_outlier": F.when(held, enough & no((v < q1 - K.IQR_FACTOR * spread) | (v > q3 + K.IQR_FACTOR * spread))),
        "is_z_outlier": F.when(held, enough & no(z > K.ZSCORE_CUT)),
        "outlier_score": F.when(held, F.when(enough & (F.col("_sd") > 0), F.least(0.5 * cap(z) + 0.5 * cap(far), F.lit(1.0))).otherwise(0.0)),
    }).drop("_q1", "_q3", "_n", "_mu", "_sd")


def every_kth(df: DataFrame, group: str, value: str, tie: str, test_share: float, val_share: float, min_size: int) -> DataFrame:
    """Within-group picks along the value order: every k-th row to test, then to val.

    Positions are exact and closed forms replace the pick loops, so a group of any
    size is split over many tasks.  Small groups stay in train.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = positions(df, [group], value, tie, out="_pos").join(sizes, group)
    n = F.col("_n")
    t0 = F.greatest(F.lit(1), F.bround(n * test_share).cast("long"))
    v0 = F.bround(n * val_share).cast("long")
    tight = t0 + v0 >= n
    rows = placed.withColumn("_t", F.when(tight, F.greatest(F.lit(1), n - 2)).otherwise(t0))
    rows = rows.withColumn("_v", F.when(tight, F.greatest(F.lit(0), n - F.col("_t") - 1)).otherwise(v0))
    rows = rows.withColumn("_st", F.greatest(F.lit(1), F.floor(n / F.col("_t"))))
    pos = F.col("_pos")
    is_test = (pos % F.col("_st") == 0) & (F.floor(pos / F.col("_st")) < F.col("_t"))
    picked_before = F.least(F.col("_t"), F.ceil(pos / F.col("_st")))
    rows = rows.withColumns({"_is_test": is_test, "_rest": pos - picked_before, "_left": n - F.col("_t")})
    rows = rows.withColumn("_sv", F.greatest(F.lit(1), F.floor(F.col("_left") / F.nullif(F.col("_v"), F.lit(0)))))
    is_val = (F.col("_v") > 0) & (F.col("_rest") % F.col("_sv") == 0) & (F.floor(F.col("_rest") / F.col("_sv")) < F.col("_v"))
    split = F.when(n < min_size, "train").when(F.col("_is_test"), "test").when(F.coalesce(is_val, F.lit(False)), "val").otherwise("train")
    return rows.withColumn("split", split).select(*df.columns, "split")
