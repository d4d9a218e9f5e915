"""Evaluation statistics: metrics, calibration, two-sample tests, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.expressions import first_rule, lookup
from tidegauge.operators.ordered import attach_scalars, average_ranks, quantiles, running_totals


def two_sample_ks(df: DataFrame, keys: Sequence[str], value: str, in_first: Column) -> DataFrame:
    """Largest gap between two empirical distributions and its asymptotic p-value."""
    held = df.filter(F.col(value).isNotNull())
    steps = held.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.sum(in_first.cast("long")).alias("a"), F.sum((~in_first).cast("long")).alias("b"))
    run = running_totals(steps, keys, "v", ["a", "b"])
    none = F.lit(0).cast("long")  # one empty side has no distance
    gap = F.abs(F.col("cum_a") / F.nullif("all_a", none) - F.col("cum_b") / F.nullif("all_b", none))
    per_key = run.groupBy(*keys).agg(
        F.max(gap).alias("ks_stat"), F.max("all_a").alias("n_a"), F.max("all_b").alias("n_b"))
    lam = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("ks_stat")
    series = sum((-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21))
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))
    return per_key.withColumn("ks_p", p)


def cohens_d(df: DataFrame, keys: Sequence[str], value: str, in_first: Column) -> DataFrame:
    a, b = F.when(in_first, F.col(value)), F.when(~in_first, F.col(value))
    moments = df.groupBy(*keys).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"),
        F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb"))
                    / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0)))
    return moments.withColumn("d", (F.col("_ma") - F.col("_mb")) / F.nullif(pooled, F.lit(0.0))).select(
        *keys, "n_a", "n_b", "d")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho") -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(*keys, x, y), keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias(out))


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str, p: str, w: str) -> DataFrame:
    """Weighted RMSE, MAE and R2, unweighted Spearman."""
    truth, error, weight = F.col(y), F.col(y) - F.col(p), F.col(w)
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("_w"), F.sum(weight * truth).alias("_wy"),
        F.sum(weight * truth * truth).alias("_wyy"), F.sum(weight * error * error).alias("_se"),
        F.sum(weight * F.abs(error)).alias("_ae"))
    total = F.col("_wyy") - F.col("_wy") * F.col("_wy") / F.col("_w")
    point = sums.select(
        *keys, "n", F.sqrt(F.col("_se") / F.col("_w")).alias("rmse"), (F.col("_ae") / F.col("_w")).alias("mae"),
        (1 - F.col("_se") / F.nullif(total, F.lit(0.0))).alias("r2"))
    rho = spearman(df, keys, y, p, "spearman_rho")
    return point.join(rho, list(keys)) if keys else attach_scalars(point, rho)


def classification_metrics(df: DataFrame, keys: Sequence[str], y: str, p: str, w: str, cut: float | Column) -> DataFrame:
    """Weighted thresholded metrics and Brier score from one pass of sums."""
    cut = cut if isinstance(cut, Column) else F.lit(cut)
    hit, pos, weight = F.col(p) >= cut, F.col(y) == 1, F.col(w)
    mass = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), mass(hit & pos).alias("tp"), mass(hit & ~pos).alias("fp"),
        mass(~hit & pos).alias("fn"), mass(~hit & ~pos).alias("tn"),
        (F.sum(weight * F.pow(F.col(p) - F.col(y), 2)) / F.sum(weight)).alias("brier"),
        (F.sum(weight * F.col(y)) / F.sum(weight)).alias("pos_rate"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return s.select(
        *keys, "n", ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        ((ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fp + fn)) / 2).alias("f1_macro"),
        mcc.alias("mcc"), "brier", "pos_rate")


def roc_steps(df: DataFrame, keys: Sequence[str], y: str, p: str, w: str) -> DataFrame:
    """Positive and negative weight per distinct score with running sums."""
    steps = df.groupBy(*keys, F.col(p).cast("double").alias("v")).agg(
        F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0.0).otherwise(F.col(w))).alias("neg"))
    return running_totals(steps, keys, "v", ["pos", "neg"])


def weighted_auc(df: DataFrame, keys: Sequence[str], y: str, p: str, w: str) -> DataFrame:
    """Chance that a positive outranks a negative, ties counted half; null for one class."""
    run = roc_steps(df, keys, y, p, w)
    above = F.col("all_pos") - F.col("cum_pos") + F.col("pos") / 2
    return run.groupBy(*keys).agg(
        (F.sum(F.col("neg") * above) / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0.0))).alias("roc_auc"))


def youden(df: DataFrame, keys: Sequence[str], y: str, p: str, w: str) -> DataFrame:
    """Threshold with the largest TPR - FPR; highest on ties; 0.5 when none is positive."""
    run = roc_steps(df, keys, y, p, w)
    tpr = (F.col("all_pos") - F.col("cum_pos") + F.col("pos")) / F.nullif(F.col("all_pos"), F.lit(0.0))
    fpr = (F.col("all_neg") - F.col("cum_neg") + F.col("neg")) / F.nullif(F.col("all_neg"), F.lit(0.0))
    j = F.round(tpr - fpr, 9)
    best = run.withColumn("_j", j).groupBy(*keys).agg(
        F.max("_j").alias("j"), F.max_by("v", F.struct(F.col("_j"), F.col("v"))).alias("_v"))
    cut = F.when(F.col("j") > 0, F.least(F.greatest(F.col("_v"), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    return best.withColumn("threshold", cut).drop("_v")


def bin_of(p: Column, n_bins: int) -> Column:
    """Equal-width bin of [0, 1] against explicit edges; the last bin is closed."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    return sum(((p >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def reliability_bins(df: DataFrame, keys: Sequence[str], y: str, p: str, w: str, n_bins: int = 10) -> DataFrame:
    weight = F.col(w)
    mean = lambda c: F.sum(F.col(c) * weight) / F.nullif(F.sum(weight), F.lit(0.0))
    bins = df.groupBy(*keys, bin_of(F.col(p), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("mass"), mean(p).alias("avg_proba"), mean(y).alias("obs_rate"))
    return bins.withColumn("gap", F.abs(F.col("avg_proba") - F.col("obs_rate")))


def calibration_error(df: DataFrame, keys: Sequence[str], y: str, p: str, w: str, n_bins: int = 10) -> DataFrame:
    bins = reliability_bins(df, keys, y, p, w, n_bins)
    return bins.groupBy(*keys).agg(
        (F.sum(F.col("mass") * F.col("gap")) / F.nullif(F.sum("mass"), F.lit(0.0))).alias("ece"), F.max("gap").alias("mce"))


# Applicability-domain bins, closed on the right.
DOMAIN_BINS = [("very novel", 0.4), ("novel", 0.55), ("moderate", 0.7), ("near", 0.85), ("very near", 1.001)]


def domain_bin(similarity: Column) -> Column:
    return first_rule([(similarity <= top, name) for name, top in DOMAIN_BINS])


def domain_statistics(df: DataFrame, keys: Sequence[str], similarity: str, gap: str) -> DataFrame:
    """Correlations, high-error and false-confidence rates per key."""
    high, near = F.col(gap) > 0.5, F.col(similarity) > 0.85
    rates = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(similarity, gap).alias("pearson"),
        F.avg(high.cast("double")).alias("high_error_rate"),
        F.avg(F.when(high, near.cast("double"))).alias("high_error_in_domain"),
        F.avg(F.when(near, high.cast("double"))).alias("false_confidence_rate"))
    rho = spearman(df, keys, similarity, gap, "spearman")
    return rates.join(rho, list(keys)) if keys else attach_scalars(rates, rho)


def _poisson_table() -> np.ndarray:
    """65,536 Poisson(1) outcomes in proportion to their chance, so 16 bits pick one."""
    chance = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 9.0)]))
    ends = np.round(np.cumsum(chance) * 65536).astype(int)
    ends[-1] = 65536
    return np.repeat(np.arange(9, dtype=np.uint8), np.diff(np.concatenate([[0], ends])))


_POISSON = _poisson_table()
#: the outcome is the number of these that 16 bits reach
_POISSON_ENDS = np.searchsorted(_POISSON, np.arange(1, _POISSON.max() + 1)).astype(np.uint16)
_DRAWN_ROWS = 256  # the work on so many rows stays in a core's cache


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: uniform bits from (id, replicate), independent of partitioning."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def poisson_draws(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """rows x replicates matrix of Poisson(1) counts from the ids alone.

    One 64-bit number per row and lane gives four draws of 16 bits each.
    """
    lanes = -(-replicates // 4)
    out = np.empty((len(ids), lanes * 4), np.uint8)
    with np.errstate(over="ignore"):
        base = _mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        steps = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for lo in range(0, len(ids), _DRAWN_ROWS):
            bits = base[lo : lo + _DRAWN_ROWS, None] + steps
            held = np.empty_like(bits)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # as ``_mix``, in place
                bits ^= np.right_shift(bits, np.uint64(shift), out=held)
                bits *= np.uint64(factor)
            lane, part = bits.view(np.uint16), out[lo : lo + _DRAWN_ROWS]
            part[:] = 0
            for end in _POISSON_ENDS:
                part += lane >= end
    return out[:, :replicates]


def bootstrap_regression(df: DataFrame, id_col: str, y: str, p: str, w: str, replicates: int, seed: int) -> DataFrame:
    """RMSE, MAE and R2 per bootstrap replicate.

    Each row draws its own Poisson count per replicate, so resampling needs no row
    exchange: a batch emits one line of sums per replicate, and those lines add up.
    """
    names = ["sw", "swy", "swyy", "sse", "sae"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((replicates, len(names)))
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                yy, ww = part[y].to_numpy(float), part[w].to_numpy(float)
                err = yy - part[p].to_numpy(float)
                terms = np.stack([ww, ww * yy, ww * yy * yy, ww * err * err, ww * np.abs(err)], axis=1)
                held += (terms.T @ poisson_draws(part[id_col].to_numpy(), replicates, seed).astype(float)).T
        out = pd.DataFrame(held, columns=names)
        out.insert(0, "replicate", np.arange(replicates, dtype=np.int32))
        yield out

    schema = "replicate int, " + ", ".join(f"{n} double" for n in names)
    parts = df.select(id_col, y, p, w).mapInPandas(sums, schema)
    total = parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])
    spread = F.col("swyy") - F.col("swy") * F.col("swy") / F.nullif(F.col("sw"), F.lit(0.0))
    return total.select(
        "replicate", F.sqrt(F.col("sse") / F.nullif(F.col("sw"), F.lit(0.0))).alias("rmse"),
        (F.col("sae") / F.nullif(F.col("sw"), F.lit(0.0))).alias("mae"),
        (1 - F.col("sse") / F.nullif(spread, F.lit(0.0))).alias("r2"))


def percentile_interval(draws: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """2.5 / 50 / 97.5 percentiles per metric; draws hold one row per replicate."""
    stacked = draws.unpivot(["replicate"], list(metrics), "metric", "value")
    return stacked.groupBy("metric").agg(
        F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.5)).alias("mid"),
        F.percentile("value", F.lit(0.975)).alias("high"), F.count("value").alias("n"))


def interval_agreement(points: DataFrame, intervals: DataFrame, keys: Sequence[str], limits: Mapping[str, float]) -> DataFrame:
    """Point values beside their bootstrap intervals, one row per cell (``keys``) and metric.

    ``points`` holds keys, metric, point; ``intervals`` keys, metric, low, mid, high.  A cell
    agrees if the point is within its metric's limit of the middle; a metric without a limit
    always does, and a cell without interval or point has null.
    """
    on = [*keys, "metric"]
    limit = lookup(F.col("metric"), limits) if limits else F.lit(None).cast("double")
    gap = F.abs(F.col("point") - F.col("mid"))
    return points.join(intervals.select(*on, "low", "mid", "high"), on, "left").withColumns({
        "width": F.col("high") - F.col("low"), "gap": gap, "limit": limit,
        "agrees": F.when(gap.isNotNull(), F.coalesce(gap <= limit, F.lit(True)))})


def agreement_audit(cells: DataFrame) -> DataFrame:
    """Audit lines over ``interval_agreement``: intervals present, widths per metric, agreement.

    Columns: check, metric, verdict, n (cells looked at), n_bad, low, mid, high (of the widths).
    """
    none = F.lit(None)
    line = lambda check, n, bad: cells.agg(n.alias("n"), bad.alias("n_bad")).select(
        F.lit(check).alias("check"), none.cast("string").alias("metric"), F.when(F.col("n_bad") == 0, "PASS").otherwise("WARN").alias("verdict"),
        "n", "n_bad", *[none.cast("double").alias(c) for c in ("low", "mid", "high")])
    held = cells.filter("width IS NOT NULL")
    widths = held.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.min("width").alias("low"), F.max("width").alias("high")).join(
        quantiles(held, ["metric"], "width", {"mid": 0.5}).select("metric", "mid"), "metric")
    return line("interval_present", F.count(F.lit(1)), F.count_if(F.col("width").isNull())).unionByName(
        line("point_near_middle", F.count("agrees"), F.count_if(~F.col("agrees")))).unionByName(
        widths.select(F.lit("interval_width").alias("check"), "metric", F.lit("INFO").alias("verdict"), "n", F.lit(0).cast("long").alias("n_bad"), "low", "mid", "high"))


def _pair_sums(id_col: str, y: str, p: str, w: str, replicates: int, seed: int, rows: int = 2048):
    """Rows of one range of scores, ascending, to a line of sums per replicate.

    ``pairs`` is the weight of (positive, negative) pairs inside the range in which the
    positive is above, ties half.  A tie that spans two batches is carried over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        pos, neg, pairs = (np.zeros(replicates) for _ in range(3))
        held: tuple[float, np.ndarray, np.ndarray] | None = None

        def close(a: np.ndarray, b: np.ndarray) -> None:
            """Adds score groups (rows of ``a`` and ``b``) above all before them."""
            nonlocal pos, neg, pairs
            below = neg + np.cumsum(b, axis=0) - b
            pairs = pairs + (a * (below + b / 2)).sum(axis=0)
            pos, neg = pos + a.sum(axis=0), neg + b.sum(axis=0)

        for pdf in batches:
            for low in range(0, len(pdf), rows):
                cut = pdf.iloc[low : low + rows]
                drawn = poisson_draws(cut[id_col].to_numpy(), replicates, seed) * cut[w].to_numpy(float)[:, None]
                hit = (cut[y].to_numpy() == 1)[:, None]
                score = cut[p].to_numpy()
                first = np.concatenate([[0], np.flatnonzero(np.diff(score)) + 1])
                a, b = (np.add.reduceat(drawn * side, first, axis=0) for side in (hit, ~hit))
                if held is not None and held[0] == score[0]:
                    a[0] += held[1]
                    b[0] += held[2]
                elif held is not None:
                    close(held[1][None], held[2][None])
                close(a[:-1], b[:-1])
                held = (score[-1], a[-1], b[-1])
        if held is not None:
            close(held[1][None], held[2][None])
            yield pd.DataFrame({"part": part, "replicate": np.arange(replicates, dtype=np.int32), "pos": pos, "neg": neg, "pairs": pairs})

    return run


def bootstrap_auc(df: DataFrame, id_col: str, y: str, p: str, w: str, replicates: int, seed: int) -> DataFrame:
    """ROC-AUC per bootstrap replicate; ``id_col`` is numeric.

    Rows are dealt into ranges of the score and draw their own Poisson counts there, so no
    row is repeated: a range emits one line per replicate, and ranges add up in order.
    """
    held = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(
        F.col(id_col).cast("long").alias(id_col), F.col(y).cast("int").alias(y), F.col(p).cast("double").alias(p), F.col(w).cast("double").alias(w))
    parts = held.repartitionByRange(p).sortWithinPartitions(p).mapInPandas(
        _pair_sums(id_col, y, p, w, replicates, seed), "part int, replicate int, pos double, neg double, pairs double")
    below = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = parts.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return lines.groupBy("replicate").agg(
        (F.sum(F.col("pairs") + F.col("pos") * F.col("below")) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"))


def class_drift(df: DataFrame, split: str, value: str, threshold: float) -> DataFrame:
    """Active share per subset and the train-test distance in percentage points."""
    share = lambda name: 100.0 * F.avg(F.when(F.col(split) == name, (F.col(value) >= threshold).cast("double")))
    wide = df.agg(*[share(s).alias(f"{s}_pct_active") for s in ("train", "val", "test")])
    drift = F.abs(F.col("train_pct_active") - F.col("test_pct_active"))
    return wide.select(*[F.round(c, 1).alias(c) for c in wide.columns], F.round(drift, 1).alias("drift_pp"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    bin_start = F.floor(F.col(value) / width) * width
    return df.filter(F.col(value).isNotNull()).groupBy(bin_start.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def gaussian_density(df: DataFrame, value: str, low: float, high: float, points: int) -> DataFrame:
    """Kernel density on a fixed grid, Scott bandwidth.

    A batch adds its kernels to one grid-sized array, so only grid sums are exchanged.
    """
    n, std = df.agg(F.count(value), F.stddev_samp(value)).first()
    width = float(std) * float(n) ** (-1.0 / 5.0)
    grid = np.linspace(low, high, points)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(points)
        for pdf in batches:
            x = pdf[value].dropna().to_numpy(float)
            for lo in range(0, len(x), 8192):
                held += np.exp(-0.5 * ((grid[:, None] - x[None, lo : lo + 8192]) / width) ** 2).sum(axis=1)
        yield pd.DataFrame({"x": grid, "k": held})

    sums = df.select(F.col(value).cast("double").alias(value)).mapInPandas(kernels, "x double, k double")
    return sums.groupBy("x").agg((F.sum("k") / (n * width * float(np.sqrt(2 * np.pi)))).alias("density"))

