"""Leakage-controlled splits as distributed fills over groups.

Every greedy loop of the sequential algorithm visits groups in a fixed order and stops
at a budget, so it equals a running sum over that order.  Running sums are sliced
(``ordered``), orders come from hashes of keys, and only a few numbers per split reach
the driver.  Rows never do.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as K
from tidegauge.functions.expressions import seeded_hash
from tidegauge.operators import audit
from tidegauge.operators.dedup import every_kth, linspace_hit, quantile_bins
from tidegauge.operators.joins import edge_votes, route
from tidegauge.operators.ordered import at_quantile, ladder, positions, running_totals
from tidegauge.operators.pairwise import similar_pairs, token_sets, with_set_key
from tidegauge.operators.rules import split_health
from tidegauge.operators.stats import two_sample_ks
from tidegauge.session import stage


def before_in_order(df: DataFrame, keys: Sequence[str], order: str, measure: str, out: str) -> DataFrame:
    """Sum of ``measure`` over rows that come earlier in ``order`` (equal orders share it)."""
    steps = df.groupBy(*keys, order).agg(F.sum(measure).alias("_m"))
    run = running_totals(steps, keys, order, ["_m"]).select(*keys, order, (F.col("cum__m") - F.col("_m")).alias(out))
    return df.join(run, [*keys, order])


def fill_ascending(groups: DataFrame, budget: int, out: str) -> DataFrame:
    """Flag groups taken smallest first (hash order inside a size) while the sum fits.

    Sizes only grow, so the first misfit ends the fill: a prefix of the order.
    """
    one = groups.withColumn("_one", F.lit(1))
    within = before_in_order(one, ["size"], "h", "_one", "_rank")
    classes = groups.groupBy("size").agg(F.sum("size").alias("_w"))
    run = running_totals(classes.withColumn("_v", F.col("size").cast("double")), [], "_v", ["_w"])
    ahead = run.select("size", (F.col("cum__w") - F.col("_w")).alias("_ahead"))
    total = F.col("_ahead") + (F.col("_rank") + 1) * F.col("size")
    return within.join(ahead, "size").withColumn(out, total <= budget).drop("_one", "_rank", "_ahead")


def scaffold_split(
    df: DataFrame, id_col: str, group: str, value: str, test_share: float = 0.15, val_share: float = 0.10,
    cap_share: float = 0.08, seed: int = 42,
) -> DataFrame:
    """Whole groups to one subset: oversized to train, size bins to test, small to val,
    single-row groups spread evenly along the value order."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.min(value).alias("_v"), F.min(id_col).alias("_id"))
    groups = stage(sizes.withColumn("h", seeded_hash(F.col(group), seed)))
    n = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    test_budget, val_budget = math.ceil(test_share * n), math.ceil(val_share * n)
    cap = max(1, math.ceil(cap_share * test_budget))
    target = test_budget - math.ceil(0.10 * test_budget)
    eligible = groups.filter((F.col("size") > 1) & (F.col("size") <= cap))

    edges = ladder(eligible, [], "size").agg(*[at_quantile(q).alias(f"e{i}") for i, q in enumerate((0, .25, .5, .75, 1))]).first()
    inner = sorted({e for e in edges if e is not None})[1:-1]
    binned = eligible.withColumn("bin", sum(((F.col("size") >= e).cast("int") for e in inner), F.lit(0)))
    mass = {r["bin"]: r["w"] for r in binned.groupBy("bin").agg(F.sum("size").alias("w")).collect()}
    budgets = {b: round(target * w / max(1, sum(mass.values()))) for b, w in mass.items()}
    chosen = F.lit(0)
    for b, budget in budgets.items():
        chosen = F.when(F.col("bin") == b, budget).otherwise(chosen)
    filled = stage(before_in_order(binned, ["bin"], "h", "size", "before").withColumn("test", F.col("before") < chosen))
    val = stage(fill_ascending(filled.filter("NOT test").select(group, "size", "h"), val_budget, "val"))
    n_test = filled.agg(F.coalesce(F.sum(F.when(F.col("test"), F.col("size"))), F.lit(0))).first()[0]
    n_val = val.agg(F.coalesce(F.sum(F.when(F.col("val"), F.col("size"))), F.lit(0))).first()[0]

    single = positions(groups.filter("size = 1"), [], "_v", "_id")
    m = groups.filter("size = 1").filter(F.col("_v").isNotNull()).count()
    k_test = min(max(0, test_budget - n_test), m)
    k_val = min(max(0, val_budget - n_val), m - k_test)
    pos = F.col("pos")
    hit = linspace_hit(pos, F.lit(m), F.lit(k_test))
    passed = F.when(F.lit(k_test <= 0), 0).when(F.lit(k_test == 1), F.least(pos, F.lit(1))).otherwise(
        F.least(F.lit(k_test), F.ceil(pos * (k_test - 1) / max(1, m - 1))))
    single = single.withColumns({"_hit": hit, "_rest": (pos - passed).cast("long")})
    val_hit = ~F.col("_hit") & linspace_hit(F.col("_rest"), F.lit(m - k_test), F.lit(k_val))
    labels = (
        filled.filter("test").select(group, F.lit("test").alias("split"))
        .unionByName(val.filter("val").select(group, F.lit("val").alias("split")))
        .unionByName(single.select(group, F.when(F.col("_hit"), "test").when(val_hit, "val").otherwise("train").alias("split"))))
    return df.join(labels, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def random_split(df: DataFrame, id_col: str, value: str, test_share: float = 0.15, val_share: float = 0.10, seed: int = 42) -> DataFrame:
    """Quintile-stratified by hash order; rows without a value go to train."""
    rows = quantile_bins(df, value, 5, "_q").withColumn("_h", seeded_hash(F.col(id_col), seed))
    counts = rows.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"))
    placed = positions(rows.filter(F.col("_q").isNotNull()), ["_q"], "_h", id_col, out="_pos").join(counts, "_q")
    t, v = F.bround(F.col("_n") * test_share), F.bround(F.col("_n") * val_share)
    split = F.when(F.col("_pos") < t, "test").when(F.col("_pos") < t + v, "val").otherwise("train")
    rest = rows.filter(F.col("_q").isNull()).select(*df.columns, F.lit("train").alias("split"))
    return placed.select(*df.columns, split.alias("split")).unionByName(rest)


def lead_split(
    df: DataFrame, id_col: str, key: str, group: str, value: str, test_share: float = 0.15, val_share: float = 0.10, min_size: int = 4
) -> DataFrame:
    """Every k-th row of each group to test and val; keys also seen in train go to train."""
    picked = stage(every_kth(df, group, value, id_col, test_share, val_share, min_size))
    in_train = picked.filter("split = 'train'").select(key).distinct().withColumn("_tr", F.lit(True))
    return picked.join(in_train, key, "left").withColumn(
        "split", F.when(F.coalesce("_tr", F.lit(False)), "train").otherwise(F.col("split"))).drop("_tr")


def stratified_pick(pool: DataFrame, id_col: str, value: str, budget: int, seed: int, out: str = "picked") -> DataFrame:
    """Flag ``budget`` rows: a proportional share of each quintile by hash, then a top-up."""
    rows = stage(quantile_bins(pool, value, 5, "_q").withColumn("_q", F.coalesce("_q", F.lit(-1))).withColumn("_h", seeded_hash(F.col(id_col), seed)))
    counts = {r["_q"]: r["n"] for r in rows.groupBy("_q").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(counts.values()))
    quota = {q: (0 if q < 0 else min(n, round(budget * n / total))) for q, n in sorted(counts.items())}
    ahead, offset = {}, 0
    for q, k in quota.items():
        ahead[q], offset = offset, offset + k
    table = lambda d: F.element_at(F.create_map(*[F.lit(int(x)) for kv in d.items() for x in kv]), F.col("_q"))
    if not counts:
        return rows.drop("_q", "_h").withColumn(out, F.lit(False))
    placed = stage(positions(rows, ["_q"], "_h", id_col, out="_pos").withColumns({"_quota": table(quota), "_ahead": table(ahead)}))
    first = placed.filter("_pos < _quota").withColumn("_rank", F.col("_ahead") + F.col("_pos"))
    later = positions(placed.filter("_pos >= _quota"), [], "_h", id_col, out="_late").withColumn("_rank", F.col("_late") + offset).drop("_late")
    return first.unionByName(later).select(*pool.columns, (F.col("_rank") < budget).alias(out))


def cliff_split(
    df: DataFrame, edges: DataFrame | None, id_col: str, group: str, value: str,
    test_share: float = 0.15, val_share: float = 0.10, seed: int = 42,
) -> tuple[DataFrame, dict]:
    """Less active ends of similar pairs to test, more active ends to train.

    ``edges`` has ``src`` and ``dst``.  Without usable edges the scaffold split stands in.
    """
    usable = None
    if edges is not None:
        votes = stage(edge_votes(edges, df, "src", "dst", id_col, value))
        usable = votes.agg(F.sum("n_edges")).first()[0]
    if not usable:
        reason = "no_file_provided" if edges is None else "zero_pairs_mapped"
        return scaffold_split(df, id_col, group, value, test_share, val_share, seed=seed), {"fallback_reason": reason, "n_pairs_usable": 0}
    n = df.count()
    test_budget, val_budget = math.ceil(test_share * n), math.ceil(val_share * n)
    middle = ladder(df, [], value).agg(at_quantile(0.5)).first()[0]
    v = F.coalesce(F.col("votes"), F.lit(0))
    candidate = (v > 0) | (F.col("votes").isNotNull() & (v == 0) & (F.col(value) < middle))
    base = stage(df.join(votes.select(id_col, "votes"), id_col, "left").withColumns({"_cand": candidate, "_anchor": v < 0}).drop("votes"))
    capped = positions(base.filter("_cand"), [], value, id_col, out="_p").filter(F.col("_p") < test_budget)
    test_cliff = stage(capped.select(id_col, F.lit(True).alias("_tc")))
    marked = stage(base.join(test_cliff, id_col, "left").withColumn("_tc", F.coalesce("_tc", F.lit(False))))
    n_cliff = marked.filter("_tc").count()
    free = marked.filter("NOT _tc AND NOT _anchor")
    extra = stage(stratified_pick(free, id_col, value, max(0, test_budget - n_cliff), seed).filter("picked").select(id_col, F.lit(True).alias("_te")))
    with_test = stage(marked.join(extra, id_col, "left").withColumn("_test", F.col("_tc") | F.coalesce("_te", F.lit(False))))
    pool = with_test.filter("NOT _test AND NOT _anchor").drop("_te")
    val = stratified_pick(pool, id_col, value, val_budget, seed + 1).filter("picked").select(id_col, F.lit(True).alias("_va"))
    split = F.when(F.col("_test"), "test").when(F.coalesce("_va", F.lit(False)), "val").otherwise("train")
    out = with_test.join(val, id_col, "left").withColumn("split", split).select(*df.columns, "split", F.col("_tc").alias("is_cliff_test"))
    return out, {"n_pairs_usable": int(usable) // 2, "cliff_test_count": n_cliff,
                 "cliff_test_coverage_pct": round(100 * n_cliff / max(1, test_budget), 1)}


# ------------------------------------------------------------------ folds and targets


def _deal(size: int, count: int, deficits: list[float], seed: int) -> list[int]:
    """How many of ``count`` equal groups each bucket gets when every group goes to the
    largest deficit; ties go by a seeded hash of (size, bucket), so that no bucket always
    gets the large groups.  Closed form: level, then leftovers."""
    k = len(deficits)
    turn = [hashlib.md5(f"{size}|{i}|{seed}".encode()).hexdigest() for i in range(k)]
    low, high = min(deficits) - size * (count + 1), max(deficits)
    taken = lambda level: [max(0, math.floor((d - level) / size)) for d in deficits]
    for _ in range(200):
        mid = (low + high) / 2
        if sum(taken(mid)) > count:
            low = mid
        else:
            high = mid
        if high - low < 1e-9 * max(1.0, abs(high)):
            break
    got = taken(high)
    while sum(got) < count:
        best = max(range(k), key=lambda i: (deficits[i] - got[i] * size, turn[i]))
        got[best] += 1
    return got


def deal_groups(groups: DataFrame, targets: dict[str, float], tie: str, seed: int = 42) -> DataFrame:
    """Largest groups first, each to the bucket with the largest deficit.

    The driver sees one line per distinct size.  Sizes sum to the row count N, so there
    are at most sqrt(2 N) lines.  Inside a size, groups follow ``tie`` order.
    """
    shape = groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    names = list(targets)
    deficits = [float(targets[b]) for b in names]
    lines = []
    for row in shape:
        got = _deal(row["size"], row["n"], deficits, seed)
        deficits = [d - g * row["size"] for d, g in zip(deficits, got)]
        ends, total = [], 0
        for g in got:
            total += g
            ends.append(total)
        lines.append((row["size"], ends))
    if not lines:
        return groups.withColumn("bucket", F.lit(names[-1]))
    table = groups.sparkSession.createDataFrame(lines, "size bigint, ends array<bigint>")
    placed = positions(groups, ["size"], tie, "h", out="_p").join(table, "size")
    index = F.size(F.filter("ends", lambda e: e <= F.col("_p")))
    return placed.withColumn("bucket", F.element_at(F.array(*[F.lit(b) for b in names]), index + 1)).drop("_p", "ends")


def scaffold_folds(df: DataFrame, id_col: str, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold per row: groups stay whole, largest first to the emptiest fold; singletons deal round."""
    groups = stage(df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("h", seeded_hash(F.col(group), seed)))
    n = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = {str(k): n // folds + (1 if k < n % folds else 0) for k in range(folds)}
    multi = deal_groups(groups.filter("size > 1"), targets, "h", seed).select(group, F.col("bucket").cast("int").alias("fold"))
    single = positions(groups.filter("size = 1"), [], "h", "h").select(group, (F.col("pos") % folds).cast("int").alias("fold"))
    return df.join(multi.unionByName(single), group)


def distribute_groups(df: DataFrame, group: str, label: str, targets: dict[str, float], seed: int = 42) -> DataFrame:
    """Groups by falling size, then rising mean label, to the largest deficit (test, val, train)."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.avg(F.coalesce(F.col(label).cast("double"), F.lit(0.0))).alias("_m"))
    groups = stage(groups.withColumn("h", seeded_hash(F.col(group), seed)))
    ordered = {name: targets[name] for name in ("test", "val", "train")}
    dealt = deal_groups(groups, ordered, "_m", seed).select(group, F.col("bucket").alias("split"))
    return df.join(dealt, group)


def align_split(
    other: DataFrame, assigned: DataFrame, id_col: str, group: str, label: str, group_only: bool = False,
    test_share: float = 0.15, val_share: float = 0.10, seed: int = 42,
) -> DataFrame:
    """Carry a split to another task: by id, by group, else dealt to the open budgets.

    Val keeps at least the minimum share; whole groups stay together.
    """
    routed = stage(route(other, assigned.select(id_col, "split"), assigned.select(group, "split"), id_col, group, group_only))
    counts = {r["split"]: r["n"] for r in routed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    want = {"test": math.ceil(test_share * n), "val": max(math.ceil(val_share * n), math.ceil(K.MIN_VAL_FRACTION * n))}
    want["train"] = n - want["test"] - want["val"]
    open_rows = routed.filter("split = 'unassigned'").drop("split")
    left = {b: max(0, want[b] - counts.get(b, 0)) for b in want}
    return routed.filter("split <> 'unassigned'").unionByName(distribute_groups(open_rows, group, label, left, seed))


def audit_split(assigned: DataFrame, id_col: str, group: str, value: str, allow_group_overlap: bool = False) -> DataFrame:
    """One row of overlaps and drift; raises on leakage."""
    from tidegauge.operators.stats import class_drift

    keys = F.array(*[F.struct(F.lit(n).alias("name"), F.col(k).cast("string").alias("key")) for n, k in (("group", group), ("id", id_col))])
    inside = {s: F.bool_or(F.col("split") == s) for s in ("train", "test", "val")}
    sides = assigned.select("split", F.inline(keys)).filter(F.col("key").isNotNull()).groupBy("name", "key").agg(*[c.alias(s) for s, c in inside.items()])
    found = sides.groupBy("name").agg(*[F.count_if(F.col("train") & F.col(s)).alias(s) for s in ("test", "val")]).collect()  # two rows
    overlaps = {r["name"]: r for r in found}
    out = class_drift(assigned, "split", value, K.ACTIVE_FROM)
    for name, strict in (("group", not allow_group_overlap), ("id", True)):
        for other in ("test", "val"):
            shared = overlaps[name][other] if name in overlaps else 0
            if shared and strict and other == "test":
                raise RuntimeError(f"{name} leakage: {shared} in train and test")
            out = out.withColumn(f"{name}_train_{other}_overlap", F.lit(int(shared)))
    return out


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """Proportional sample of ``n`` distinct keys (at least one per stratum), topped up."""
    from tidegauge.operators.dedup import keep_first

    rows = stage(keep_first(df, [key], F.col(stratum)).withColumn("_h", seeded_hash(F.col(key), seed)))
    counts = {r[stratum]: r["n"] for r in rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if total <= n:
        return rows.drop("_h")
    ahead, quota, offset = {}, {}, 0
    for s, c in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])):
        quota[s], ahead[s] = min(c, max(1, round(c / total * n))), offset
        offset += quota[s]
    table = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col(stratum))
    placed = stage(positions(rows, [stratum], "_h", key, out="_p").withColumns({"_q": table(quota), "_a": table(ahead)}))
    first = placed.filter("_p < _q").withColumn("_r", F.col("_a") + F.col("_p"))
    later = positions(placed.filter("_p >= _q"), [], "_h", key, out="_l").withColumn("_r", F.col("_l") + offset).drop("_l")
    return first.unionByName(later).filter(F.col("_r") < n).select(*df.columns)


# ---------------------------------------------------------------- similarity clusters


def centroid_clusters(sets: DataFrame, cutoff: float, pairs: DataFrame | None = None) -> DataFrame:
    """Cluster of every row of ``token_sets``: ``pid``, ``n_members``, ``centroid``.

    ``pairs`` are written ``similar_pairs`` of the same or a lower cut-off.

    The sequential rule visits sets by falling neighbour count (then id) and opens a
    cluster at each set not yet taken.  A set opens a cluster exactly when no earlier
    neighbour does, so rounds settle every set that precedes its open neighbours; each
    set then joins its earliest neighbouring centroid.
    """
    nodes = sets.select("pid", "n_members")
    near = similar_pairs(sets, cutoff) if pairs is None else pairs.filter(F.col("similarity") >= cutoff - 1e-12)
    edges = stage(near.select("left", "right"))
    links = stage(edges.select(F.col("left").alias("u"), F.col("right").alias("v")).unionByName(
        edges.select(F.col("right").alias("u"), F.col("left").alias("v"))))
    weight = links.join(nodes.select(F.col("pid").alias("v"), "n_members"), "v").groupBy("u").agg(F.sum("n_members").alias("_d"))
    ranked = stage(nodes.join(weight, nodes["pid"] == weight["u"], "left").select(
        "pid", "n_members", (F.coalesce("_d", F.lit(0)) + F.col("n_members") - 1).alias("degree")))
    order = F.struct("degree", "pid")
    prio = ranked.select("pid", order.alias("o"))
    near = stage(links.join(prio.select(F.col("pid").alias("u"), F.col("o").alias("ou")), "u")
                 .join(prio.select(F.col("pid").alias("v"), F.col("o").alias("ov")), "v").select("u", "v", "ou", "ov"))
    open_links = near
    linked = near.select(F.col("u").alias("pid")).distinct()
    centroids = ranked.select("pid").join(linked, "pid", "left_anti").withColumn("is_centroid", F.lit(True))
    pieces = [stage(centroids)]
    while not open_links.isEmpty():
        heads = stage(open_links.groupBy("u").agg(F.max("ov").alias("top"), F.first("ou").alias("o")).filter("o > top").select(F.col("u").alias("pid")))
        taken = open_links.join(heads, open_links["u"] == heads["pid"], "left_semi").select(F.col("v").alias("pid")).distinct()
        gone = stage(heads.unionByName(taken).distinct())
        survivors = (open_links.join(gone, open_links["u"] == gone["pid"], "left_anti"))
        survivors = survivors.join(gone, survivors["v"] == gone["pid"], "left_anti")
        # Sets whose links all vanished while still open have no earlier centroid: they open one.
        still = open_links.select(F.col("u").alias("pid")).distinct().join(gone, "pid", "left_anti")
        open_links = stage(survivors)
        lonely = still.join(open_links.select(F.col("u").alias("pid")).distinct(), "pid", "left_anti")
        pieces.append(stage(heads.unionByName(lonely).withColumn("is_centroid", F.lit(True))))
    heads = pieces[0]
    for piece in pieces[1:]:
        heads = heads.unionByName(piece)
    heads = stage(heads)
    joined = near.join(heads.select(F.col("pid").alias("v")), "v").groupBy(F.col("u").alias("pid")).agg(F.max("ov").alias("best"))
    return (ranked.join(heads, "pid", "left").join(joined, "pid", "left")
            .select("pid", "n_members", F.when(F.col("is_centroid"), F.col("pid")).otherwise(F.col("best.pid")).alias("centroid")))


def similarity_split(
    items: DataFrame, tokens: str, sets: DataFrame, cutoff: float, test_share: float = 0.15, val_share: float = 0.10,
    cap_share: float = 0.10, seed: int = 42, pairs: DataFrame | None = None,
) -> tuple[DataFrame, dict]:
    """Smallest clusters to test, then val, the rest to train: ``id``, ``split``, and figures."""
    clusters = stage(centroid_clusters(sets, cutoff, pairs))
    groups = stage(clusters.groupBy("centroid").agg(F.sum("n_members").alias("size")).withColumn("h", seeded_hash(F.col("centroid"), seed)))
    n, n_clusters, largest = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    test_budget, val_budget = math.ceil(test_share * n), math.ceil(val_share * n)
    cap = max(1, math.ceil(cap_share * test_budget))
    small = groups.filter(F.col("size") <= cap)
    test = stage(fill_ascending(small, test_budget, "in_test"))
    val = fill_ascending(test.filter("NOT in_test").drop("in_test"), val_budget, "in_val")
    labels = test.filter("in_test").select("centroid", F.lit("test").alias("split")).unionByName(
        val.filter("in_val").select("centroid", F.lit("val").alias("split")))
    by_set = clusters.join(labels, "centroid", "left").select("pid", F.coalesce("split", F.lit("train")).alias("split"))
    keyed = with_set_key(items, tokens).select("id", "set_key")
    rows = stage(keyed.join(sets.select("set_key", "pid"), "set_key").join(by_set, "pid").select("id", "split"))
    sizes = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return rows, {"cutoff": cutoff, "n_clusters": n_clusters, "largest_fraction": round(largest / n, 4) if n else 0.0,
                  "n_test": sizes.get("test", 0), "n_val": sizes.get("val", 0), "test_budget": test_budget}


def adaptive_similarity_split(items: DataFrame, tokens: str, cutoffs: Sequence[float] = tuple(K.CLUSTER_CUTOFFS), **options) -> tuple[DataFrame, dict]:
    """First cut-off with a sound partition, else the least bad one, marked degenerate.

    Pairs are found at the first cut-off and, only if a lower one is reached, once more at
    the lowest; the others filter them.
    """
    best = None
    tried = []
    sets = token_sets(items, tokens)
    pairs, found = None, math.inf
    for cutoff in cutoffs:
        if cutoff < found:
            found = cutoff if pairs is None else min(cutoffs)
            pairs = stage(similar_pairs(sets, found))
        rows, info = similarity_split(items, tokens, sets, cutoff, pairs=pairs, **options)
        tried.append(cutoff)
        share, k, budget = info["largest_fraction"], info["n_clusters"], info["test_budget"]
        sound = share <= 0.50 and k >= 100 and info["n_val"] > 0 and info["n_test"] >= 0.8 * budget
        if sound:
            return rows, {**info, "tried": tried, "degenerate": False}
        score = -share * 200 - max(0, 100 - k) - (100 if info["n_val"] == 0 else 0) - max(0, budget - info["n_test"]) * 2
        if best is None or score > best[0]:
            best = (score, rows, info)
    return best[1], {**best[2], "tried": tried, "degenerate": True}


def with_folds(assigned: DataFrame, folds: int = 5) -> DataFrame:
    """One (fold, row) line per fold with ``cv_split``: the fold's own rows are val."""
    lines = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("cv_fold")
    own: Column = F.when(F.col("cv_fold") == F.col("fold"), "val").otherwise("train")
    return assigned.select("*", lines).withColumn("cv_split", own)




def split_diagnostics(assigned: DataFrame, keys: Sequence[str], id_col: str, group: str, value: str, name: str) -> DataFrame:
    """One row of measured figures for each split in a long table of assignments.

    ``keys`` tell the splits apart and ``name`` holds a split's strategy.  ``digest`` depends
    on which id is in which subset, and not on the order or the partitions of the rows.
    """
    keys = list(keys)
    of = lambda s: F.col("split") == s
    active = lambda s: 100.0 * F.avg(F.when(of(s), (F.col(value) >= K.ACTIVE_FROM).cast("double")))
    sizes = assigned.groupBy(*keys).agg(
        *[F.count_if(of(s)).alias(f"n_{s}") for s in ("train", "val", "test")], F.round(F.abs(active("train") - active("test")), 1).alias("drift_pp"),
        F.sum(F.xxhash64(F.col(id_col), F.col("split")).cast("decimal(38,0)")).alias("digest"))
    sides = assigned.groupBy(*keys, group).agg(F.bool_or(of("train")).alias("_train"), F.bool_or(of("test")).alias("_test"))
    groups = sides.groupBy(*keys).agg(F.count_if("_test").alias("n_groups_test"), F.count_if(F.col("_train") & F.col("_test")).alias("group_overlap"))
    twice = assigned.groupBy(*keys, id_col).agg(F.bool_or(of("train")).alias("_train"), F.bool_or(of("test")).alias("_test"))
    leaks = twice.groupBy(*keys).agg(F.count_if(F.col("_train") & F.col("_test")).alias("id_overlap"))
    ks = two_sample_ks(assigned.filter(F.col("split").isin("train", "test")), keys, value, of("train")).select(*keys, "ks_stat", "ks_p")
    joined = sizes.join(groups, keys).join(leaks, keys).join(ks, keys, "left")
    diversity = F.col("n_groups_test") / F.nullif(F.col("n_test"), F.lit(0))
    health = split_health(F.col(name), F.col("id_overlap") > 0, F.col("drift_pp"), F.col("n_val"), F.col("ks_stat"), F.col("ks_p"),
                          F.lit(None).cast("double"), diversity, F.lit(None).cast("double"))
    return joined.select("*", diversity.alias("diversity"), *[c.alias(n) for n, c in health.items()])


def validate_splits(
    rows: DataFrame, strategies: dict[str, Callable[[DataFrame, int], DataFrame]], id_col: str, group: str, value: str,
    seeds: Sequence[int] = tuple(K.VALIDATION_SEEDS),
) -> DataFrame:
    """One verdict row a strategy: is it deterministic, and do its figures hold over seeds?

    A strategy takes (rows, seed) and adds ``split``.  With the first seed it runs a second
    time on rows that lie in other partitions and another order; both must put the same ids
    in the same subsets.  Then test size (share of the largest), KS distance and health may
    spread over the seeds by the limits in ``constants``.
    """
    parts = []
    for name, split in strategies.items():
        for run, seed in [*((0, s) for s in seeds), (1, seeds[0])]:
            own = rows if run == 0 else rows.repartition(7, F.xxhash64(id_col, F.lit("again"))).sortWithinPartitions(F.desc(id_col))
            done = split(own, seed).select(id_col, group, value, "split")
            parts.append(done.select(F.lit(name).alias("strategy"), F.lit(seed).alias("seed"), F.lit(run).alias("run"), id_col, group, value, "split"))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    figures = stage(split_diagnostics(stage(long), ["strategy", "seed", "run"], id_col, group, value, "strategy"))
    once = F.col("run") == 0
    spread = lambda c: F.max(F.when(once, F.col(c))) - F.min(F.when(once, F.col(c)))
    again = F.when(F.col("seed") == seeds[0], F.col("digest"))
    table = figures.groupBy("strategy").agg(
        (F.min(again) == F.max(again)).alias("deterministic"), F.count_if(once).alias("n_seeds"),
        (spread("n_test") / F.nullif(F.max(F.when(once, F.col("n_test"))), F.lit(0))).alias("test_size_spread"),
        spread("ks_stat").alias("ks_spread"), spread("health_score").alias("health_spread"), F.max("id_overlap").alias("id_overlap"))
    issues = F.filter(F.array(
        F.when(~F.col("deterministic"), "two runs differ"), F.when(F.col("id_overlap") > 0, "ids in train and test"),
        F.when(F.col("test_size_spread") > K.SPREAD_TEST_SIZE, "test size"), F.when(F.col("ks_spread") > K.SPREAD_KS, "ks"),
        F.when(F.col("health_spread") > K.SPREAD_HEALTH, "health")), lambda x: x.isNotNull())
    return table.select("*", issues.alias("issues"), (F.size(issues) == 0).alias("passed"))
