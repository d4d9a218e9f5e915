"""Gradient-boosted trees for many cells at once, on rows that stay distributed.

A cell is a setting, a held-out fold and a label.  All cells of a grid grow together: each
level of a round is one job, whatever the number of settings and folds.

* A feature is cut once at its exact quantiles; rows keep the bin numbers as bytes.
* A level: tasks add each row's gradient and weight to histograms of (cell, node, feature,
  bin) and send those that are not empty; the sums and the search for the best split run
  per cell, and only splits reach the driver (cells x nodes of the level at most).
* A node whose rows take less room than the histograms of the subtree under it sends its
  rows instead, and one task grows that subtree from them.  The sums are the same, so the
  tree is.  Up to about 40,000 rows (LEAST_BINS) always go, which saves a job a level.
* A round ends with one pass that adds the new leaves to every row's scores.  That table is
  written in the shared folder, so a lost task is run again from it.  With few rows a round
  is one job: tasks add the leaves of the last rounds themselves, and every eighth is written.
* Early stopping: the held-out rows' loss comes with the first level's histograms.  A cell
  stops by itself after ``patience`` rounds without a new least loss, and each row keeps its
  scores as of the best round; the other cells go on without it.
* Gradients are summed in fixed point, so the trees do not depend on how rows are dealt.
* ``fit_cells`` takes a table of up to OWN_ROWS rows to the cells instead: a task holds its
  rows as bytes and fits some cells from the first round to the last, so the grid is one job.
  Trees, rounds and predictions are those of ``fit``, which every larger table takes.

Memory of a task is cells x leaves x features x bins; nothing grows with the rows but the
table of scores (two floats a row and cell).  A task of ``fit_cells`` needs some 200 bytes a
row, whatever the number of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordered import quantiles
from tidegauge.operators.stats import _mix, weighted_auc
from tidegauge.session import new_folder, stage

#: gradients and weights are multiples of 2^-20
_SCALE = float(1 << 20)
_WIDE = 16  # bytes of a gradient and a curvature
LEAST_BINS = 1 << 11  # subtrees count as no smaller than that: below it a job costs more than rows
OWN_ROWS = 1 << 21  # rows that a task of ``fit_cells`` holds at most
WRITE_EVERY = 8  # rounds that tasks add anew to the scores, if a round is one job
_SPLITS = "cell int, node int, feature int, cut int, left_g double, left_h double, g double, h double"
_PARTIAL = "cell int, at binary, g binary, h binary, node binary, bins binary, own_g binary, own_h binary, loss double, weight double"
_PARTIAL_NAMES = [c.split()[0] for c in _PARTIAL.split(", ")]


@dataclass(frozen=True)
class Cell:
    """Rows of fold ``held`` stop the rounds; those of all other folds from 0 on are trained on."""

    held: int
    depth: int
    child_weight: float = 1.0
    alpha: float = 0.0
    label: int = 0
    loss: str = "squared"  # or "logistic"


@dataclass(frozen=True)
class Rounds:
    most: int = 2000
    patience: int = 50
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    penalty: float = 1.0
    bins: int = 32
    seed: int = 42


@dataclass
class _Tree:
    """One cell's tree of a round: feature -1 is a leaf; node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class Fitted:
    """``predictions`` has id, fold, labels, w, cell, p; ``rounds`` the best round of each cell."""

    predictions: DataFrame
    rounds: list[int]
    losses: list[float]
    history: list[list[float]] = field(default_factory=list)


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(keys.view(np.uint64) ^ np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)


def feature_cuts(rows: DataFrame, features: str, bins: int) -> np.ndarray:
    """Exact quantiles, one line a feature; at most features x bins numbers."""
    long = rows.select(F.posexplode(features).alias("feature", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    names = [f"q{i}" for i in range(1, bins)]
    found = quantiles(long, ["feature"], "x", {n: i / bins for i, n in enumerate(names, 1)}).collect()
    width = 1 + max((r["feature"] for r in found), default=-1)
    cuts = np.zeros((width, bins - 1))
    for r in found:
        cuts[r["feature"]] = [r[n] for n in names]
    return cuts


def _encoder(cuts: np.ndarray, base: np.ndarray):
    """Rows with numbers to rows with bins and the starting scores; a missing number is bin 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = base.astype(np.float32).tobytes()
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in row] for row in batch.column("features").to_pylist()], float).reshape(batch.num_rows, -1)
            bins = np.zeros((batch.num_rows, len(cuts)), np.uint8)
            for f in range(min(len(cuts), x.shape[1])):
                seen = ~np.isnan(x[:, f])
                bins[seen, f] = 1 + np.searchsorted(cuts[f], x[seen, f], side="left")
            yield pa.record_batch(
                [*(batch.column(c) for c in ("id", "fold", "draw", "w", "labels")), pa.array([b.tobytes() for b in bins], pa.binary()),
                 *(pa.array([start] * batch.num_rows, pa.binary()) for _ in range(2))],
                names=["id", "fold", "draw", "w", "labels", "bins", "score", "kept"])

    return run


def _matrix(column: pa.Array, kind, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _place(bins: np.ndarray, tree: _Tree, levels: int) -> np.ndarray:
    """Each row's node after at most ``levels`` splits; a leaf leads to itself."""
    leaf = tree.feature < 0
    at, ahead = np.where(leaf, 0, tree.feature).astype(np.int64), np.arange(len(leaf))
    ahead = np.where(leaf, ahead, 2 * ahead + 1)
    cut = np.where(leaf, 255, tree.cut).astype(np.uint8)
    node, flat, first = np.zeros(len(bins), np.int64), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    for _ in range(levels if len(flat) else 0):
        node = ahead[node] + (flat[first + at[node]] > cut[node])
    return node


def _gradients(cell: Cell, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and loss of each row."""
    if cell.loss == "squared":
        return w * (score - y), w, w * (score - y) ** 2
    p = 1.0 / (1.0 + np.exp(-score))
    loss = w * (np.logaddexp(0.0, score) - y * score)
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16), loss


@dataclass
class _Front:
    """The nodes of a cell's tree that a level looks at, and which of them send their rows."""

    tree: _Tree
    open: np.ndarray
    small: np.ndarray


@dataclass
class _Round:
    """Trees that the table of scores does not have yet; ``keep`` names the cells whose scores before them are the best so far."""

    trees: dict[int, _Tree]
    keep: np.ndarray
    deepest: int


def _replayed(bins: np.ndarray, score: np.ndarray, kept: np.ndarray | None, rounds: Sequence[_Round], rate: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores, and those of the best rounds, after ``rounds``."""
    score = score.copy()
    for done in rounds:
        if kept is not None:
            kept = np.where(done.keep, score, kept)
        for c, tree in done.trees.items():
            score[:, c] += np.float32(rate) * tree.value[_place(bins, tree, done.deepest)].astype(np.float32)
    return score, kept


def _histograms(cells: Sequence[Cell], fronts: dict[int, _Front], level: int, drawn: int, how: Rounds, rounds: Sequence[_Round]):
    """Sums of gradients and curvatures by (cell, node, feature, bin), as sparse rows, or rows of small nodes.

    At level 0 the held-out losses come along.
    """
    width = how.bins + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        sent: dict[int, list[tuple]] = {}
        losses = np.zeros((len(cells), 2))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins = _matrix(batch.column("bins"), np.uint8, n)
            score, _ = _replayed(bins, _matrix(batch.column("score"), np.float32, n), None, rounds, how.rate)
            fold, weight = batch.column("fold").to_numpy(), batch.column("w").to_numpy()
            labels = np.array(batch.column("labels").to_pylist(), float).reshape(n, -1)
            taken = _uniform(batch.column("draw").to_numpy(), drawn) < how.row_share
            features = bins.shape[1]
            for c, front in fronts.items():
                cell = cells[c]
                y = labels[:, cell.label]
                known = ~np.isnan(y)
                if level == 0:
                    own = known & (fold == cell.held)
                    losses[c] += [_gradients(cell, score[own, c].astype(float), y[own], weight[own])[2].sum(), weight[own].sum()]
                use = np.flatnonzero(known & taken & (fold >= 0) & (fold != cell.held))
                node = _place(bins[use], front.tree, level) - ((1 << level) - 1)
                here = (node >= 0) & front.open[node]
                use, node = use[here], node[here]
                g, h, _ = _gradients(cell, score[use, c].astype(float), y[use], weight[use])
                g, h = np.rint(g * _SCALE), np.rint(h * _SCALE)
                small = front.small[node]
                if small.any():
                    sent.setdefault(c, []).append((node[small].astype(np.int32), bins[use[small]], g[small], h[small]))
                if not small.all():
                    large = ~small
                    key = ((node[large][:, None] * features + np.arange(features)) * width + bins[use[large]]).ravel()
                    if c not in sums:
                        sums[c] = np.zeros((2, (1 << level) * features * width))
                    for total, part in zip(sums[c], (g[large], h[large]), strict=True):
                        total += np.bincount(key, np.repeat(part, features), len(total))
        out = []
        for c in fronts:
            g, h = sums.get(c, np.zeros((2, 0)))
            at = np.flatnonzero(h)
            node, own, own_g, own_h = (np.concatenate(x).tobytes() for x in zip(*sent[c], strict=True)) if c in sent else (b"",) * 4
            out.append((c, at.astype(np.int64).tobytes(), g[at].tobytes(), h[at].tobytes(), node, own, own_g, own_h, losses[c, 0], losses[c, 1]))
        kinds = [pa.int32(), *[pa.binary()] * 7, pa.float64(), pa.float64()]
        yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=_PARTIAL_NAMES)

    return run


def best_splits(g: np.ndarray, h: np.ndarray, columns: np.ndarray, child_weight: float, alpha: float, penalty: float) -> list[tuple]:
    """(node, feature, cut, left g, left h, g, h) of each node with rows; feature -1 where no split gains.

    ``g`` and ``h`` are nodes x features x bins.  Of equal gains the first feature and cut win.
    """

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - alpha, 0.0) ** 2 / (h + penalty)

    nodes = np.flatnonzero(h[:, 0].sum(axis=1) > 0)
    left_g, left_h = np.cumsum(g[nodes], axis=2)[:, :, :-1], np.cumsum(h[nodes], axis=2)[:, :, :-1]
    all_g, all_h = g[nodes, 0].sum(axis=1), h[nodes, 0].sum(axis=1)
    right_g, right_h = all_g[:, None, None] - left_g, all_h[:, None, None] - left_h
    gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)[:, None, None]
    fits = (left_h >= child_weight) & (right_h >= child_weight) & (left_h > 0) & (right_h > 0) & columns[:, None]
    flat = np.where(fits, gain, -np.inf).reshape(len(nodes), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(nodes))
    won = flat[rows, best] > 1e-6
    feature, cut = np.divmod(best, left_g.shape[2])
    picked = [np.where(won, x.reshape(len(nodes), -1)[rows, best], 0.0) for x in (left_g, left_h)]
    return list(zip(nodes.tolist(), np.where(won, feature, -1).tolist(), np.where(won, cut, 0).tolist(), *(x.tolist() for x in (*picked, all_g, all_h)), strict=True))


def _subtrees(node: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, cell: Cell, level: int, columns: np.ndarray, how: Rounds) -> list[tuple]:
    """All splits below the level's nodes (numbered in the level) from their rows; nodes are numbered in the tree."""
    out, features = [], bins.shape[1]
    while level < cell.depth and len(node):
        shape = (1 << level, features, how.bins + 1)
        sums = np.zeros((2, *shape))
        for f in {0, *np.flatnonzero(columns).tolist()}:  # a node's total is that of the first feature
            key = node * shape[2] + bins[:, f]
            for total, x in zip(sums, (g, h), strict=True):
                total[:, f] = np.bincount(key, x, shape[0] * shape[2]).reshape(shape[0], -1) / _SCALE
        found = best_splits(*sums, columns, cell.child_weight, cell.alpha, how.penalty)
        out += [(r[0] + (1 << level) - 1, *r[1:]) for r in found]
        feature, cut = np.full(1 << level, -1), np.zeros(1 << level, int)
        for r in found:
            feature[r[0]], cut[r[0]] = r[1], r[2]
        on = feature[node] >= 0
        node, bins, g, h = node[on], bins[on], g[on], h[on]
        node = 2 * node + (bins[np.arange(len(node)), feature[node]] > cut[node])
        level += 1
    return out


def _splitter(cells: Sequence[Cell], features: int, level: int, columns: np.ndarray, how: Rounds):
    """The parts of whole cells to one row a node, and one (node -1) with the held-out loss."""
    shape = (1 << level, features, how.bins + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        sent: dict[int, list[tuple]] = {}
        losses: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, g, h, node, bins, own_g, own_h, loss, weight in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                losses[c] = losses.get(c, 0) + np.array([loss, weight])
                if at:
                    held = sums.setdefault(c, np.zeros((2, int(np.prod(shape)))))
                    place = np.frombuffer(at, np.int64)
                    held[0, place] += np.frombuffer(g, np.float64)
                    held[1, place] += np.frombuffer(h, np.float64)
                if node:
                    sent.setdefault(c, []).append(
                        (np.frombuffer(node, np.int32).astype(np.int64), np.frombuffer(bins, np.uint8).reshape(-1, features), np.frombuffer(own_g), np.frombuffer(own_h)))
        rows = []
        for c, total in losses.items():
            rows.append((c, -1, 0, 0, 0.0, 0.0, *total))
            if c in sums:
                g, h = (x.reshape(shape) / _SCALE for x in sums[c])
                rows += [(c, r[0] + (1 << level) - 1, *r[1:]) for r in best_splits(g, h, columns, cells[c].child_weight, cells[c].alpha, how.penalty)]
            if c in sent:
                whole = (np.concatenate(x) for x in zip(*sent[c], strict=True))
                rows += [(c, *r) for r in _subtrees(*whole, cells[c], level, columns, how)]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 4
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in _SPLITS.split(", ")])

    return run


def _advance(rounds: Sequence[_Round], rate: float):
    """Rows with the scores after ``rounds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            score, kept = _replayed(_matrix(batch.column("bins"), np.uint8, n), _matrix(batch.column("score"), np.float32, n), _matrix(batch.column("kept"), np.float32, n), rounds, rate)
            held = [batch.column(c) for c in ("id", "fold", "draw", "w", "labels", "bins")]
            yield pa.record_batch([*held, *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (score, kept))], names=batch.schema.names)

    return run


def _scored(cells: Sequence[Cell], keep: np.ndarray, names: Sequence[str]):
    """Rows to one row for each cell that the row was not trained in."""
    held = np.array([c.held for c in cells])
    logistic = np.array([c.loss == "logistic" for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            best = np.where(keep, _matrix(batch.column("score"), np.float32, n), _matrix(batch.column("kept"), np.float32, n)).astype(float)
            p = np.where(logistic, 1.0 / (1.0 + np.exp(-best)), best)
            fold = batch.column("fold").to_numpy()
            row, cell = np.nonzero((fold[:, None] == held) | (fold[:, None] < 0))
            take = pa.array(row)
            yield pa.record_batch([*(batch.column(c).take(take) for c in names), pa.array(cell.astype(np.int32)), pa.array(p[row, cell])], names=[*names, "cell", "p"])

    return run


def _replace(df: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    """Writes ``df`` and deletes the table it was made from."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    if old:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(df.schema).parquet(path), path


def _leaf(g: float, h: float, cell: Cell, how: Rounds) -> float:
    return math.copysign(max(abs(g) - cell.alpha, 0.0), -g) / (h + how.penalty)


def _columns(features: int, step: int, how: Rounds) -> np.ndarray:
    """The features that a round may split."""
    picks = _uniform(np.arange(features, dtype=np.int64), how.seed * 7919 + 2 * step + 1)
    columns = np.zeros(features, bool)
    columns[np.argsort(picks, kind="stable")[: max(1, round(how.column_share * features))]] = True
    return columns


def _bare(depth: int) -> _Tree:
    nodes = (2 << depth) - 1
    return _Tree(np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes))


def _plant(tree: _Tree, cell: Cell, how: Rounds, node: int, feature: int, cut: int, left_g: float, left_h: float, g: float, h: float) -> None:
    """Writes one found split, or leaf, into the tree."""
    tree.value[node] = _leaf(g, h, cell, how)
    if feature >= 0:
        tree.feature[node], tree.cut[node] = feature, cut
        tree.value[2 * node + 1] = _leaf(left_g, left_h, cell, how)
        tree.value[2 * node + 2] = _leaf(g - left_g, h - left_h, cell, how)


def _starts(rows: DataFrame, cells: Sequence[Cell], how: Rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature cuts, and of each cell its starting score and the rows that a round draws."""
    cuts = feature_cuts(rows, "features", how.bins)
    sums = rows.select("fold", "w", F.posexplode("labels").alias("label", "y")).where(~F.isnan("y")).groupBy("fold", "label").agg(
        F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"), F.count("*").alias("n")).collect()  # folds x labels rows
    base, sizes = np.zeros(len(cells)), np.zeros(len(cells))
    for c, cell in enumerate(cells):
        own = [r for r in sums if r["label"] == cell.label and r["fold"] >= 0 and r["fold"] != cell.held]
        sizes[c] = how.row_share * sum(r["n"] for r in own)
        mean = sum(r["wy"] for r in own) / max(sum(r["w"] for r in own), 1e-12)
        base[c] = mean if cell.loss == "squared" else np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))
    return cuts, base, sizes


def _encoded(rows: DataFrame, cuts: np.ndarray, base: np.ndarray) -> DataFrame:
    """Rows with bins; a small table would be one file, and every pass over it one task."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, fold int, draw bigint, w double, labels array<double>, bins binary, score binary, kept binary"
    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "id")
    return dealt.select("id", F.col("fold").cast("int").alias("fold"), F.xxhash64("id").alias("draw"), F.col("w").cast("double").alias("w"), "labels", "features").mapInArrow(
        _encoder(cuts, base), schema)


def _fit_alone(cell: Cell, bins: np.ndarray, fold: np.ndarray, draw: np.ndarray, w: np.ndarray, y: np.ndarray, base: float, how: Rounds) -> tuple[np.ndarray, int, float, list[float]]:
    """A cell from its first round to its last: scores of the best round, that round, its loss and all losses."""
    known = ~np.isnan(y)
    train, own = np.flatnonzero(known & (fold >= 0) & (fold != cell.held)), np.flatnonzero(known & (fold == cell.held))
    score = np.full(len(y), base, np.float32)
    kept, best, least, history = score, 0, np.inf, []
    drawn, x, y_train, w_train = draw[train], bins[train], y[train], w[train]
    for step in range(how.most + 1):
        if step:
            loss = float(_gradients(cell, score[own].astype(float), y[own], w[own])[2].sum() / max(w[own].sum(), 1e-12))
            history.append(loss)
            if loss < least:
                kept, best, least = score, step, loss
        if step == how.most or step and step - best >= how.patience:
            break
        use = np.flatnonzero(_uniform(drawn, how.seed * 7919 + 2 * step) < how.row_share)
        g, h, _ = _gradients(cell, score[train[use]].astype(float), y_train[use], w_train[use])
        found = _subtrees(np.zeros(len(use), np.int64), x[use], np.rint(g * _SCALE), np.rint(h * _SCALE), cell, 0, _columns(bins.shape[1], step, how), how)
        if not found:
            break
        tree = _bare(cell.depth)
        for r in found:
            _plant(tree, cell, how, *r)
        score = score + np.float32(how.rate) * tree.value[_place(bins, tree, cell.depth)].astype(np.float32)
    return kept, best, least, history


def _alone(cells: Sequence[Cell], base: np.ndarray, parts: int, how: Rounds, names: Sequence[str]):
    """All rows, in some part, to the predictions of the part's cells, and one row a cell with its losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bins, schema = [], [], None
        for batch in batches:
            if batch.num_rows:
                schema = batch.schema
                bins.append(_matrix(batch.column("bins"), np.uint8, batch.num_rows))
                held.append(batch.drop_columns(["bins"]))
        if not held:
            return
        table, x = pa.Table.from_batches(held).combine_chunks(), np.concatenate(bins)
        del held, bins
        fold, draw, w = (table.column(c).to_numpy() for c in ("fold", "draw", "w"))
        flat = table.column("labels").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        blank = {n: pa.nulls(1, schema.field(n).type) for n in names}
        for c in range(table.column("part")[0].as_py(), len(cells), parts):
            cell = cells[c]
            score, best, least, history = _fit_alone(cell, x, fold, draw, w, flat[:, cell.label], base[c], how)
            yield pa.record_batch(
                [*blank.values(), pa.array([c], pa.int32()), pa.array([least]), pa.array([best], pa.int32()), pa.array([history], pa.list_(pa.float64()))],
                names=[*names, "cell", "p", "round", "history"])
            rows = np.flatnonzero((fold == cell.held) | (fold < 0))
            for lo in range(0, len(rows), 1 << 16):
                part = rows[lo : lo + (1 << 16)]
                value = score[part].astype(float)
                p = 1.0 / (1.0 + np.exp(-value)) if cell.loss == "logistic" else value
                own = table.select(list(names)).take(pa.array(part)).combine_chunks()
                yield pa.record_batch(
                    [*(own.column(n).combine_chunks() for n in names), pa.array(np.full(len(part), c, np.int32)), pa.array(p), pa.nulls(len(part), pa.int32()),
                     pa.nulls(len(part), pa.list_(pa.float64()))], names=[*names, "cell", "p", "round", "history"])

    return run


def fit_cells(rows: DataFrame, cells: Sequence[Cell], how: Rounds = Rounds()) -> Fitted:  # noqa: B008
    """``fit``; a table of up to OWN_ROWS rows goes to the cells, some cells a task."""
    if rows.count() > OWN_ROWS:
        return fit(rows, cells, how)
    cuts, base, _ = _starts(rows, cells, how)
    names, ids = ["id", "fold", "w", "labels"], rows.schema["id"].dataType.simpleString()
    table = stage(_encoded(rows, cuts, np.zeros(0)).drop("score", "kept"))
    parts = max(1, min(len(cells), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    sent = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, F.col("part"))
    done = stage(sent.mapInArrow(_alone(cells, base, parts, how, names), f"id {ids}, fold int, w double, labels array<double>, cell int, p double, round int, history array<double>"))
    lines = {r["cell"]: r for r in done.where("history IS NOT NULL").select("cell", "p", "round", "history").collect()}  # one a cell
    order = [lines.get(c) for c in range(len(cells))]
    return Fitted(done.where("history IS NULL").drop("round", "history"), [r["round"] if r else 0 for r in order],
                  [r["p"] if r else math.inf for r in order], [list(r["history"]) if r else [] for r in order])


def fit(rows: DataFrame, cells: Sequence[Cell], how: Rounds = Rounds()) -> Fitted:  # noqa: B008
    """Fits every cell to its own best round.

    ``rows`` has id, fold (int), w, labels (array<double>; NaN: unknown, the row is left out
    of the cells of that label) and features (array<double>).  Folds below 0 are trained on
    by no cell.  A row is scored by the cells that hold its fold out, and if its fold is
    below 0 by all: no prediction comes from a model that has seen the row.
    """
    spark = rows.sparkSession
    cuts, base, sizes = _starts(rows, cells, how)
    ids, names = rows.schema["id"].dataType.simpleString(), ["id", "fold", "w", "labels"]
    schema = f"id {ids}, fold int, draw bigint, w double, labels array<double>, bins binary, score binary, kept binary"
    table, path = _replace(_encoded(rows, cuts, base), None)
    parts = max(1, min(len(cells), int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
    fewest = lambda level, c: (_WIDE + 4) * max(LEAST_BINS, ((1 << (cells[c].depth - level)) - 1) * (how.bins + 1))
    every = WRITE_EVERY if all(sizes[c] <= fewest(0, c) for c in range(len(cells))) else 1
    rounds: list[_Round] = []
    losses, best, history = np.full(len(cells), np.inf), np.zeros(len(cells), int), [[] for _ in cells]
    active, keep = set(range(len(cells))), np.zeros(len(cells), bool)
    for step in range(how.most + 1):
        columns = _columns(len(cuts), step, how)
        trees = {c: _bare(cells[c].depth) for c in active}
        keep = np.zeros(len(cells), bool)
        fronts = {c: _Front(t, np.ones(1, bool), np.array([sizes[c] <= fewest(0, c)])) for c, t in trees.items()}
        rows_of = {c: np.array([sizes[c]]) for c in fronts}  # about as many rows are in each node
        level = 0
        while fronts:
            partial = table.select("fold", "draw", "w", "labels", "bins", "score").mapInArrow(
                _histograms(cells, fronts, level, how.seed * 7919 + 2 * step, how, rounds), _PARTIAL)
            found = partial.repartition(parts, "cell").mapInArrow(_splitter(cells, len(cuts), level, columns, how), _SPLITS).toArrow().to_pylist()
            first, ahead = (1 << level) - 1, {}
            for r in found:
                c, node = r["cell"], r["node"]
                if node < 0:
                    if level == 0 and step > 0:
                        loss = r["g"] / max(r["h"], 1e-12)
                        history[c].append(loss)
                        if loss < losses[c]:
                            losses[c], best[c], keep[c] = loss, step, True
                    continue
                tree = trees[c]
                _plant(tree, cells[c], how, node, *(r[k] for k in ("feature", "cut", "left_g", "left_h", "g", "h")))
                if r["feature"] >= 0:
                    if node - first < 1 << level and not fronts[c].small[node - first]:
                        share = r["left_h"] / r["h"]
                        at = 2 * (node - first)
                        below = ahead.setdefault(c, np.zeros(2 << level))
                        below[at : at + 2] = np.array([share, 1 - share]) * rows_of[c][node - first]
            if level == 0:
                # a cell without training rows has no root, and nothing to grow
                rooted = {r["cell"] for r in found if r["node"] == 0}
                active = {c for c in active if c in rooted and step < how.most and (step == 0 or step - best[c] < how.patience)}
                trees = {c: t for c, t in trees.items() if c in active}
            level += 1
            rows_of = {c: n for c, n in ahead.items() if c in active and cells[c].depth > level}
            fronts = {c: _Front(trees[c], n > 0, n <= fewest(level, c)) for c, n in rows_of.items()}
        if active:
            rounds.append(_Round(trees, keep, max(cells[c].depth for c in trees)))
        if rounds and (len(rounds) >= every or not active):
            table, path = _replace(table.mapInArrow(_advance(rounds, how.rate), schema), path)
            rounds = []
        if not active:
            break
    predictions = table.mapInArrow(_scored(cells, keep, names), f"id {ids}, fold int, w double, labels array<double>, cell int, p double")
    return Fitted(predictions, [int(b) for b in best], [float(x) for x in losses], history)


def grid_cells(settings: Sequence[tuple[int, float, float]], held: Sequence[int], label: int = 0, loss: str = "squared") -> list[Cell]:
    """A cell for each (depth, child weight, alpha) and held-out fold, settings first."""
    return [Cell(h, d, w, a, label, loss) for d, w, a in settings for h in held]


def name_of(cell: Cell) -> str:
    return f"depth={cell.depth},child_weight={cell.child_weight:g},alpha={cell.alpha:g}"


def cross_validated(rows: DataFrame, settings: Sequence[tuple[int, float, float]], folds: Sequence[int], how: Rounds = Rounds()) -> DataFrame:  # noqa: B008
    """The whole grid: one row for each row and setting, predicted out of its fold.

    id, fold, y, w, config, p; ``rounds``: the median best round of the setting's folds;
    ``score``: the mean of its folds' weighted RMSE; ``best``: the setting of least score,
    the first one of equal scores.
    """
    cells = grid_cells(settings, folds)
    done = fit_cells(rows, cells, how)
    rmse = np.sqrt(np.array(done.losses)).reshape(len(settings), len(folds)).mean(axis=1)
    rounds = np.median(np.array(done.rounds).reshape(len(settings), len(folds)), axis=1)
    lookup = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(F.col("cell") / len(folds)).cast("int") + 1)
    return done.predictions.select(
        "id", "fold", F.col("labels")[0].alias("y"), "w", lookup([name_of(c) for c in cells[:: len(folds)]]).alias("config"), "p",
        lookup([float(r) for r in rounds]).alias("rounds"), lookup([float(s) for s in rmse]).alias("score"),
        lookup([i == int(np.argmin(rmse)) for i in range(len(settings))]).alias("best"))


def own_predictions(done: Fitted, cells: Sequence[Cell], label: int, final: int = -1) -> DataFrame:
    """id, p of one label: out of fold for folds from 0 on, by the cell that holds ``final`` out for the others."""
    held = F.element_at(F.array(*[F.lit(c.held) for c in cells]), F.col("cell") + 1)
    of = F.element_at(F.array(*[F.lit(c.label) for c in cells]), F.col("cell") + 1)
    return done.predictions.where((of == label) & (held == F.greatest("fold", F.lit(final)))).select("id", "p")


@dataclass
class Stacked:
    """``scores``: mean out-of-fold loss of each setting; ``predictions``: id, fold, y, w, covered, base, p."""

    scores: dict[str, float]
    best: str
    rounds: int
    predictions: DataFrame


def stack(
    rows: DataFrame, first: tuple[int, float, float], settings: Sequence[tuple[int, float, float]], folds: Sequence[int],
    base: Rounds = Rounds(), top: Rounds = Rounds(),  # noqa: B008
) -> Stacked:
    """A classifier over the predictions of a regression and of a classification.

    ``rows`` has id, fold, w, features and labels [value, class]; a value may be NaN, and
    its row then has the mean value for a prediction (``covered`` is false).  Folds from 0
    on are trained on, fold -1 stops the final models, fold -2 is only scored.

    Level 0 fits both models once a fold and once for the rows outside the folds, all in one
    batch.  A row of a fold has the predictions of the models that did not see that fold,
    and level 1 holds the same folds out, so no row is part of a model that feeds it or
    judges it.
    """
    held = [*folds, -1]
    cells = [*grid_cells([first], held, 0, "squared"), *grid_cells([first], held, 1, "logistic")]
    done = fit_cells(rows, cells, base)
    value, chance = own_predictions(done, cells, 0), own_predictions(done, cells, 1)
    known = ~F.isnan(F.col("labels")[0])
    mean = rows.where((F.col("fold") >= 0) & known).agg(F.avg(F.col("labels")[0]).alias("m")).first()["m"] or 0.0
    fed = stage(rows.select("id", "fold", "w", F.col("labels")[1].alias("y"), known.alias("covered"))
                .join(value.withColumnsRenamed({"p": "value"}), "id").join(chance.withColumnsRenamed({"p": "base"}), "id"))
    level = fed.select("id", "fold", "w", F.array("y").alias("labels"), F.array(F.when(F.col("covered"), F.col("value")).otherwise(mean), "base").alias("features"))
    top_cells = grid_cells(settings, held, 0, "logistic")
    over = fit_cells(level, top_cells, top)
    found = over.predictions.withColumn("config", F.floor(F.col("cell") / len(held)).cast("int"))
    auc = weighted_auc(stage(found.where("fold >= 0").select("config", "fold", F.col("labels")[0].alias("y"), "p", "w")), ["config", "fold"], "y", "p", "w")
    mean_auc = {r["config"]: r["a"] for r in auc.groupBy("config").agg(F.avg("roc_auc").alias("a")).collect()}  # one row a setting
    win = min(mean_auc, key=lambda c: (-mean_auc[c], c))
    names = [name_of(c) for c in top_cells[:: len(held)]]
    own = own_predictions(Fitted(over.predictions.where(F.floor(F.col("cell") / len(held)) == win), over.rounds, over.losses), top_cells, 0)
    return Stacked({names[c]: a for c, a in sorted(mean_auc.items())}, names[win], over.rounds[win * len(held) + len(folds)],
                   fed.drop("value").join(own, "id"))
