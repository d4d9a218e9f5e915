"""Batched boosting against a plain version that fits one cell, row by row."""

import numpy as np
import pytest

from tidegauge.operators import boosting as B


def data(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(1)
    x[rng.random(n) < 0.1, 2] = np.nan
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=n) * 0.4
    c = (y + rng.normal(size=n) > 0).astype(float)
    fold = rng.integers(-2, 4, n)
    return [(i, int(fold[i]), float(1 + i % 3), [float(y[i]), float(c[i])], [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]


SCHEMA = "id bigint, fold int, w double, labels array<double>, features array<double>"


def plain(rows, draws, cell, how):
    """p of every row at the best round, and that round."""
    x = np.array([[np.nan if v is None else v for v in r[4]] for r in rows])
    y, w, fold = np.array([r[3][cell.label] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    bins = np.zeros(x.shape, int)
    for f in range(x.shape[1]):
        seen = ~np.isnan(x[:, f])
        cuts = np.quantile(x[seen, f], np.arange(1, how.bins) / how.bins)
        bins[seen, f] = 1 + np.searchsorted(cuts, x[seen, f], side="left")
    train, held = (fold >= 0) & (fold != cell.held), fold == cell.held
    mean = np.average(y[train], weights=w[train])
    score = np.full(len(y), mean if cell.loss == "squared" else np.log(mean / (1 - mean)), np.float32)
    best, kept, least = 0, score, np.inf

    def gain_of(g, h):
        return max(abs(g) - cell.alpha, 0) ** 2 / (h + how.penalty)

    def grow(use, g, h, columns, depth):
        if depth < cell.depth:
            won = (1e-6, None)
            for f in np.flatnonzero(columns):
                for cut in range(how.bins):
                    left = use[bins[use, f] <= cut]
                    right = use[bins[use, f] > cut]
                    if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= cell.child_weight:
                        gain = gain_of(g[left].sum(), h[left].sum()) + gain_of(g[right].sum(), h[right].sum()) - gain_of(g[use].sum(), h[use].sum())
                        if gain > won[0]:
                            won = (gain, (f, cut, left, right))
            if won[1]:
                f, cut, left, right = won[1]
                return f, cut, grow(left, g, h, columns, depth + 1), grow(right, g, h, columns, depth + 1)
        total = g[use].sum()
        return -np.sign(total) * max(abs(total) - cell.alpha, 0) / (h[use].sum() + how.penalty)

    def value(tree, b):
        while isinstance(tree, tuple):
            tree = tree[2] if b[tree[0]] <= tree[1] else tree[3]
        return tree

    for step in range(how.most):
        taken = B._uniform(draws, how.seed * 7919 + 2 * step) < how.row_share
        picks = B._uniform(np.arange(x.shape[1], dtype=np.int64), how.seed * 7919 + 2 * step + 1)
        columns = np.zeros(x.shape[1], bool)
        columns[np.argsort(picks, kind="stable")[: max(1, round(how.column_share * x.shape[1]))]] = True
        g, h, _ = B._gradients(cell, score.astype(float), y, w)
        g, h = np.rint(g * B._SCALE) / B._SCALE, np.rint(h * B._SCALE) / B._SCALE
        tree = grow(np.flatnonzero(train & taken), g, h, columns, 0)
        score = score + np.float32(how.rate) * np.array([value(tree, b) for b in bins], np.float32)
        loss = B._gradients(cell, score[held].astype(float), y[held], w[held])[2].sum() / w[held].sum()
        if loss < least:
            best, kept, least = step + 1, score, loss
        elif step + 1 - best >= how.patience:
            break
    return (kept if cell.loss == "squared" else 1 / (1 + np.exp(-kept.astype(float)))), best


@pytest.mark.parametrize("wide", [16, -4], ids=["rows", "histograms"])
def test_cells_are_single_fits(spark, monkeypatch, wide):
    """With -4 no node is small, so every level goes through histograms."""
    monkeypatch.setattr(B, "_WIDE", wide)
    rows = data()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    how = B.Rounds(most=6, patience=2, rate=0.6, bins=8)
    cells = [B.Cell(0, 2), B.Cell(3, 3, 5.0, 0.1), B.Cell(-1, 3, 1.0, 0.5), B.Cell(1, 2, 1.0, 0.0, 1, "logistic"), B.Cell(-1, 3, 2.0, 0.1, 1, "logistic")]
    done = B.fit(frame, cells, how)
    got = {(r.cell, r.id): r.p for r in done.predictions.collect()}
    from pyspark.sql import functions as F

    draws = {r.id: r.d for r in frame.select("id", F.xxhash64("id").alias("d")).collect()}
    keys = np.array([draws[r[0]] for r in rows])
    seen = set()
    for c, cell in enumerate(cells):
        p, best = plain(rows, keys, cell, how)
        assert done.rounds[c] == best
        for r, value in zip(rows, p, strict=True):
            if r[1] == cell.held or r[1] < 0:
                assert got[c, r[0]] == pytest.approx(value, abs=2e-5)
                seen.add((c, r[0]))
    assert set(got) == seen


def test_trees_do_not_depend_on_partitions(spark):
    rows = data(150, 4)
    how, cells = B.Rounds(most=3, bins=8), [B.Cell(0, 3), B.Cell(1, 2, 1.0, 0.1, 1, "logistic")]
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(n) for n in (1, 7)]
    a, b = ({(r.cell, r.id): r.p for r in B.fit(f, cells, how).predictions.collect()} for f in frames)
    assert a == b


def test_few_rows_make_one_job_a_round(spark, monkeypatch):
    """Scores were written after every round, and shallow trees took a job a level."""
    frame = spark.createDataFrame([r for i in range(12) for r in [(240 * i + r[0], *r[1:]) for r in data(240, i)]], SCHEMA)
    how, cells = B.Rounds(most=9, bins=8, rate=0.3), [B.Cell(0, 4), B.Cell(1, 3, 1.0, 0.1, 1, "logistic")]
    levels, writes, found = [], [], {}
    histograms, replace = B._histograms, B._replace
    monkeypatch.setattr(B, "_histograms", lambda *a: levels.append(a[2]) or histograms(*a))
    monkeypatch.setattr(B, "_replace", lambda *a: writes.append(a[1]) or replace(*a))
    for every in (8, 1):
        monkeypatch.setattr(B, "WRITE_EVERY", every)
        levels.clear(), writes.clear()
        done = B.fit(frame, cells, how)
        found[every] = ({(r.cell, r.id): r.p for r in done.predictions.collect()}, done.rounds, done.losses)
        assert set(levels) == {0} and len(levels) == 10 and len(writes) == (3 if every == 8 else 10)
    assert found[8][:2] == found[1][:2] and found[8][2] == pytest.approx(found[1][2])


def test_no_row_feeds_its_own_prediction(spark):
    """Labels of fold 2 move all predictions but those of fold 2 itself."""
    rows = data(160, 5)
    moved = [(i, f, w, [y[0] + (0.001 if f == 2 else 0.0), y[1]], x) for i, f, w, y, x in rows]
    how, cells = B.Rounds(most=3, bins=8), B.grid_cells([(2, 1.0, 0.0)], [0, 1, 2, 3, -1])
    first, second = (B.fit(spark.createDataFrame(r, SCHEMA), cells, how) for r in (rows, moved))
    assert first.rounds == second.rounds
    a, b = ({r.id: r.p for r in B.own_predictions(d, cells, 0).collect()} for d in (first, second))
    assert len(a) == len(rows)
    for i, fold, *_ in rows:
        assert (a[i] == b[i]) == (fold == 2)


def test_stack(spark):
    rows = [(i, f, w, [float("nan") if i % 5 == 0 else y[0], y[1]], x) for i, f, w, y, x in data(300, 6)]
    done = B.stack(spark.createDataFrame(rows, SCHEMA), (2, 1.0, 0.0), [(1, 1.0, 0.0), (2, 1.0, 0.1)], range(4),
                   B.Rounds(most=8, patience=4, rate=0.3, bins=8), B.Rounds(most=6, patience=3, rate=0.3, bins=8, column_share=1.0))
    found = done.predictions.collect()
    assert sorted(r.id for r in found) == list(range(300)) and len(done.scores) == 2
    assert all(r.covered == (r.id % 5 != 0) for r in found)
    assert max(done.scores.values()) > 0.75 and done.best in done.scores


def test_empty_folds_and_one_class(spark):
    rows = [(i, i % 2, 1.0, [1.0], [float(i)]) for i in range(20)]
    done = B.fit(spark.createDataFrame(rows, SCHEMA), [B.Cell(0, 2), B.Cell(5, 2)], B.Rounds(most=2, patience=1))
    assert {round(r.p, 6) for r in done.predictions.collect()} == {1.0}


def test_whole_cells_in_a_task_are_those_of_rounds(spark, monkeypatch):
    """A grid took a job a round, however few its rows were."""
    rows = [(i, f, w, [float("nan") if i % 7 == 0 else y[0], y[1]], x) for i, f, w, y, x in data(400, 8)]
    frame = spark.createDataFrame(rows, SCHEMA)
    how = B.Rounds(most=12, patience=3, rate=0.5, bins=8)
    cells = [B.Cell(0, 4), B.Cell(1, 3, 5.0, 0.1), B.Cell(-1, 2), B.Cell(2, 3, 1.0, 0.1, 1, "logistic"), B.Cell(9, 2)]
    jobs = []
    histograms = B._histograms
    monkeypatch.setattr(B, "_histograms", lambda *a: jobs.append(a[2]) or histograms(*a))
    found = {}
    for most in (B.OWN_ROWS, 399):
        monkeypatch.setattr(B, "OWN_ROWS", most)
        jobs.clear()
        done = B.fit_cells(frame, cells, how)
        found[most] = ({(r.cell, r.id): (r.fold, r.w, repr(r.labels), r.p) for r in done.predictions.collect()}, done.rounds)
        found[most, "losses"] = done.losses, [x for h in done.history for x in h]
        assert bool(jobs) == (most == 399)
    a, b = (found[k] for k in found if not isinstance(k, tuple))
    assert a == b and len(a[0]) == sum((f == c.held) + (f < 0 and f != c.held) for _, f, *_ in rows for c in cells)
    one, two = (found[k] for k in found if isinstance(k, tuple))
    assert one[0] == pytest.approx(two[0]) and one[1] == pytest.approx(two[1])
