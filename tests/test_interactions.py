"""The shared-embedding models against plain NumPy on one machine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallypoint.functions.formulas import POSITIONS
from rallypoint.operators import drafts, interactions
from rallypoint.operators.interactions import Cell, Config, Layout
from rallypoint.plans import studies

BOTH = Config("both", 0.01, 0.02, 2, 3)


def made(spark, n=400, champions=6, seed=5):
    rng = np.random.default_rng(seed)
    picks = rng.integers(1, champions + 1, (n, 10))
    strength = rng.normal(0, 1, champions + 1)
    z = strength[picks[:, :5]].sum(1) - strength[picks[:, 5:]].sum(1)
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(f"m{i:04d}", "ab"[i % 2], "26.15", i, int(y[i]), *map(int, picks[i])) for i in range(n)]
    return spark.createDataFrame(rows, "match_id string, platform string, public_patch string, at bigint, outcome int, " + ", ".join(f"{s} int" for s in drafts.SLOTS))


def plain_scores(x, layout, c, supported):
    """Score by score, slot by slot."""
    b, w, e, a, d = layout.split(x)
    out = []
    for row in c:
        z = b[0] + sum(w[i] for i in row[:5]) - sum(w[i] for i in row[5:])
        for side, sign in ((row[:5], 1), (row[5:], -1)):
            z += sign * sum(e[i] @ e[j] for k, i in enumerate(side) for j in side[k + 1 :] if supported[i] and supported[j])
        z += sum(a[i] @ d[j] - a[j] @ d[i] for i, j in zip(row[:5], row[5:]) if supported[i] and supported[j])
        out.append(z)
    return np.array(out)


@pytest.mark.parametrize("synergy,counter", [(0, 0), (2, 0), (0, 3), (2, 2)])
def test_gradient_by_differences(synergy, counter):
    rng = np.random.default_rng(7)
    layout, c, y = Layout(9, synergy, counter), rng.integers(0, 9, (40, 10)), rng.integers(0, 2, 40).astype(float)
    supported = np.arange(9) != 4
    x = interactions.Problem(0, 0, layout, supported).clean(rng.normal(0, 0.5, layout.size))
    assert np.allclose(interactions.scores(x, layout, c), plain_scores(x, layout, c, supported))
    _, gradient = interactions.loss_and_gradient(x, layout, c, y)
    for i in range(layout.size):
        up, down = x.copy(), x.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (interactions.loss_and_gradient(up, layout, c, y)[0] - interactions.loss_and_gradient(down, layout, c, y)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-4)


def test_fits_equal_single_machine_fits(spark):
    """Two folds and two configurations at once, over several partitions, against each alone in memory."""
    rows, known = interactions.coded(made(spark), F.col("at"))
    features = known.count()
    cells = [Cell("f", i, c, start, start + 50) for i, start in enumerate((200, 300)) for c in (BOTH, Config("main", 0.05, 0.0, 0, 0))]
    problems, fitted = interactions.fit_cells(rows.repartition(5), features, cells, 1, most=400, tolerance=1e-11)
    held = rows.orderBy("at").collect()
    c, y = np.array([r.c for r in held]), np.array([r.outcome for r in held], float)
    for k, cell in enumerate(cells):
        p, x = problems[k], fitted[k][0]
        l2 = np.full(p.layout.size, cell.config.embedding_l2)
        l2[0], l2[1 : 1 + features] = 0, cell.config.main_l2

        def one(points, p=p, cell=cell, l2=l2):
            out = {}
            for i, v in points.items():
                loss, gradient = interactions.loss_and_gradient(v, p.layout, c[: cell.start], y[: cell.start])
                out[i] = (loss / cell.start + 0.5 * l2 @ v**2, p.clean(gradient / cell.start + l2 * v))
            return out

        rate = y[: cell.start].mean()
        alone = interactions.minimise(one, {0: interactions.first_point(p, cell, 1, rate)}, 400, 1e-11)[0][0]
        assert one({0: x})[0][0] == pytest.approx(one({0: alone})[0][0], abs=1e-8)
        assert np.abs(one({0: x})[0][1]).max() < 1e-4 and fitted[k][2]
        counts = np.zeros(features, int)
        for row in c[: cell.start]:
            counts[[i for i in set(row) if (i in row[:5]) != (i in row[5:])]] += 1
        assert (p.supported == (counts >= interactions.SUPPORT)).all()
    losses = interactions.validation_losses(rows, problems, fitted)
    for k, cell in enumerate(cells):
        z = interactions.scores(fitted[k][0], problems[k].layout, c[cell.start : cell.end])
        t = y[cell.start : cell.end]
        assert losses[k] == (50, pytest.approx((np.logaddexp(0, z) - t * z).mean()))


def test_many_partitions_are_added_up_by_tasks(spark, monkeypatch):
    rows, known = interactions.coded(made(spark, 120), F.col("at"))
    cells = [Cell("f", 0, BOTH, 100, 120)]
    _, few = interactions.fit_cells(rows.repartition(3), known.count(), cells, 1, most=3)
    monkeypatch.setattr(interactions, "DIRECT_PARTITIONS", 4)
    _, many = interactions.fit_cells(rows.repartition(9), known.count(), cells, 1, most=3)
    assert np.allclose(few[0][0], many[0][0])


def test_scoring_by_joins_and_team_swap(spark):
    """Probabilities of the table equal the kernel's; with no intercept, swapped sides give the complement."""
    df = made(spark, 150, champions=40)
    rows, known = interactions.coded(df, F.col("at"))
    cells = [Cell("f", None, BOTH, 120, 150), Cell("g", None, Config("s", 0.01, 0.01, 2, 0), 100, 150)]
    problems, fitted = interactions.fit_cells(rows, known.count(), cells, 3, support=8, most=20)
    assert any((~p.supported).any() for p in problems.values())
    table = interactions.parameters(known, cells, problems, fitted)
    zero = table.where("NOT supported").first()
    assert zero is not None and not any(zero.synergy) and not any(zero.attack)
    got = {(r.match_id, r.fold): r.probability for r in interactions.score(df, table).collect()}
    assert len(got) == 300
    for r in rows.collect():
        for k, cell in enumerate(cells):
            z = plain_scores(fitted[k][0], problems[k].layout, np.array([r.c]), problems[k].supported)[0]
            assert got[r.match_id, cell.fold] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    flat = table.withColumn("intercept", F.lit(0.0))
    plain = {(r.match_id, r.fold): r.probability for r in interactions.score(df, flat).collect()}
    swapped = {(r.match_id, r.fold): r.probability for r in interactions.score(drafts.swap(df), flat).collect()}
    assert all(plain[k] + swapped[k] == pytest.approx(1, abs=1e-9) for k in plain)
    stranger = df.limit(1).select(*(F.lit(99).alias(c) if c in drafts.SLOTS else c for c in df.columns))
    assert interactions.score(stranger, flat).first().probability == pytest.approx(0.5)


def test_counter_orientation():
    """Attack of blue against defence of red counts for blue."""
    layout = Layout(2, 0, 1)
    x = np.zeros(layout.size)
    _, _, _, a, d = layout.split(x)
    a[0], d[1] = 1, 1
    c = np.array([[0] * 5 + [1] * 5, [1] * 5 + [0] * 5])
    assert interactions.scores(x, layout, c).tolist() == [5, -5]


def test_inner_windows_end_where_the_outer_starts():
    got = interactions.nested_windows([("a", 100, 120)], 3, 10)
    assert got == [("a", 0, 70, 80), ("a", 1, 80, 90), ("a", 2, 90, 100), ("a", None, 100, 120)]


def test_folds_need_their_minima(spark):
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", i) for i in range(85, 100)], "platform string, at bigint")
    got = {(r.fold, r.inner): r for r in interactions.nested_folds(rows, "at", [("x", None, 90, 95), ("y", None, 86, 90), ("z", None, 100, 110), ("w", 0, 10, 20)], 20, 3).collect()}
    assert (got["x", None].training, got["x", None].validation, got["x", None].fewest, got["x", None].accepted) == (95, 10, 5, True)
    assert not got["y", None].accepted and not got["z", None].accepted and not got["w", 0].accepted and got["w", 0].fewest == 0


def test_selection_equals_a_loop_over_folds(spark):
    df = made(spark, 300)
    rows, known = interactions.coded(df, F.col("at"))
    windows = interactions.nested_windows([("a", 200, 250), ("b", 250, 300)], 2, 30)
    accepted = [(f, i) for f, i, _, _ in windows]
    grid = [Config("main", 0.02, 0.02, 0, 0), BOTH]
    found = interactions.nested_selection(rows, known, windows, accepted, grid, 3, most=25)
    got = {(r.fold, r.config_id): r for r in found.selection.collect()}
    for fold in "ab":
        means = {}
        for config in grid:
            losses = []
            for f, i, start, end in windows:
                if f == fold and i is not None:
                    cell = [Cell(f, i, config, start, end)]
                    problems, fitted = interactions.fit_cells(rows, known.count(), cell, 3, most=25)
                    losses.append(interactions.validation_losses(rows, problems, fitted)[0][1])
            means[config.config_id] = sum(losses) / 2
            assert got[fold, config.config_id].mean_inner_loss == pytest.approx(means[config.config_id], abs=1e-5)
        assert got[fold, min(means, key=means.get)].selected
    assert {(c.fold, c.inner) for c in found.refits} == {("a", None), ("b", None)}
    assert {r.fold for r in found.parameters.select("fold").distinct().collect()} == {"a", "b"}


def test_ties_prefer_penalty_then_fewer_dimensions():
    configs = [Config("c", 0.1, 0.1, 2, 0), Config("b", 0.1, 0.1, 0, 0), Config("a", 0.1, 0.1, 0, 0), Config("d", 0.5, 0.1, 4, 4), Config("e", 0.5, 0.2, 4, 4)]

    def best(some):
        cells = [Cell("f", 0, c, 0, 1) for c in some]
        return next(c.config_id for _, c, _, _, chosen in interactions.select(cells, {k: (1, 0.5 + (1e-13 if k else 0)) for k in range(len(cells))}) if chosen)

    assert best(configs) == "e" and best(configs[:4]) == "d" and best(configs[:3]) == "a" and best(configs[:1]) == "c"
    worse = [Cell("f", 0, c, 0, 1) for c in configs]
    assert next(c.config_id for _, c, _, _, chosen in interactions.select(worse, {k: (1, 0.5 + (0.1 if k else 0)) for k in range(5)}) if chosen) == "c"


def test_queries_agree(spark, small):
    fits = studies.QUERIES["nested_fits"](spark, small).collect()
    chosen = {(r.fold, r.config_id) for r in studies.QUERIES["nested_selection"](spark, small).where("selected").collect()}
    refits = {(r.fold, r.config_id): r for r in fits if r.inner is None}
    assert set(refits) == chosen and chosen
    got = studies.QUERIES["interaction_probabilities"](spark, small).collect()
    for key, fit in refits.items():
        p = np.array([r.probability if r.outcome else 1 - r.probability for r in got if (r.fold, r.config_id) == key])
        assert len(p) == fit.validation and -np.log(p).mean() == pytest.approx(fit.loss, abs=1e-4)
    assert {r.role for r in studies.QUERIES["interaction_parameters"](spark, small).collect()} == set(POSITIONS)
