"""Shared-embedding draft models: nested folds, fits of a whole grid at once, selection, scoring.

A draft's score is an intercept, main effects of its ten slots, products of ally
embeddings within sides, and attack-defence products across lanes. Every cell (fold
and configuration) has its own parameters, and all cells step together: a pass over
the drafts, which no cell copies, gives each cell's loss and gradient as sums over
partitions. A draft trains the cells whose training interval it lies in, so folds
are comparisons of one number, not copies of rows.

Parameters are bounded by roles, champions, dimensions and cells, not by drafts;
they alone pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallypoint.functions.formulas import POSITIONS
from rallypoint.operators.drafts import SLOTS, slots
from rallypoint.sources.stages import stage

SUPPORT = 10
#: Losses that differ by no more than this tie.
TIE = 1e-12
#: Beyond so many partitions, a cell's sums are added up by several tasks before one adds these up.
DIRECT_PARTITIONS = 64


@dataclass(frozen=True)
class Config:
    config_id: str
    main_l2: float
    embedding_l2: float
    synergy_dimension: int
    counter_dimension: int


@dataclass(frozen=True)
class Cell:
    """A fit: trains on drafts placed before start, validates on those from start to end."""

    fold: str
    inner: int | None
    config: Config
    start: int
    end: int

    @property
    def scope(self) -> str:
        return f"{self.fold}|{'refit' if self.inner is None else f'inner-{self.inner}'}"


# Nested folds


def nested_windows(outer: list[tuple[str, int, int]], inner: int, length: int) -> list[tuple[str, int | None, int, int]]:
    """fold, inner (None: the outer fold itself), start, end: `inner` windows of this length before each outer start."""
    out: list[tuple[str, int | None, int, int]] = []
    for name, start, end in outer:
        out += [(name, i, start - (inner - i) * length, start - (inner - i - 1) * length) for i in range(inner)]
        out.append((name, None, start, end))
    return out


def nested_folds(rows: DataFrame, place: str, windows: list[tuple[str, int | None, int, int]], least: int, least_per_platform: int, platform: str = "platform") -> DataFrame:
    """fold, inner, training, validation, fewest (training rows of the rarest platform), accepted.

    A fold is accepted if it has enough training rows, in all and of each platform
    that occurs at all, and validation rows. Each row meets the windows in which it
    has a part, and is counted there; platforms are those of all rows.
    """
    array = F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(i).cast("int").alias("inner"), F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for f, i, a, b in windows))
    met = rows.select(F.col(place).alias("at"), F.col(platform).alias("of"), F.explode(array).alias("w")).select("at", "of", "w.*")
    counted = met.groupBy("fold", "inner", "of").agg(F.count_if(F.col("at") < F.col("start")).alias("training"), F.count_if((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).alias("validation"))
    out = counted.groupBy("fold", "inner").agg(F.sum("training").alias("training"), F.sum("validation").alias("validation"), F.min("training").alias("fewest"))
    return out.withColumn("accepted", (F.col("training") >= least) & (F.col("fewest") >= least_per_platform) & (F.col("validation") > 0))


def cells_of(accepted: list[tuple[str, int | None]], windows: list[tuple[str, int | None, int, int]], configs: list[Config]) -> list[Cell]:
    """The inner cells of every accepted fold and configuration."""
    known = set(accepted)
    return [Cell(f, i, c, a, b) for f, i, a, b in windows if i is not None and (f, i) in known and (f, None) in known for c in configs]


# Drafts in code


def coded(drafts: DataFrame, place: Column) -> tuple[DataFrame, DataFrame]:
    """Staged rows match_id, at, outcome, c (the ten slots' feature numbers, blue first), and the features role, champion, number.

    Features are numbered in key order over all drafts; a cell that never trains on
    one leaves it at zero.
    """
    long = slots(drafts)
    keys = long.select("role", "champion").distinct()
    order = sorted((POSITIONS.index(r.role), r.champion, r.role) for r in keys.collect())
    known = drafts.sparkSession.createDataFrame([(role, champion, i) for i, (_, champion, role) in enumerate(order)], "role string, champion int, number int")
    index = {p: pd.Index([champion for _, champion, role in order if role == p]) for p in POSITIONS}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _numbers(batch, index, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 10 * len(batch) + 1, 10), pa.int32()), pa.array(c.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("match_id", "at", "outcome")), lists], ["match_id", "at", "outcome", "c"])

    placed = drafts.select("match_id", place.cast("bigint").alias("at"), F.col("outcome").cast("int").alias("outcome"), *SLOTS).dropna(subset=SLOTS)
    return stage(placed.mapInArrow(numbered, f"match_id {dict(drafts.dtypes)['match_id']}, at bigint, outcome int, c array<int>"), "coded-drafts"), known


def _numbers(batch: pa.RecordBatch, known: dict[str, pd.Index], unknown: int) -> np.ndarray:
    """The ten slots' feature numbers, blue first; numbers run through the roles in order."""
    c = np.stack([known[s.split("_")[1].upper()].get_indexer(batch.column(s).to_pandas()) for s in SLOTS], 1)
    first = np.cumsum([0, *(len(known[r]) for r in POSITIONS)])[:5]
    return np.where(c < 0, unknown, c + np.tile(first, 2))


def supports(rows: DataFrame, starts: list[int]) -> dict[int, dict[int, int]]:
    """By start: how many training drafts have each feature on one side alone."""
    one = rows.select("at", F.explode(F.array_except(F.array_union(F.slice("c", 1, 5), F.slice("c", 6, 5)), F.array_intersect(F.slice("c", 1, 5), F.slice("c", 6, 5)))).alias("number"))
    met = one.select("number", F.explode(F.filter(F.array(*(F.lit(s).cast("bigint") for s in sorted(set(starts)))), lambda s: F.col("at") < s)).alias("start"))
    out: dict[int, dict[int, int]] = {s: {} for s in starts}
    for r in met.groupBy("start", "number").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.start][r.number] = r.n
    return out


# The model


@dataclass
class Layout:
    """Where a cell's parameters lie in one vector: intercept, main effects, synergy, attack, defence."""

    features: int
    synergy: int
    counter: int

    @property
    def size(self) -> int:
        return 1 + self.features * (1 + self.synergy + 2 * self.counter)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, s, c = self.features, self.synergy, self.counter
        at = np.cumsum([0, 1, n, n * s, n * c, n * c])
        b, w, e, a, d = (x[i:j] for i, j in zip(at, at[1:], strict=False))
        return b, w, e.reshape(n, s), a.reshape(n, c), d.reshape(n, c)


_SIGN = np.repeat([1.0, -1.0], 5)


def scores(x: np.ndarray, layout: Layout, c: np.ndarray) -> np.ndarray:
    """Scores of drafts c (n by ten feature numbers); unsupported embeddings must be zero in x."""
    b, w, e, a, d = layout.split(x)
    out = b[0] + w[c] @ _SIGN
    if layout.synergy:
        held = e[c]
        for at, sign in ((slice(0, 5), 1), (slice(5, 10), -1)):
            side = held[:, at]
            out += sign * ((side.sum(1) ** 2).sum(1) - (side**2).sum((1, 2))) / 2
    if layout.counter:
        out += (a[c[:, :5]] * d[c[:, 5:]] - a[c[:, 5:]] * d[c[:, :5]]).sum((1, 2))
    return out


def loss_and_gradient(x: np.ndarray, layout: Layout, c: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over drafts of the log loss, and its gradient."""
    z = scores(x, layout, c)
    off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
    gradient = np.zeros_like(x)
    gb, gw, ge, ga, gd = layout.split(gradient)
    _, _, e, a, d = layout.split(x)
    gb[0] = off.sum()
    signed = off[:, None] * _SIGN
    gw += np.bincount(c.ravel(), signed.ravel(), layout.features)

    def add(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        for k in range(to.shape[1]):
            to[:, k] += np.bincount(at.ravel(), values[..., k].ravel(), layout.features)

    if layout.synergy:
        held = e[c]
        rest = np.concatenate([held[:, :5].sum(1, keepdims=True) - held[:, :5], held[:, 5:].sum(1, keepdims=True) - held[:, 5:]], 1)
        add(ge, c, signed[..., None] * rest)
    if layout.counter:
        other = np.concatenate([c[:, 5:], c[:, :5]], 1)
        add(ga, c, signed[..., None] * d[other])
        add(gd, other, signed[..., None] * a[c])
    return float((np.logaddexp(0, z) - y * z).sum()), gradient


@dataclass
class Problem:
    """What tasks need of a cell: its interval, shape and which features have embeddings."""

    start: int
    end: int
    layout: Layout
    supported: np.ndarray

    def clean(self, x: np.ndarray) -> np.ndarray:
        """x with unsupported embeddings at zero."""
        out = x.copy()
        for part in self.layout.split(out)[2:]:
            part[~self.supported] = 0
        return out


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("at").to_numpy(), batch.column("outcome").to_numpy().astype(float), batch.column("c").flatten().to_numpy().reshape(-1, 10)


def sum_cells(batches: Iterator[pa.RecordBatch], problems: dict[int, Problem], points: dict[int, np.ndarray], training: bool) -> Iterator[pa.RecordBatch]:
    """cell, n, loss, gradient (training) of this task's drafts."""
    n = dict.fromkeys(points, 0)
    loss = dict.fromkeys(points, 0.0)
    gradients = {k: np.zeros_like(x) for k, x in points.items()}
    for batch in batches:
        at, y, c = _matrix(batch)
        for k, x in points.items():
            p = problems[k]
            own = at < p.start if training else (at >= p.start) & (at < p.end)
            if not own.any():
                continue
            n[k] += int(own.sum())
            if training:
                value, gradient = loss_and_gradient(x, p.layout, c[own], y[own])
                gradients[k] += gradient
            else:
                z = scores(x, p.layout, c[own])
                value = float((np.logaddexp(0, z) - y[own] * z).sum())
            loss[k] += value
    yield pa.RecordBatch.from_pydict({
        "cell": pa.array(list(points), pa.int32()), "n": pa.array(list(n.values()), pa.int64()), "loss": pa.array(list(loss.values()), pa.float64()),
        "gradient": pa.array([g if training else [] for g in gradients.values()], pa.list_(pa.float64())),
    })


def summed(rows: DataFrame, partitions: int, problems: dict[int, Problem], points: dict[int, np.ndarray], training: bool) -> dict[int, tuple[int, float, np.ndarray]]:
    """n, loss and gradient of each cell over all partitions; the driver gets one row a cell, however many partitions there are."""
    kind = "cell int, n bigint, loss double, gradient array<double>"
    found = rows.mapInArrow(lambda batches: sum_cells(batches, problems, points, training), kind)
    if partitions > DIRECT_PARTITIONS:
        lane = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(partitions)))
        found = found.withColumn("lane", lane).groupBy("cell", "lane").applyInArrow(_add_up, kind)
    if partitions > 1:
        found = found.groupBy("cell").applyInArrow(_add_up, kind)
    out: dict[int, tuple[int, float, np.ndarray]] = {k: (0, 0.0, np.zeros_like(x)) for k, x in points.items()}
    for r in sorted(found.collect(), key=lambda r: (r.cell, r.n, r.loss)):
        n, loss, gradient = out[r.cell]
        out[r.cell] = (n + r.n, loss + r.loss, gradient + np.array(r.gradient) if training else gradient)
    return out


def _add_up(table: pa.Table) -> pa.Table:
    """One row of the sums of a cell's rows, in an order that doesn't depend on how they arrived."""
    table = table.sort_by([("n", "ascending"), ("loss", "ascending")])
    gradients = table.column("gradient").combine_chunks()
    whole = gradients.flatten().to_numpy().reshape(len(table), -1).sum(0)
    return pa.table({
        "cell": table.column("cell").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
        "loss": pa.array([math.fsum(table.column("loss").to_pylist())]), "gradient": pa.array([whole], pa.list_(pa.float64())),
    })


def minimise(evaluate: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], starts: dict[int, np.ndarray], most: int, tolerance: float, memory: int = 10) -> dict[int, tuple[np.ndarray, int, bool]]:
    """Limited-memory quasi-Newton steps of many problems at once: point, steps and whether it settled, by problem.

    Each evaluation serves all problems that are still on their way. A problem has
    settled when a step gains less than tolerance, relatively, or its gradient's
    largest part is below it.
    """
    x = dict(starts)
    now = evaluate(x)
    past: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in x}
    steps, settled = dict.fromkeys(x, 0), {k: bool(np.abs(now[k][1]).max() <= tolerance) for k in x}
    on = {k for k in x if not settled[k]}
    while on:
        way = {k: _direction(now[k][1], past[k]) for k in on}
        size = {k: 1.0 if past[k] else min(1.0, 1 / np.abs(now[k][1]).sum()) for k in on}
        wanted = set(on)
        for _ in range(40):
            tried = evaluate({k: x[k] + size[k] * way[k] for k in wanted})
            for k, (loss, gradient) in tried.items():
                slope = float(now[k][1] @ way[k])
                if not loss <= now[k][0] + 1e-4 * size[k] * slope:
                    size[k] /= 2
                    continue
                wanted.discard(k)
                move, turn = size[k] * way[k], gradient - now[k][1]
                if move @ turn > 1e-12 * (turn @ turn):
                    past[k] = [*past[k], (move, turn)][-memory:]
                gain = (now[k][0] - loss) / max(abs(now[k][0]), abs(loss), 1.0)
                x[k], now[k] = x[k] + move, (loss, gradient)
                steps[k] += 1
                settled[k] = bool(gain <= tolerance or np.abs(gradient).max() <= tolerance)
            if not wanted:
                break
        on = {k for k in on - wanted if not settled[k] and steps[k] < most}
    return {k: (x[k], steps[k], settled[k]) for k in x}


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, weights = -gradient, []
    for move, turn in reversed(past):
        weights.append(move @ q / (move @ turn))
        q = q - weights[-1] * turn
    if past:
        move, turn = past[-1]
        q = q * (move @ turn / (turn @ turn))
    for (move, turn), weight in zip(past, reversed(weights), strict=True):
        q = q + move * (weight - turn @ q / (move @ turn))
    return q if q @ gradient < 0 else -gradient


def first_point(problem: Problem, cell: Cell, seed: int, rate: float) -> np.ndarray:
    """Intercept at the training rate's logit, main effects zero, embeddings normal with deviation 0.01 by a hash of seed, configuration and scope."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{cell.config.config_id}|{cell.scope}".encode()).digest()[:8], "big"))
    x = rng.normal(0, 0.01, problem.layout.size)
    x[1 : 1 + problem.layout.features] = 0
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    x[0] = math.log(rate / (1 - rate))
    return problem.clean(x)


def fit_cells(rows: DataFrame, features: int, cells: list[Cell], seed: int, support: int = SUPPORT, most: int = 200, tolerance: float = 1e-8) -> tuple[dict[int, Problem], dict[int, tuple[np.ndarray, int, bool]]]:
    """Fits all cells side by side; problems and, by cell number, parameters, steps and whether the fit settled.

    The loss is the mean over a cell's training drafts plus half of l2 times the
    squared parameters; the intercept has no penalty.
    """
    if not cells:
        return {}, {}
    partitions = rows.rdd.getNumPartitions()
    held = supports(rows, [c.start for c in cells])
    problems = {}
    for k, c in enumerate(cells):
        supported = np.array([held[c.start].get(i, 0) >= support for i in range(features)], bool)
        problems[k] = Problem(c.start, c.end, Layout(features, c.config.synergy_dimension, c.config.counter_dimension), supported)
    starts = sorted({c.start for c in cells})
    rates = rows.agg(*(F.avg(F.when(F.col("at") < s, F.col("outcome"))).alias(f"s{i}") for i, s in enumerate(starts)), F.lit(0)).first()
    rate = {s: rates[i] if rates[i] is not None else 0.5 for i, s in enumerate(starts)}

    def penalty(k: int) -> np.ndarray:
        layout, config = problems[k].layout, cells[k].config
        out = np.full(layout.size, config.embedding_l2)
        out[0], out[1 : 1 + layout.features] = 0, config.main_l2
        return out

    penalties = {k: penalty(k) for k in problems}

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        out = {}
        for k, (n, loss, gradient) in summed(rows, partitions, {k: problems[k] for k in points}, points, True).items():
            x, l2 = points[k], penalties[k]
            out[k] = (loss / max(n, 1) + 0.5 * float(l2 @ x**2), problems[k].clean(gradient / max(n, 1) + l2 * x))
        return out

    begin = {k: first_point(problems[k], c, seed, rate[c.start]) for k, c in enumerate(cells)}
    return problems, minimise(evaluate, begin, most, tolerance)


def validation_losses(rows: DataFrame, problems: dict[int, Problem], fitted: dict[int, tuple[np.ndarray, int, bool]]) -> dict[int, tuple[int, float | None]]:
    """Validation drafts of each cell, and their mean log loss."""
    if not fitted:
        return {}
    found = summed(rows, rows.rdd.getNumPartitions(), problems, {k: x for k, (x, _, _) in fitted.items()}, False)
    return {k: (n, loss / n if n else None) for k, (n, loss, _) in found.items()}


def select(cells: list[Cell], losses: dict[int, tuple[int, float | None]]) -> list[tuple[str, Config, float, int, bool]]:
    """fold, configuration, mean inner loss, inner folds, selected: the least loss; ties go to the most embedding
    penalty, then main penalty, then fewest dimensions, then id."""
    by: dict[str, dict[Config, list[float]]] = {}
    for k, c in enumerate(cells):
        if (loss := losses[k][1]) is not None:
            by.setdefault(c.fold, {}).setdefault(c.config, []).append(loss)
    out = []
    for fold, found in by.items():
        means = {c: math.fsum(v) / len(v) for c, v in found.items()}
        tied = [c for c, m in means.items() if m - min(means.values()) <= TIE]
        best = min(tied, key=lambda c: (-c.embedding_l2, -c.main_l2, c.synergy_dimension + c.counter_dimension, c.config_id))
        out += [(fold, c, m, len(found[c]), c == best) for c, m in means.items()]
    return out


def parameters(known: DataFrame, cells: list[Cell], problems: dict[int, Problem], fitted: dict[int, tuple[np.ndarray, int, bool]]) -> DataFrame:
    """fold, config_id, role, champion, main, supported, synergy, attack, defence, intercept; unsupported embeddings are zero vectors."""
    names = sorted(((r.number, r.role, r.champion) for r in known.collect()))
    rows = []
    for k, (x, _, _) in fitted.items():
        b, w, e, a, d = problems[k].layout.split(x)
        rows += [(cells[k].fold, cells[k].config.config_id, role, champion, float(w[i]), bool(problems[k].supported[i]), e[i].tolist(), a[i].tolist(), d[i].tolist(), float(b[0])) for i, role, champion in names]
    return known.sparkSession.createDataFrame(rows, "fold string, config_id string, role string, champion int, main double, supported boolean, synergy array<double>, attack array<double>, defence array<double>, intercept double")


def _scored(batches: Iterator[pa.RecordBatch], models: list[tuple[str, str, np.ndarray, Layout, dict[str, pd.Index]]]) -> Iterator[pa.RecordBatch]:
    """match_id, outcome, fold, config_id, probability of each draft under each model."""
    for batch in batches:
        for fold, config_id, x, layout, known in models:
            # Unknown slots have the last number, whose parameters are zero.
            c = _numbers(batch, known, layout.features - 1)
            z = scores(x, layout, c)
            p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
            n = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("match_id"), batch.column("outcome"), pa.array([fold] * n, pa.string()), pa.array([config_id] * n, pa.string()), pa.array(p)], ["match_id", "outcome", "fold", "config_id", "probability"])


def score(drafts: DataFrame, table: DataFrame) -> DataFrame:
    """match_id, outcome, fold, config_id, probability of drafts under every model of a parameters table.

    A slot that a model doesn't know counts nothing: its vectors are zero. The table
    is bounded by roles, champions and models and travels to the tasks; drafts
    aren't shuffled.
    """
    by: dict[tuple[str, str], list] = {}
    for r in table.collect():
        by.setdefault((r.fold, r.config_id), []).append(r)
    models = []
    for (fold, config_id), rows in sorted(by.items()):
        rows.sort(key=lambda r: (POSITIONS.index(r.role), r.champion))
        layout = Layout(len(rows) + 1, max(len(r.synergy) for r in rows), max(len(r.attack) for r in rows))
        x = np.zeros(layout.size)
        b, w, e, a, d = layout.split(x)
        b[0] = rows[0].intercept
        for i, r in enumerate(rows):
            w[i], e[i], a[i], d[i] = r.main, r.synergy, r.attack, r.defence
        models.append((fold, config_id, x, layout, {p: pd.Index([r.champion for r in rows if r.role == p]) for p in POSITIONS}))
    kinds = dict(drafts.dtypes)
    return drafts.select("match_id", "outcome", *SLOTS).mapInArrow(lambda batches: _scored(batches, models), f"match_id {kinds['match_id']}, outcome {kinds['outcome']}, fold string, config_id string, probability double")


@dataclass
class Nested:
    """selection: fold, config_id, mean_inner_loss, inner_folds, selected; parameters of the refits; fits: what each cell took."""

    selection: DataFrame
    parameters: DataFrame
    fits: DataFrame
    refits: list[Cell]


def nested_selection(rows: DataFrame, known: DataFrame, windows: list[tuple[str, int | None, int, int]], accepted: list[tuple[str, int | None]], configs: list[Config], seed: int, support: int = SUPPORT, most: int = 200) -> Nested:
    """Selects a configuration on each outer fold's inner folds and refits it on the outer training drafts."""
    spark, features = rows.sparkSession, known.count()
    cells = cells_of(accepted, windows, configs)
    problems, fitted = fit_cells(rows, features, cells, seed, support, most)
    losses = validation_losses(rows, problems, fitted)
    chosen = select(cells, losses)
    outer = {f: (a, b) for f, i, a, b in windows if i is None}
    refits = [Cell(f, None, c, *outer[f]) for f, c, _, _, best in chosen if best]
    again, final = fit_cells(rows, features, refits, seed, support, most)
    found = validation_losses(rows, again, final)
    took = [(c.fold, c.inner, c.config.config_id, losses[k][0], losses[k][1], fitted[k][1], fitted[k][2]) for k, c in enumerate(cells)]
    took += [(c.fold, None, c.config.config_id, found[k][0], found[k][1], final[k][1], final[k][2]) for k, c in enumerate(refits)]
    return Nested(
        spark.createDataFrame([(f, c.config_id, m, n, best) for f, c, m, n, best in chosen], "fold string, config_id string, mean_inner_loss double, inner_folds int, selected boolean"),
        parameters(known, refits, again, final),
        spark.createDataFrame(took, "fold string, inner int, config_id string, validation bigint, loss double, steps int, settled boolean"),
        refits,
    )
