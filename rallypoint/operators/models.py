"""Penalised models, bootstraps and power: Spark ML, or NumPy on grouped small frames."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallypoint.functions.beta import beta_cdf, beta_survival, student_quantile
from rallypoint.functions.formulas import evidence_tier, sigmoid
from rallypoint.sources.stages import stage


def beta_posterior(rows: DataFrame, wins: str, games: str, baseline: str, strength: float, advantage: float) -> DataFrame:
    """Adds the beta-binomial posterior: alpha, beta, mean, advantage, P(rate > baseline + advantage), tier."""
    a = F.col(baseline) * strength + F.col(wins)
    b = (1 - F.col(baseline)) * strength + F.col(games) - F.col(wins)
    mean = a / (a + b)
    out = rows.select("*", a.alias("alpha"), b.alias("beta"), mean.alias("posterior_mean"), (mean - F.col(baseline)).alias("posterior_advantage"), beta_survival(a, b, F.col(baseline) + advantage).alias("p_advantage"))
    return out.withColumn("tier", evidence_tier(F.col("p_advantage")))


def as_vectors(values: DataFrame, drafts: DataFrame, size: int) -> DataFrame:
    """match_id, label, features: vectors of this size, all-zero for drafts without features."""
    rows = values.groupBy(F.col("match_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("index").cast("int"), F.col("value").cast("double")))).alias("entries"))
    joined = drafts.select("match_id", F.col("outcome").cast("double").alias("label")).join(rows, F.col("match_id") == F.col("of"), "left")
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("entries", i), F.lit(0.0)))
    return joined.select("match_id", "label", array_to_vector(dense).alias("features"))


def fit_logistic(vectors: DataFrame, l2: float) -> np.ndarray:
    """Coefficients that minimise the mean log loss plus l2 / 2 times their square, without intercept."""
    model = LogisticRegression(fitIntercept=False, standardization=False, elasticNetParam=0.0, regParam=l2, maxIter=200, tol=1e-10)
    return model.fit(vectors).coefficients.toArray()


def score_logistic(values: DataFrame, drafts: DataFrame, coefficients: DataFrame) -> DataFrame:
    """match_id, outcome, probability from a table index, coefficient: a join and a sum, no model object."""
    z = values.join(coefficients, "index").groupBy(F.col("match_id").alias("of")).agg(F.sum(F.col("value") * F.col("coefficient")).alias("z"))
    return drafts.join(z, F.col("match_id") == F.col("of"), "left").select("match_id", "outcome", sigmoid(F.coalesce("z", F.lit(0.0))).alias("probability"))


def fit_ridge(rows: DataFrame, alpha: float, weight: str | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of the ridge with penalty alpha times the squared weights, against the summed squared error.

    Spark scales its penalty by the label's deviation and the summed weights;
    both are undone here.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    total, spread = rows.agg(F.sum(w), F.stddev_samp("label")).first()
    model = LinearRegression(standardization=False, elasticNetParam=0.0, regParam=alpha / total * (spread or 1.0), solver="l-bfgs", maxIter=500, tol=1e-10)
    fitted = (model.setWeightCol(weight) if weight else model).fit(rows)
    return fitted.coefficients.toArray(), fitted.intercept


def fit_elastic_net(rows: DataFrame, alpha: float, l1_ratio: float) -> tuple[np.ndarray, float]:
    """The elastic net with loss half the mean squared error; penalty alpha, mixed by l1_ratio."""
    spread = rows.agg(F.stddev_samp("label")).first()[0] or 1.0
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * spread
    fitted = LinearRegression(standardization=False, regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0, solver="l-bfgs", maxIter=1000, tol=1e-12).fit(rows)
    return fitted.coefficients.toArray(), fitted.intercept


def fit_multinomial(rows: DataFrame, c: float, weight: str) -> object:
    """Multinomial logistic regression with inverse penalty c against the summed weighted loss."""
    total = rows.agg(F.sum(weight)).first()[0]
    return LogisticRegression(family="multinomial", standardization=False, elasticNetParam=0.0, regParam=1 / (c * total), weightCol=weight, maxIter=300, tol=1e-10).fit(rows)


def calibration_line(rows: DataFrame, key: str) -> DataFrame:
    """key, intercept, slope of the outcome's logit on logit(p); slope null where p doesn't vary.

    Newton steps on grouped sums: rows of equal p are one cell, and a step
    fetches a gradient and a Hessian of two unknowns for each of the few keys.
    Rows without probability or outcome are no evidence.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    p = F.least(F.greatest(F.col("probability").cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
    known = rows.where("probability IS NOT NULL AND outcome IS NOT NULL").select(F.col(key).alias("of"), F.log(p / (1 - p)).alias("x"), F.col("outcome").cast("double").alias("y"))
    cells = stage(known.groupBy("of", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")), "calibration")
    lines, todo = {}, {}
    for r in cells.groupBy("of").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
        if r["low"] == r["high"]:
            rate = r["s"] / r["n"]
            lines[r["of"]] = (None if rate in (0.0, 1.0) else math.log(rate / (1 - rate)) - r["low"], None)
        else:
            todo[r["of"]] = np.zeros(2)
    at = T.StructType([T.StructField("at", kind), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    q = 1 / (1 + F.exp(-F.col("a") - F.col("b") * F.col("x")))
    off, bend = F.col("s") - F.col("n") * q, F.col("n") * q * (1 - q)
    x = F.col("x")
    sums = [F.sum(c).alias(name) for name, c in (("g", off), ("gx", off * x), ("h", bend), ("hx", bend * x), ("hxx", bend * x * x))]
    for _ in range(100):
        if not todo:
            break
        now = spark.createDataFrame([(k, float(w[0]), float(w[1])) for k, w in todo.items()], at)
        for r in cells.join(F.broadcast(now), F.col("of").eqNullSafe(F.col("at"))).groupBy("of").agg(*sums).collect():
            move = np.linalg.solve(np.array([[r["h"], r["hx"]], [r["hx"], r["hxx"]]]) + 1e-12 * np.eye(2), np.array([r["g"], r["gx"]]))
            todo[r["of"]] = todo[r["of"]] + move
            if np.abs(move).max() < 1e-10:
                w = todo.pop(r["of"])
                lines[r["of"]] = (float(w[0]), float(w[1]))
    lines |= {k: (float(w[0]), float(w[1])) for k, w in todo.items()}
    line = T.StructType([T.StructField(key, kind), T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType())])
    return spark.createDataFrame([(k, *v) for k, v in lines.items()], line)


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def required_sample_size(mean: float, deviation: float, power: float = 0.8, level: float = 0.05, most: int = 10_000_000) -> int | None:
    """The least n at which a two-sided t-test finds the mean with this power (normal approximation of the shift)."""
    if not deviation or not mean:
        return None

    def reached(n: int) -> float:
        cut = student_quantile(1 - level / 2, n - 1)
        shift = abs(mean) / deviation * math.sqrt(n)
        x = cut - shift
        half = float(beta_cdf((n - 1) / 2, 0.5, (n - 1) / (n - 1 + x * x))) / 2
        return half if x > 0 else 1 - half

    low, high = 2, 4
    while reached(high) < power:
        low, high = high, high * 2
        if high > most:
            return None
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) >= power else (middle, high)
    return high


def gate(checks: Iterable[tuple[str, Column]]) -> list[Column]:
    """Each named check as a boolean (null fails), and whether all pass."""
    named = [F.coalesce(c, F.lit(False)).alias(name) for name, c in checks]
    whole = F.lit(True)
    for c in named:
        whole = whole & c
    return [*named, whole.alias("passes")]


def best_configuration(results: DataFrame) -> DataFrame:
    """The configuration with the least loss; losses within 1e-12 tie, then most penalty, then fewest dimensions."""
    least = results.agg(F.min("loss").alias("least"))
    tied = results.join(least, F.col("loss") - F.col("least") <= 1e-12)
    return tied.orderBy(F.desc("l2"), "dimension").limit(1).drop("least")
