"""Logistic regression of the arm on whole-number or real covariates, with proof of where the fit ended.

The rows are first counted per (covariates, arm). A step is one aggregate over these cells: score, information, deviance and the least margin, which
is how far the worst row is on the right side. Steps are bounded, and halved when the deviance grows. If the arms can be separated by the covariates there
is no maximum: the margin is then positive, or the linear predictor runs away, and the fit says so.
"""

from __future__ import annotations

from math import ceil, erfc, log, sqrt
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.operators.aggregate import CASE
from pairwell.operators.models import COEF_TYPE, TASK_ROWS, independent

MAX_STEPS = 60
# A step moves no coefficient of a scaled covariate by more.
MAX_MOVE = 5.0
# From this linear predictor on a probability is 0 or 1 in all but name.
RUNAWAY = 30.0

FIT_TYPE = (
    "n_rows long, deviance double, null_deviance double, aic double, max_score double, iterations int, "
    "converged boolean, separated boolean"
)


class Logit(NamedTuple):
    """Coefficients on the covariates' own scale, the intercept first; NaN for one that is a combination of earlier ones."""

    covariates: list[str]
    beta: np.ndarray
    std_error: np.ndarray
    rows: int
    deviance: float
    null_deviance: float
    max_score: float
    steps: int
    converged: bool
    separated: bool

    def linear(self):
        out = F.lit(float(self.beta[0]))
        for c, b in zip(self.covariates, self.beta[1:]):
            if not np.isnan(b):
                out = out + F.lit(float(b)) * F.col(c)
        return out

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """(coefficients, fit)."""
        rows = []
        for name, b, se in zip(["(Intercept)", *self.covariates], self.beta.tolist(), self.std_error.tolist()):
            z = b / se if se else float("nan")
            rows.append((name, None, None, None, None) if np.isnan(b) else (name, b, se, z, erfc(abs(z) / sqrt(2))))
        p = int((~np.isnan(self.beta)).sum())
        fit = (self.rows, self.deviance, self.null_deviance, self.deviance + 2 * p, self.max_score, self.steps, self.converged, self.separated)
        return spark.createDataFrame(rows, COEF_TYPE), spark.createDataFrame([fit], FIT_TYPE)


def fit_logit(df: DataFrame, arm: str, covariates: list[str]) -> Logit:
    """Fit by Newton steps on (covariates, arm) cells, which has the same maximum as a fit on the rows. Rows with a NULL are left out."""
    cells = df.groupBy(*covariates, arm).agg(F.count(F.lit(1)).cast("double").alias("_w")).dropna().persist()
    w, k = F.col("_w"), range(len(covariates))
    y = F.when(F.col(arm) == CASE, 1.0).otherwise(0.0)
    first = cells.agg(F.count(w).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("y"), *[F.sum(F.col(c) * w).alias(f"s{i}") for i, c in enumerate(covariates)]).first()
    total, treated = first["w"] or 0.0, first["y"] or 0.0
    if not total:
        cells.unpersist()
        nothing = np.full(len(covariates) + 1, np.nan)
        return Logit(covariates, nothing, nothing, 0, 0.0, 0.0, 0.0, 0, False, False)
    own, cells = cells, cells.coalesce(ceil(first["n"] / TASK_ROWS))
    centre = [first[f"s{i}"] / total for i in k]
    spread = cells.agg(*[F.sum((F.col(c) - m) ** 2 * w).alias(f"v{i}") for i, (c, m) in enumerate(zip(covariates, centre))]).first()
    scale = [sqrt(spread[f"v{i}"] / total) or 1.0 for i in k]
    rows = cells.select(w.alias("w"), y.alias("y"), F.lit(1.0).alias("z0"), *[((F.col(c) - m) / s).alias(f"z{i + 1}") for i, (c, m, s) in enumerate(zip(covariates, centre, scale))])
    p = len(covariates) + 1
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def matrix(row, name: str) -> np.ndarray:
        out = np.zeros((p, p))
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"{name}{i}_{j}"]
        return out

    gram = rows.agg(*[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs]).first()
    kept = np.array(independent(matrix(gram, "h")), int)

    def at(beta: np.ndarray):
        eta = sum((F.lit(float(b)) * F.col(f"z{i}") for i, b in enumerate(beta)), F.lit(0.0))
        here = rows.withColumn("eta", eta).withColumn("mu", 1 / (1 + F.exp(-F.col("eta"))))
        margin = (2 * F.col("y") - 1) * F.col("eta")
        weight = F.col("w") * F.col("mu") * (1 - F.col("mu"))
        return here.agg(
            *[F.sum(F.col("w") * (F.col("y") - F.col("mu")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(p)],
            *[F.sum(weight * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs],
            F.sum(2 * F.col("w") * (F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))))).alias("deviance"),
            F.min(margin).alias("margin"),
            F.max(F.abs("eta")).alias("far"),
        ).first()

    beta, last, least = np.zeros(p), None, float("inf")
    converged = separated = False
    steps, now = 0, at(np.zeros(p))
    while steps < MAX_STEPS:
        if now["deviance"] > least * (1 + 1e-12) and last is not None and np.max(np.abs(beta - last)) > 1e-12:
            beta = (beta + last) / 2
        else:
            least = now["deviance"]
            separated = bool(beta.any()) and (now["margin"] > 0 or now["far"] > RUNAWAY)
            if separated:
                break
            score, information = np.array([now[f"g{i}"] for i in kept]), matrix(now, "h")[np.ix_(kept, kept)]
            move = np.zeros(p)
            move[kept] = np.linalg.lstsq(information, score, rcond=None)[0]
            largest = float(np.max(np.abs(move)))
            if largest < 1e-10:
                converged = True
                break
            last = beta
            beta = beta + move * min(1.0, MAX_MOVE / largest)
        steps += 1
        now = at(beta)
    own.unpersist()
    score = np.array([now[f"g{i}"] for i in kept])
    cov = np.linalg.pinv(matrix(now, "h")[np.ix_(kept, kept)])
    # back to the covariates' own scale
    back = np.eye(p)
    for i in k:
        back[i + 1, i + 1] = 1 / scale[i]
        back[0, i + 1] = -centre[i] / scale[i]
    own = back[:, kept]
    raw, errors = own @ beta[kept], np.sqrt(np.maximum(np.diag(own @ cov @ own.T), 0))
    gone = [i for i in range(p) if i not in kept]
    raw[gone] = errors[gone] = np.nan
    share = treated / total
    null = -2 * total * sum(q * log(q) for q in (share, 1 - share) if q > 0)
    return Logit(covariates, raw, errors, int(total), float(now["deviance"]), null, float(np.max(np.abs(score))), steps, converged, separated)
