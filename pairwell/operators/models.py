"""Count models with a log link on a frequency table: Poisson and negative binomial.

All covariates are categories, so the model frame is one aggregate: rows per (categories, count value). A fit needs two tables made from it: sums per
observed combination of levels (a pattern), and for the dispersion how many rows have a count above j. Both stay where Spark keeps them. A step of a fit is
one aggregate: each pattern gives the products of its terms, weighted by its mean, and the driver sees the sums only, a matrix of (terms x terms). The same
matrix without weights, swept in the order of the terms, tells which terms are combinations of earlier ones; these have no estimate.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product
from math import ceil, erfc, exp, log, nan, prod, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Steps of one fit; running out of them is reported.
MAX_STEPS = 200
# Linear predictors are held to this range, in steps and in the reported means alike.
LOG_MEAN = 30
# Counts up to this are summed term by term.
SERIES = 10_000
# Terms of a model, and levels of all its factors together: their products are what the driver holds.
MAX_TERMS = 2_000
# A term of which less than this is left by the terms before it is a combination of them.
ALIASED = 1e-9
# Rows of the two tables that one task of a step reads.
TASK_ROWS = 20_000
# From here on the counts vary no more than Poisson counts.
MAX_THETA = 1e10

COEF_TYPE = "term string, estimate double, std_error double, z double, p double"


def model_cells(df: DataFrame, y: str, factors: list[str], exclude_dead: bool = True) -> DataFrame:
    """Frequency table of the complete rows: factors, ``y`` and row count ``n``. Dead subjects are left out or kept."""
    rows = df.dropna(subset=[y, *factors])
    if exclude_dead:
        rows = rows.filter(F.col("ind_death") != "1")
    return rows.groupBy(*factors, F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Term:
    """A product of level indicators; no parts is the intercept."""

    parts: tuple

    @property
    def name(self) -> str:
        return ":".join(f"{f}={v}" for f, v in self.parts) or "(Intercept)"


def design(
    cells: DataFrame, factors: list[str], interactions: bool, order: dict[str, tuple] | None = None
) -> tuple[list[Term], Column]:
    """The terms, the intercept first, and a column with the numbers of the terms that a row has.

    Treatment contrasts against the first observed level, with all products if asked for. Levels sort by ``order`` where
    given, else as text.
    """
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("string").alias("v")) for i, f in enumerate(factors)]))
    seen = cells.select(level.alias("l")).select("l.*").distinct().limit(MAX_TERMS + 1).collect()
    if len(seen) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} levels: use coarser factors")
    levels = []
    for i, f in enumerate(factors):
        place = {v: k for k, v in enumerate((order or {}).get(f, ()))}
        levels.append(sorted((r["v"] for r in seen if r["i"] == i), key=lambda v: (place.get(v, len(place)), v))[1:])
    chosen = [c for size in range(1, (len(factors) if interactions else 1) + 1) for c in combinations(range(len(factors)), size)]
    if sum(prod(len(levels[i]) for i in c) for c in chosen) >= MAX_TERMS:
        raise ValueError(f"{MAX_TERMS} terms or more: use coarser factors or fewer interactions")
    at = [F.array_position(F.array(*map(F.lit, v)), F.col(f).cast("string")).cast("int") if v else F.lit(0) for f, v in zip(factors, levels)]
    terms, numbers = [Term(())], [F.lit(0)]
    for c in chosen:
        number, here = F.lit(len(terms)), F.lit(True)
        for k, i in enumerate(c):
            number = number + (at[i] - 1) * prod(len(levels[j]) for j in c[k + 1 :])
            here = here & (at[i] > 0)
        numbers.append(F.when(here, number))
        terms += [Term(tuple((factors[i], v) for i, v in zip(c, values))) for values in product(*[levels[i] for i in c])]
    return terms, F.array_compact(F.array(*numbers))


def _two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def independent(gram: np.ndarray) -> list[int]:
    """The terms that are no linear combinations of earlier ones: the matrix is swept by one pivot after the other."""
    a, scale, kept = gram.astype(float).copy(), np.diag(gram).copy(), []
    for k in range(len(a)):
        if a[k, k] <= ALIASED * scale[k]:
            continue
        kept.append(k)
        a = a - np.outer(a[:, k], a[k]) / a[k, k]
    return kept


def _num(x: float) -> str:
    return f"({float(x)!r}D)"


def _scalars(values: dict[int, str]) -> str:
    """Sums that belong to no term, by number: an array of parts. A step is put together as SQL text, which costs the driver least."""
    return f"CAST(array({', '.join(f'named_struct("i", -1, "j", {k}, "v", CAST({v} AS DOUBLE))' for k, v in values.items())}) AS array<struct<i:int,j:int,v:double>>)"


def _given(parts: str, theta: float | None) -> str:
    """``parts`` with ``th`` as a variable: a number that changes with each step must not be in the code that Spark compiles."""
    return f"flatten(transform(array({_num(theta or 1.0)}), th -> {parts}))"


def _products(weight: str) -> str:
    """Of all pairs of terms of a pattern, the lower number first."""
    return f"flatten(transform(t, a -> transform(filter(t, b -> b >= a), b -> named_struct('i', a, 'j', b, 'v', CAST({weight} AS DOUBLE)))))"


def _sums(tasks: int | None, *parts: DataFrame) -> dict[tuple[int, int], float]:
    """One aggregate over frames with an array ``s`` of parts, read by so many tasks; a single one needs no shuffle."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.coalesce(tasks) if tasks else rows
    rows = rows.selectExpr("inline(s)").groupBy("i", "j").agg({"v": "sum"})
    return {(r[0], r[1]): r[2] for r in rows.collect()}


class _Model:
    """A model frame in the form the fits read: ``patterns`` (t, n, y, yy), ``values`` (y, n) and ``above`` (j, y, c)."""

    def __init__(self, cells: DataFrame, factors: list[str], interactions: bool, order: dict[str, tuple] | None):
        self.own = not cells.is_cached
        self.cells = cells.persist() if self.own else cells
        self.terms, numbers = design(self.cells, factors, interactions, order)
        n, y = F.col("n").cast("double"), F.col("y").cast("double")
        self.patterns = self.cells.groupBy(numbers.alias("t")).agg(F.sum(n).alias("n"), F.sum(n * y).alias("y"), F.sum(n * y * y).alias("yy")).persist()
        self.values = self.cells.groupBy(y.alias("y")).agg(F.sum(n).alias("n")).persist()
        counted = self.values.selectExpr(_scalars({1: "1"}) + " AS s")
        whole = _sums(None, self.patterns.selectExpr(f"concat({_products('n')}, {_scalars({0: 'y', 1: '1'})}) AS s"), counted)
        self.tasks = ceil((whole.get((-1, 1), 0.0) + 1) / TASK_ROWS)
        self.kept = independent(self.matrix(whole))
        self.total, self.mean = whole.get((0, 0), 0.0), whole.get((-1, 0), 0.0) / max(whole.get((0, 0), 0.0), 1.0)
        self.beta = np.zeros(len(self.terms))
        self.beta[0] = log(max(self.mean, 1e-8))
        self.steps = 0

    def close(self) -> None:
        for frame in (self.patterns, self.values, *([self.cells] if self.own else [])):
            frame.unpersist()

    def sums(self, *parts: DataFrame) -> dict[tuple[int, int], float]:
        return _sums(self.tasks, *parts)

    def matrix(self, sums: dict) -> np.ndarray:
        out = np.zeros((len(self.terms),) * 2)
        for (i, j), v in sums.items():
            if i >= 0 and j >= 0:
                out[i, j] = out[j, i] = v
        return out

    def weighted(self, scalars: dict[int, str], theta: float | None = None) -> DataFrame:
        """The parts of one step: products of terms, right sides (j = -1) and ``scalars``, expressions of the mean ``mu`` and of ``th``."""
        beta = f"array({', '.join(_num(b) for b in self.beta)})"
        sum_ = f"aggregate(transform(t, i -> element_at({beta}, i + 1)), 0D, (a, x) -> a + x)"
        rows = self.patterns.selectExpr("*", f"least(greatest({sum_}, {_num(-LOG_MEAN)}), {_num(LOG_MEAN)}) AS eta")
        damp = "(1 + mu / th)" if theta else "1D"
        rights = f"transform(t, a -> named_struct('i', a, 'j', -1, 'v', n * mu / {damp} * eta + (y - n * mu) / {damp}))"
        all_ = f"concat({_products(f'n * mu / {damp}')}, {rights}, {_scalars(scalars)})"
        return rows.selectExpr(_given(f"flatten(transform(array(exp(eta)), mu -> {all_}))", theta) + " AS s")

    def solved(self, sums: dict) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, their covariances) of the weighted least squares; terms without an estimate have 0."""
        k = np.array(self.kept, int)
        gram = self.matrix(sums)[np.ix_(k, k)]
        # scaled, so that a level without any day (its mean runs to 0) is solved like the others
        root = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        inverse = np.linalg.pinv(gram / np.outer(root, root)) / np.outer(root, root)
        beta = np.zeros(len(self.terms))
        beta[k] = inverse @ np.array([sums.get((int(i), -1), 0.0) for i in k])
        cov = np.full((len(self.terms),) * 2, nan)
        cov[np.ix_(k, k)] = inverse
        return beta, cov

    def rows(self, cov: np.ndarray) -> list[tuple]:
        out = []
        for i, t in enumerate(self.terms):
            if i in self.kept:
                b, se = float(self.beta[i]), sqrt(max(cov[i, i], 0.0))
                z = b / se if se else nan
                out.append((t.name, b, se, z, _two_sided(z)))
            else:
                out.append((t.name, None, None, None, None))
        return out

    def poisson(self, tolerance: float) -> tuple[np.ndarray, bool]:
        """Least squares steps until the coefficients rest; their covariances, and whether they do rest."""
        for _ in range(MAX_STEPS):
            new, cov = self.solved(self.sums(self.weighted({})))
            moved = float(np.max(np.abs(new - self.beta), initial=0))
            self.beta = new
            self.steps += 1
            if moved < tolerance:
                return cov, True
        return cov, False

    def frames(self, cov: np.ndarray, fit: tuple, kinds: str) -> tuple[DataFrame, DataFrame]:
        spark = self.cells.sparkSession
        return spark.createDataFrame(self.rows(cov), COEF_TYPE), spark.createDataFrame([fit], kinds)


_LOG_Y = "CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END"


def fit_poisson(
    cells: DataFrame, factors: list[str], interactions: bool = False, order: dict[str, tuple] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Poisson log-linear model: a coefficient table and a one-row fit table.

    A term that is a combination of earlier ones, such as a product of levels that never occur together, has a row of
    NULLs. ``converged`` is false if the fit used all its steps. A table that the caller has cached stays cached.
    """
    m = _Model(cells, factors, interactions, order)
    cov, converged = m.poisson(1e-10)
    logs = _above(m.values).selectExpr(_given(_scalars({3: _log_sum()}), 1.0) + " AS s")
    sums = m.sums(m.weighted({0: "y * ln(mu)", 1: "n * mu"}), m.values.selectExpr(_scalars({2: f"n * {_LOG_Y}"}) + " AS s"), logs)
    fitted, means, own, factorials = (sums.get((-1, k), 0.0) for k in range(4))
    days = m.mean * m.total
    deviance = 2 * (own - fitted - days + means)
    null = 2 * (own - (days * log(m.mean) if days else 0.0))
    total, p = int(m.total), len(m.kept)
    fit = (total, total - p, float(deviance), float(null), total - 1, float(-2 * (fitted - means - factorials) + 2 * p), m.steps, converged)
    out = m.frames(
        cov,
        fit,
        "n_rows long, df_residual long, deviance double, null_deviance double, df_null long, aic double, "
        "iterations int, converged boolean",
    )
    m.close()
    return out


def _above(values: DataFrame) -> DataFrame:
    """How many rows have a count above j: (j, c), for j below SERIES; a larger count is a row (y, c) of its own besides."""
    steps = F.explode(F.sequence(F.lit(0), F.least(F.col("y"), F.lit(float(SERIES))).cast("int") - 1))
    low = values.where("y >= 1").select(steps.alias("j"), "n").groupBy("j").agg(F.sum("n").alias("c"))
    high = values.where(F.col("y") > SERIES).select(F.lit(None).cast("int").alias("j"), "y", F.col("n").alias("c"))
    return low.select("j", F.lit(None).cast("double").alias("y"), "c").unionByName(high.select("j", "y", "c"))


def _tail(power: int) -> str:
    """Sum over SERIES <= j < y of (th + j)^-power, or of its log: an integral with its first end corrections."""
    a, b = f"(th + {SERIES})", "(th + y)"
    if power == 0:
        return f"{b} * ln({b}) - {b} - ({a} * ln({a}) - {a}) - (ln({b}) - ln({a})) / 2 + (1 / {b} - 1 / {a}) / 12"
    if power == 1:
        return f"ln({b} / {a}) - (1 / {b} - 1 / {a}) / 2 - (1 / ({b} * {b}) - 1 / ({a} * {a})) / 12"
    return f"1 / {a} - 1 / {b} - (1 / ({b} * {b}) - 1 / ({a} * {a})) / 2 - (1 / ({b} * {b} * {b}) - 1 / ({a} * {a} * {a})) / 6"


def _log_sum() -> str:
    """Sum of the logs of th + j over the counts above j."""
    return f"c * CASE WHEN j IS NOT NULL THEN ln(j + th) ELSE {_tail(0)} END"


def _power_sum(power: int) -> str:
    return f"c * CASE WHEN j IS NOT NULL THEN pow(j + th, {-power}) ELSE {_tail(power)} END"


def fit_negbin(
    cells: DataFrame, factors: list[str], interactions: bool = False, order: dict[str, tuple] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Negative binomial model with maximum-likelihood dispersion: a coefficient table and a one-row fit table.

    After a Poisson fit, each step solves the weighted least squares for the coefficients and takes one Newton step for
    theta, both from one aggregate over the patterns and the counts above j. Terms without an estimate have a row of
    NULLs. ``converged`` is false if the steps ran out or theta left its range (counts that vary no more than Poisson
    counts do); the last values are reported then.
    """
    m = _Model(cells, factors, interactions, order)
    m.poisson(1e-2)
    excess = m.sums(m.weighted({0: "yy - 2 * mu * y + n * mu * mu - n * mu", 1: "n * mu * mu"}))
    excess = excess.get((-1, 0), 0.0) / max(excess.get((-1, 1), 0.0), 1e-300)
    theta = 1 / excess if excess > 1e-6 else 1e6
    above = _above(m.values).persist()

    def step(theta: float) -> tuple[dict, float, float]:
        """The sums of a step with the score and the information of theta."""
        score = "n * (ln(th) + 1 - ln(mu + th)) - (y + n * th) / (mu + th)"
        info = "2 * n / (mu + th) - n / th - (y + n * th) / ((mu + th) * (mu + th))"
        counts = above.selectExpr(_given(_scalars({k: _power_sum(k + 1) for k in (0, 1)}), theta) + " AS s")
        sums = m.sums(m.weighted({0: score, 1: info}, theta), counts)
        return sums, sums.get((-1, 0), 0.0), sums.get((-1, 1), 0.0)

    converged = False
    for _ in range(MAX_STEPS):
        sums, score, info = step(theta)
        new, _ = m.solved(sums)
        # Newton where the likelihood is concave, else a step along the score in log theta
        move = score / info if info > 0 else np.sign(score) * theta * 0.5
        next_theta = float(min(max(theta + move, theta / 4), theta * 4, MAX_THETA))
        moved, turned = float(np.max(np.abs(new - m.beta), initial=0)), abs(next_theta - theta) / theta
        m.beta, theta = new, next_theta
        m.steps += 1
        if theta >= MAX_THETA:
            break
        if moved < 1e-8 and turned < 1e-8:
            converged = True
            break
    sums, _, info = step(theta)
    _, cov = m.solved(sums)
    sums = m.sums(
        m.weighted({0: "y * ln(mu)", 1: "(y + n * th) * ln(mu + th)"}, theta),
        m.values.selectExpr(_given(_scalars({2: f"n * {_LOG_Y}", 3: "n * (y + th) * ln(y + th)"}), theta) + " AS s"),
        above.selectExpr(_given(_scalars({4: _log_sum()}), theta) + " AS s"),
        above.selectExpr(_given(_scalars({5: _log_sum()}), 1.0) + " AS s"),
    )
    fitted, both, own, own_both, rising, factorials = (sums.get((-1, k), 0.0) for k in range(6))
    loglik = rising - factorials + m.total * theta * log(theta) + fitted - both
    days = m.mean * m.total
    deviance = 2 * (own - own_both - fitted + both)
    # the null model keeps this theta; its mean is the mean count
    null = 2 * (own - own_both - (days * log(m.mean) if days else 0.0) + (days + m.total * theta) * log(m.mean + theta))
    total, p = int(m.total), len(m.kept)
    fit = (total, total - p, theta, 1 / sqrt(info) if info > 0 else nan, 2 * loglik, deviance, null, total - 1, -2 * loglik + 2 * (p + 1), m.steps, converged)
    out = m.frames(
        cov,
        fit,
        "n_rows long, df_residual long, theta double, theta_se double, twologlik double, deviance double, "
        "null_deviance double, df_null long, aic double, iterations int, converged boolean",
    )
    above.unpersist()
    m.close()
    return out
