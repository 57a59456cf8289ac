"""Propensity scores, nearest-neighbour pairing inside exact strata, and covariate balance.

The covariates are age in years and a day number, so there are far fewer distinct scores than subjects. Both the score
fit and the greedy pairing therefore run on cells (distinct covariate values with counts); subjects are only ranked
inside their cell and told which slot of which pair block they fill.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.operators.aggregate import CASE, CONTROL
from pairwell.operators.logit import Logit, fit_logit
from pairwell.operators.pairing import pair_blocks
from pairwell.session import stored
from pairwell.skew import rank_within, running_totals

# Ranks of one cell are joined to pair blocks in buckets of this many rows.
RANK_BUCKET = 4096


def propensity(df: DataFrame, arm: str, covariates: list[str], out: str = "distance", fit: Logit | None = None) -> DataFrame:
    """Add the fitted probability of being treated: logistic regression of the arm on the covariates.

    ``fit`` is one made before by :func:`pairwell.operators.logit.fit_logit`. A fit that did not converge, because the
    covariates separate the arms or the steps ran out, is used as it is, with a warning.
    """
    fit = fit or fit_logit(df, arm, covariates)
    if not fit.converged:
        warnings.warn(f"the score did not converge in {fit.steps} steps" + ", the covariates separate the arms" * fit.separated, stacklevel=2)
    return df.withColumn(out, 1 / (1 + F.exp(-fit.linear())))


def match_nearest(
    df: DataFrame, arm: str, score: str, exact: list[str], id: str, out: str = "subclass", piece_cells: int | None = None
) -> DataFrame:
    """Pair every treated subject with the nearest unused untreated one of the same stratum; unmatched rows drop out.

    Treated go from the highest score down; ties go to the lower score, then the smaller id. Strata do not compete for
    controls, so pairing them apart gives the same pairs as one pass over all. Inside a stratum equal scores are
    interchangeable but for the id, so the greedy walk runs on score cells with counts: its input is bounded by the
    number of distinct scores, not subjects. It yields blocks of pairs, and each subject finds its block by the rank of
    its id in its cell. A stratum of more than ``piece_cells`` distinct scores (see :mod:`pairwell.operators.pairing`) is
    cut into pieces. ``out`` names the pair.
    """
    on_arm = F.when(F.col(arm) == CASE, F.lit(CASE)).when(F.col(arm) == CONTROL, F.lit(CONTROL))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*exact, score, id]])
    rows = df.filter(known & on_arm.isNotNull()).withColumn("_score", F.col(score).cast("double") + F.lit(0.0))
    cells = rows.groupBy(*exact, F.col("_score").alias("score")).agg(
        F.count_if(on_arm == CASE).alias("n1"), F.count_if(on_arm == CONTROL).alias("n0")
    )
    blocks = pair_blocks(cells, exact, piece_cells)

    keys = [*exact, arm, "_score"]
    ranked = rank_within(rows, keys, [id], "_rank")
    ranked = ranked.withColumn("_bucket", F.floor((F.col("_rank") - 1) / RANK_BUCKET).cast("bigint"))
    # both ends of a block as one row each, copied to the rank buckets the block covers
    ends = blocks.select(
        *exact,
        "t_score",
        "c_score",
        "t_from",
        "q",
        F.explode(
            F.array(
                F.struct(F.lit(CASE).alias("_arm"), F.col("t_score").alias("_at"), F.col("t_from").alias("_from")),
                F.struct(F.lit(CONTROL).alias("_arm"), F.col("c_score").alias("_at"), F.col("c_from").alias("_from")),
            )
        ).alias("_end"),
    ).select(*exact, "t_score", "c_score", "t_from", "q", "_end.*")
    spans = ends.withColumn(
        "_span",
        F.explode(
            F.sequence(
                F.floor(F.col("_from") / RANK_BUCKET).cast("bigint"),
                F.floor((F.col("_from") + F.col("q") - 1) / RANK_BUCKET).cast("bigint"),
            )
        ),
    ).select(*[F.col(c).alias(f"_e_{c}") for c in exact], "t_score", "c_score", "t_from", "q", "_arm", "_at", "_from", "_span")
    on = (
        reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_e_{c}") for c in exact])
        & (F.col(arm) == F.col("_arm"))
        & (F.col("_score") == F.col("_at"))
        & (F.col("_bucket") == F.col("_span"))
        & (F.col("_rank") > F.col("_from"))
        & (F.col("_rank") <= F.col("_from") + F.col("q"))
    )
    place = F.col("_rank") - F.col("_from") + F.col("t_from")
    stratum = F.concat_ws("/", *[F.col(c).cast("string") for c in exact])
    name = F.concat_ws("|", stratum, F.col("t_score").cast("string"), place.cast("string"))
    return ranked.join(spans, on, "inner").select(*df.columns, name.alias(out))


def match_summary(before: DataFrame, after: DataFrame, arm: str) -> DataFrame:
    """Subjects per arm before matching, matched, and left over."""
    sizes = lambda df, name: df.agg(
        F.count_if(F.col(arm) == CONTROL).alias(f"{name}_0"), F.count_if(F.col(arm) == CASE).alias(f"{name}_1")
    )
    both = sizes(before, "all").unionByName(sizes(after, "matched"), allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    line = lambda name, control, case: F.struct(
        F.lit(name).alias("sample"), control.alias("control_n"), case.alias("case_n")
    )
    all0, all1, m0, m1 = (F.col(c) for c in ("all_0", "all_1", "matched_0", "matched_1"))
    lines = F.array(line("all", all0, all1), line("matched", m0, m1), line("unmatched", all0 - m0, all1 - m1))
    return row.select(F.inline(lines))


def balance(
    before: DataFrame, after: DataFrame, arm: str, numeric: list[str], categorical: list[str], threshold: float = 0.1
) -> DataFrame:
    """Mean difference treated minus untreated per covariate and per level, before and after matching.

    Numeric covariates are divided by the treated deviation before matching, levels are raw differences of shares.
    Each input is scanned once: an aggregate per (arm, categories) cell keeps count, mean and squared deviations,
    which are then combined.
    """
    parts = [_balance_parts(df, arm, numeric, categorical, i) for i, df in ((0, before), (1, after))]
    moments = parts[0].unionByName(parts[1])
    at = lambda side, a, col: F.max(F.when((F.col("_side") == side) & (F.col("_arm") == a), F.col(col)))
    wide = moments.groupBy("variable", "level").agg(
        *[at(s, a, "_mean").alias(f"m{s}{a}") for s in (0, 1) for a in (CASE, CONTROL)],
        at(0, CASE, "_sd").alias("sd"),
    )
    diff = lambda s: F.coalesce(F.col(f"m{s}{CASE}"), F.lit(0.0)) - F.coalesce(F.col(f"m{s}{CONTROL}"), F.lit(0.0))
    scale = F.when(F.col("level") == "", F.col("sd")).otherwise(F.lit(1.0))
    out = wide.select(
        "variable",
        "level",
        F.try_divide(diff(0), scale).alias("diff_before"),
        F.try_divide(diff(1), scale).alias("diff_after"),
    )
    return out.withColumn("balanced", F.abs("diff_after") < threshold)


def _balance_parts(df: DataFrame, arm: str, numeric: list[str], categorical: list[str], side: int) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in numeric:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"_n_{c}"), F.avg(v).alias(f"_m_{c}"), F.var_pop(v).alias(f"_v_{c}")]
    cells = df.filter(F.col(arm).isin(CASE, CONTROL)).groupBy(arm, *categorical).agg(*aggs)
    item = lambda variable, level, n, m, ss: F.struct(
        F.lit(variable).alias("variable"), level.alias("level"), n.alias("n"), m.alias("m"), ss.alias("ss")
    )
    items = [
        item(c, F.lit(""), F.col(f"_n_{c}"), F.col(f"_m_{c}"), F.col(f"_v_{c}") * F.col(f"_n_{c}")) for c in numeric
    ] + [
        item(c, F.coalesce(F.col(c).cast("string"), F.lit("missing")), F.col("_n"), F.lit(1.0), F.lit(0.0))
        for c in categorical
    ]
    rows = cells.select(F.col(arm).alias("_arm"), F.explode(F.array(*items)).alias("_i")).select("_arm", "_i.*")
    sums = rows.groupBy("_arm", "variable", "level").agg(
        F.sum("n").alias("_k"),
        F.sum(F.col("n") * F.col("m")).alias("_s"),
        F.sum(F.col("ss") + F.col("n") * F.col("m") * F.col("m")).alias("_q"),
    )
    mean = F.try_divide("_s", "_k")
    share = F.col("_k") / F.sum("_k").over(Window.partitionBy("_arm", "variable"))
    spread = F.sqrt(F.try_divide(F.col("_q") - F.col("_k") * mean * mean, F.col("_k") - 1))
    return sums.select(
        F.lit(side).alias("_side"),
        "_arm",
        "variable",
        "level",
        F.when(F.col("level") == "", mean).otherwise(share).alias("_mean"),
        spread.alias("_sd"),
    )


def balance_summary(before: DataFrame, after: DataFrame, arm: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """The matching summary: per sample (``all``, ``matched``), covariate and level how far the arms are apart.

    ``std_mean_diff`` is treated minus untreated over the treated deviation before matching (of a share p: the root of
    p * (1 - p)), ``var_ratio`` the treated variance over the untreated, ``ecdf_mean`` and ``ecdf_max`` the mean over the
    distinct values and the maximum of the distance between the arms' distribution functions. A level has a share per arm,
    no variances, and the difference as both distances. A level that only one sample has is 0 in the other; a missing
    value is left out of a number and is the level ``missing`` of a category.

    Everything starts from counts per distinct value; distribution functions are running totals over ranges of values.
    """
    item = lambda variable, level, value: F.struct(F.lit(variable).alias("variable"), level.alias("level"), value.cast("double").alias("value"))
    items = [item(c, F.lit(""), F.col(c)) for c in numeric] + [
        item(c, F.coalesce(F.col(c).cast("string"), F.lit("missing")), F.lit(None)) for c in categorical
    ]
    both = [
        df.filter(F.col(arm).isin(CASE, CONTROL)).select(F.lit(name).alias("sample"), F.col(arm).alias("_arm"), F.explode(F.array(*items)).alias("_i"))
        for name, df in (("all", before), ("matched", after))
    ]
    rows = both[0].unionByName(both[1]).select("sample", "_arm", "_i.*").where("level <> '' or value is not null")
    cells = rows.groupBy("sample", "variable", "level", "value").agg(
        F.count_if(F.col("_arm") == CASE).alias("n1"), F.count_if(F.col("_arm") == CONTROL).alias("n0")
    )
    cells = stored(cells, "balance-cells")
    keys, at = ["sample", "variable"], F.col("value")
    sizes = cells.groupBy(*keys).agg(
        F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.sum(F.col("n1") * at).alias("s1"), F.sum(F.col("n0") * at).alias("s0")
    )
    sizes = stored(sizes.select(*keys, "t1", "t0", F.try_divide("s1", "t1").alias("m1"), F.try_divide("s0", "t0").alias("m0")), "balance-sizes")

    upto = running_totals(cells.where("level = ''").select(*keys, "value", "n1", "n0"), keys, ["value"], ["n1", "n0"])
    gap = F.abs(F.try_divide("n1_upto", "t1") - F.try_divide("n0_upto", "t0"))
    square = lambda n, m: F.sum(F.col(n) * (at - F.col(m)) ** 2)
    numbers = upto.join(F.broadcast(sizes), keys).groupBy(*keys, "t1", "t0", "m1", "m0").agg(
        F.try_divide(square("n1", "m1"), F.max("t1") - 1).alias("v1"),
        F.try_divide(square("n0", "m0"), F.max("t0") - 1).alias("v0"),
        F.avg(gap).alias("ecdf_mean"),
        F.max(gap).alias("ecdf_max"),
    )
    numbers = numbers.select(*keys, F.lit("").alias("level"), "m1", "m0", F.sqrt("v1").alias("sd"), F.try_divide("v1", "v0").alias("var_ratio"), "ecdf_mean", "ecdf_max")

    levels = cells.where("level <> ''")
    each = F.explode(F.array(F.lit("all"), F.lit("matched"))).alias("sample")
    counted = levels.select("variable", "level").distinct().select("variable", "level", each).join(levels, [*keys, "level"], "left")
    share = lambda n, of: F.coalesce(F.try_divide(F.coalesce(n, F.lit(0)), of), F.lit(0.0))
    shares = counted.join(F.broadcast(sizes), keys, "left").select(*keys, "level", share("n1", "t1").alias("m1"), share("n0", "t0").alias("m0"))
    off = F.abs(F.col("m1") - F.col("m0"))
    shares = shares.select(
        *keys, "level", "m1", "m0", F.sqrt(F.col("m1") * (1 - F.col("m1"))).alias("sd"), F.lit(None).cast("double").alias("var_ratio"), off.alias("ecdf_mean"), off.alias("ecdf_max")
    )
    table = numbers.unionByName(shares)
    scale = table.where("sample = 'all'").select("variable", "level", F.col("sd").alias("scale"))
    return table.join(scale, ["variable", "level"], "left").select(
        *keys, "level", F.col("m1").alias("mean_treated"), F.col("m0").alias("mean_control"),
        F.try_divide(F.col("m1") - F.col("m0"), F.col("scale")).alias("std_mean_diff"), "var_ratio", "ecdf_mean", "ecdf_max",
    )
