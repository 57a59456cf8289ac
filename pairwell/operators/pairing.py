"""Greedy nearest-neighbour pairing on score cells, over tasks of bounded size.

Treated subjects choose from the highest score down, each the nearest control that is left. A stratum of many distinct scores is cut where no pair can
cross. Going down the scores, a treated subject passes a cell only when the cell's controls are gone, so of those that pass cell i downwards there are
at most G[i] = max(0, G[i-1] + treated[i] - controls[i]). In the same way at most H[i] = max(0, H[i+1] + treated[i] - (controls[i] - G[i-1])) pass it
upwards. Where G of the cell above and H of the cell below are 0, the two sides have nothing to do with each other. Both bounds are running sums less
their running minimum, which are made over ranges of cells: each range is summed apart, and what the ranges before it leave is added.

Parts between cuts are put together to pieces of bounded size and paired apart. A part that no cut divides and that is larger than a piece is worked off
from the top: a window of cells around its highest open subject is paired as far as the window shows the nearest control on both sides, the cells that
are still open go back, and the next window follows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.session import discard_stored, stored

#: Cells of a piece, before the last part that begins in it; a piece has less than twice as many.
PIECE_CELLS = 100_000

_BLOCK = ["t_score", "c_score", "t_from", "c_from", "q"]


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row per ``keys``."""
    extra = [c for c in right.columns if c not in keys]
    side = right.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *extra)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    return left.join(side, on, how).select(*left.columns, *extra)


class Walk:
    """The greedy walk over some cells of a stratum; ``more_below`` and ``more_above`` say that controls beyond them are left out."""

    def __init__(self, score: np.ndarray, size: np.ndarray, done: np.ndarray, more_below: bool = False, more_above: bool = False):
        self.score, self.size, self.used = score, size, done.copy()
        self.more_below, self.more_above = more_below, more_above
        # links to the next control cell with anything left; left[p] stands for cell p - 1, so 0 and len(score) mean none
        self.left = list(range(len(score) + 1))
        self.right = list(range(len(score) + 1))

    @staticmethod
    def _find(link: list, i: int) -> int:
        root = i
        while link[root] != root:
            root = link[root]
        while link[i] != root:
            link[i], i = root, link[i]
        return root

    def pair(self, s: float, open_: int, done: int) -> tuple[list[tuple], int]:
        """Blocks of pairs of ``open_`` subjects of score ``s``, of which ``done`` have a partner already, and how many of them found one."""
        blocks, at, q_all = [], int(np.searchsorted(self.score, s, side="right")), 0
        while q_all < open_:
            lo, hi = self._find(self.left, at), self._find(self.right, at)
            none_below, none_above = lo == 0, hi == len(self.score)
            if (none_below and (none_above or self.more_below)) or (none_above and self.more_above):
                break
            c = lo - 1 if none_above or (not none_below and s - self.score[lo - 1] <= self.score[hi] - s) else hi
            q = int(min(open_ - q_all, self.size[c] - self.used[c]))
            blocks.append((s, float(self.score[c]), done + q_all, int(self.used[c]), q))
            q_all += q
            self.used[c] += q
            if self.used[c] == self.size[c]:
                self.left[c + 1] = c
                self.right[c] = c + 1
        return blocks, q_all


def _named(blocks: list[tuple], pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(blocks, columns=_BLOCK)
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out


def _block_fields(cells: DataFrame, exact: list[str]) -> list[T.StructField]:
    fields = [T.StructField(c, T.DoubleType()) for c in _BLOCK[:2]] + [T.StructField(c, T.LongType()) for c in _BLOCK[2:]]
    return fields + [cells.schema[c] for c in exact]


def _pairing(exact: list[str]):
    """The function that pairs one piece, whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A piece may hold several strata's or parts' cells only if they do not compete; here it is one stratum's.
        controls = pdf[pdf["n0"] > 0].sort_values("score")
        size = controls["n0"].to_numpy(dtype=np.int64)
        walk = Walk(controls["score"].to_numpy(), size, np.zeros(len(size), np.int64))
        blocks: list[tuple] = []
        treated = pdf[pdf["n1"] > 0].sort_values("score", ascending=False)
        for s, n in zip(treated["score"].to_numpy(), treated["n1"].to_numpy(dtype=np.int64)):
            blocks += walk.pair(s, int(n), 0)[0]
        return _named(blocks, pdf, exact)

    return run


def _reflected(parts: DataFrame, exact: list[str], step: Column, down: bool, out: str, before: str) -> DataFrame:
    """``parts`` with the running sum of ``step`` less its running minimum (0 included) in ``out``, and its value one cell earlier in ``before``.

    Cells go by falling score, or with ``down`` false by rising score. ``parts`` are ranges of cells by falling score, numbered in ``_part``.
    """
    order = F.col("score").desc() if down else F.col("score").asc()
    inside = Window.partitionBy("_part", *exact).orderBy(order)
    rows = parts.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_least", F.min("_sum").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("_part", *exact).agg(F.sum("_step").alias("_all"), F.min("_sum").alias("_low"))
    earlier = Window.partitionBy(*exact).orderBy(F.col("_part").asc() if down else F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ends = ends.withColumn("_base", F.coalesce(F.sum("_all").over(earlier), zero))
    ends = ends.withColumn("_floor", F.least(F.coalesce(F.min(F.col("_base") + F.col("_low")).over(earlier), zero), zero)).select("_part", *exact, "_base", "_floor")
    joined = _with(rows, ends, ["_part", *exact])
    value = F.col("_base") + F.col("_sum") - F.least("_floor", F.col("_base") + F.col("_least"))
    first = F.col("_base") - F.col("_floor")
    joined = joined.withColumn(out, value)
    return joined.withColumn(before, F.coalesce(F.lag(out).over(inside), first)).select(*parts.columns, out, before)


def _running(parts: DataFrame, exact: list[str], value: Column, merge, out: str) -> DataFrame:
    """``parts`` with ``merge`` (a sum or a maximum) of ``value`` over all cells of the stratum down to this one."""
    inside = Window.partitionBy("_part", *exact).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("_value", value).withColumn("_here", merge("_value").over(inside))
    ends = rows.groupBy("_part", *exact).agg(merge("_value").alias("_all"))
    earlier = Window.partitionBy(*exact).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", merge("_all").over(earlier)).select("_part", *exact, "_before")
    joined = _with(rows, ends, ["_part", *exact])
    both = F.array_compact(F.array("_before", "_here"))
    total = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x) if merge is F.sum else F.array_max(both)
    return joined.withColumn(out, total).select(*parts.columns, out)


def cut(cells: DataFrame, exact: list[str], piece_cells: int) -> DataFrame:
    """``cells`` (score, n1, n0) with ``_part_of`` (the rank of the first cell of a part that no pair leaves), ``_cells`` (its size) and ``_piece``."""
    ranges = cells.repartitionByRange(*[F.col(c) for c in exact], F.col("score").desc()).withColumn("_part", F.spark_partition_id())
    parts = stored(ranges, "pair-ranges")
    down = _reflected(parts, exact, F.col("n1") - F.col("n0"), True, "_g", "_g_above")
    down = stored(down.drop("_g"), "pair-ranges")
    free = F.col("n0") - F.least("n0", "_g_above")
    both = _reflected(down, exact, F.col("n1") - free, False, "_h", "_h_below").drop("_h_below")
    ranked = stored(_running(both, exact, F.lit(1).cast("long"), F.sum, "_rank"), "pair-ranges")
    begins = F.when((F.col("_rank") == 1) | ((F.col("_g_above") == 0) & (F.col("_h") == 0)), F.col("_rank"))
    split = stored(_running(ranked, exact, begins, F.max, "_part_of").select(*cells.columns, "_part_of"), "pair-parts")
    sizes = split.groupBy(*exact, "_part_of").agg(F.count(F.lit(1)).alias("_cells"))
    out = stored(_with(split, sizes, [*exact, "_part_of"]).withColumn("_piece", F.floor((F.col("_part_of") - 1) / piece_cells).cast("long")), "pair-parts")
    discard_stored(parts, down, ranked, split)
    return out


def _window(pdf: pd.DataFrame, keys: list[str], exact: list[str], limit: int) -> pd.DataFrame:
    """Pair the cells of one window as far as both nearest controls are in it; blocks, and what is left of the cells that changed."""
    treated = pdf[pdf["role"] == "t"].sort_values("score", ascending=False).iloc[:limit]
    below = pdf[pdf["role"] == "b"].sort_values("score", ascending=False)
    above = pdf[pdf["role"] == "a"].sort_values("score")
    controls = pd.concat([below.iloc[:limit][::-1], above.iloc[:limit]])
    done = controls["done"].to_numpy(dtype=np.int64)
    walk = Walk(controls["score"].to_numpy(), done + controls["left"].to_numpy(dtype=np.int64), done, len(below) > limit, len(above) > limit)
    blocks, cells = [], []
    for s, n, m in zip(treated["score"], treated["left"], treated["done"]):
        made, q = walk.pair(float(s), int(n), int(m))
        blocks += made
        if q:
            cells.append((s, True, int(n) - q, int(m) + q))
        if q < n:
            break
    cells += [(float(s), False, int(z - u), int(u)) for s, z, u, d in zip(walk.score, walk.size, walk.used, done) if u > d]
    out = _named(blocks, pdf, exact)
    more = pd.DataFrame(cells, columns=["score", "treated", "left", "done"])
    both = pd.concat([out, more], ignore_index=True) if len(more) else out
    for k in keys:
        both[k] = pdf[k].iloc[0]
    for c, kind in (*[(c, "Int64") for c in [*_BLOCK[2:], "left", "done"]], ("treated", "boolean")):
        both[c] = both[c].astype(kind) if c in both else pd.array([None] * len(both), kind)
    if "score" not in both:
        both["score"] = np.nan
    return both


def worked_off(cells: DataFrame, exact: list[str], limit: int) -> DataFrame | None:
    """Blocks of parts that are too large for a piece, window by window; a window has at most three times ``limit`` cells and three more."""
    keys = [*exact, "_part_of"]
    roles = F.array(*[F.struct(F.lit(t).alias("treated"), F.col(n).cast("long").alias("left"), F.lit(0).cast("long").alias("done")) for t, n in ((True, "n1"), (False, "n0"))])
    open_ = stored(cells.select(*keys, "score", F.explode(roles).alias("r")).select(*keys, "score", "r.*").where("left > 0"), "pair-open")
    fields = [*_block_fields(cells, exact), T.StructField("_part_of", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("treated", T.BooleanType())]
    schema = T.StructType([*fields, T.StructField("left", T.LongType()), T.StructField("done", T.LongType())])
    blocks: DataFrame | None = None
    while True:
        tops = open_.groupBy(*keys).agg(F.max(F.when(F.col("treated"), F.col("score"))).alias("_top"), F.count_if(~F.col("treated")).alias("_controls"))
        rows = _with(open_, tops.where("_top is not null and _controls > 0"), keys).drop("_controls")
        role = F.when(F.col("treated"), "t").when(F.col("score") <= F.col("_top"), "b").otherwise("a")
        rows = rows.withColumn("role", role).withColumn("_far", F.abs(F.col("score") - F.col("_top")))
        near = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "role").orderBy("_far"))).where(F.col("_n") <= limit + 1).drop("_n", "_far", "_top")
        made = stored(near.groupBy(*keys).applyInPandas(lambda pdf: _window(pdf, keys, exact, limit)[schema.names], schema), "pair-made")
        got = made.where("t_score is not null").select(*exact, *_BLOCK)
        if not got.limit(1).count():
            discard_stored(open_)
            return blocks
        blocks = got if blocks is None else blocks.unionByName(got)
        changed = made.where("t_score is null").select(*keys, "score", "treated", F.col("left").alias("_left"), F.col("done").alias("_done"))
        rest = _with(open_, changed, [*keys, "score", "treated"], "left")
        rest = rest.select(*keys, "score", "treated", F.coalesce("_left", "left").alias("left"), F.coalesce("_done", "done").alias("done"))
        after = stored(rest.where("left > 0"), "pair-open")
        discard_stored(open_)
        open_ = after


def pair_blocks(cells: DataFrame, exact: list[str], piece_cells: int | None = None) -> DataFrame:
    """Greedy pairing per stratum on cells (``score``, ``n1`` treated, ``n0`` controls): exact, t_score, c_score, t_from, c_from, q.

    A block is ``q`` treated of one cell, from its place ``t_from``, with ``q`` controls of another from place ``c_from``. Equal distances go to the lower
    score. No task gets more than about twice ``piece_cells`` cells (by default PIECE_CELLS).
    """
    limit = piece_cells or PIECE_CELLS
    cells = cells.select(*exact, "score", F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"))
    schema = T.StructType(_block_fields(cells, exact))
    columns = [*exact, *_BLOCK]
    largest = cells.groupBy(*exact).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= limit:
        return cells.groupBy(*exact).applyInPandas(_pairing(exact), schema).select(*columns)
    split = cut(cells, exact, limit)
    blocks = split.where(F.col("_cells") <= limit).groupBy(*exact, "_piece").applyInPandas(_pairing(exact), schema).select(*columns)
    long = split.where(F.col("_cells") > limit).select(*exact, "_part_of", "score", "n1", "n0")
    more = worked_off(long, exact, max(limit // 3, 1)) if long.limit(1).count() else None
    return blocks if more is None else blocks.unionByName(more.select(*columns))
