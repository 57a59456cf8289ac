"""Joins and ranks that stay balanced when one key holds a large share of all rows.

Adaptive skew handling only splits a join whose two inputs are plain exchanges, and never splits a window. The study
joins event tables (many rows per subject, one subject may be hot) to per-subject tables that come out of an
aggregate, so the hot keys are spread here explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.session import stored

# A key below this many rows is never worth salting.
HEAVY_ROWS = 1_000_000
# A key is hot from this part of an average shuffle partition on, so at most PARTS * partitions keys are hot, and the
# salts of all of them add up to at most twice that: list and copies are bounded by arithmetic, whatever the data.
PARTS = 4


@dataclass(frozen=True)
class HotKeys:
    """The keys worth salting, with a salt count each."""

    rows: tuple

    def frame(self, spark: SparkSession, fields: list[T.StructField]) -> DataFrame:
        named = [T.StructField(f"_h_{f.name}", f.dataType) for f in fields]
        return spark.createDataFrame(list(self.rows), T.StructType([*named, T.StructField("_salts", T.IntegerType())]))


def threshold(total: int, partitions: int) -> int:
    """Rows from which a key is hot: the given part of an average partition, and never less than HEAVY_ROWS."""
    return max(HEAVY_ROWS, ceil(total / (PARTS * partitions)))


def hot_keys(df: DataFrame, keys: list[str], heavy_rows: int | None = None) -> HotKeys:
    """Count rows per key and fetch the hot ones, in one job that reads the key columns only.

    Take it once from the raw table and hand it to every join on that key: later filters only make keys lighter. A hot
    key gets as many salts as it has times ``heavy_rows`` rows (by default the :func:`threshold` for this table). The
    number of rows, which the threshold needs, is observed on the way; as many keys as can reach it are fetched.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if heavy_rows is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        seen = Observation()
        top = counts.observe(seen, F.sum("_n").alias("rows")).filter(F.col("_n") > HEAVY_ROWS).orderBy(F.col("_n").desc()).limit(min(PARTS * partitions, 2**31 - 1)).collect()
        heavy_rows = threshold(seen.get["rows"] or 0, partitions) if top else HEAVY_ROWS
    else:
        top = counts.filter(F.col("_n") > heavy_rows).collect()
    return HotKeys(tuple((*r[:-1], ceil(r["_n"] / heavy_rows)) for r in top if r["_n"] > heavy_rows))


def _match(left: list[str], right: list[str], null_safe: bool) -> Column:
    pairs = (F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in zip(left, right))
    return reduce(lambda a, b: a & b, pairs)


def attach(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    null_safe: bool = False,
    condition=None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Join ``right`` (few rows per key) onto ``left`` (any number of rows per key), salting the hot keys of ``left``.

    ``how`` is ``left`` or ``inner``. ``condition(l, r)`` may add a range predicate; ``l(name)`` and ``r(name)`` give
    the columns of the two sides. Without ``hot`` the keys of ``left`` are counted here. The salt is a function of the
    row's content and the number of its input partition: a task that is run again places its rows as before, and
    copies of one row that were read by different tasks are spread.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    names = left.columns
    extra = [c for c in right.columns if c not in keys]
    clash = set(names) & set(extra)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if hot is None:
        hot = hot_keys(left, keys)
    own = [f"_r_{k}" for k in keys]
    side = right.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], *[F.col(c).alias(f"_x_{c}") for c in extra])
    on = _match(keys, own, null_safe)
    if hot.rows:
        heavy = F.broadcast(hot.frame(left.sparkSession, [left.schema[k] for k in keys]))
        listed = [f"_h_{k}" for k in keys]
        salt = F.pmod(F.xxhash64(*names, F.spark_partition_id()), F.col("_salts")).cast("int")
        left = left.join(heavy, _match(keys, listed, True), "left").select(
            *names, F.coalesce(salt, F.lit(0)).alias("_salt")
        )
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_copy")
        side = side.join(heavy, _match(own, listed, True), "left").select(*side.columns, copies)
        on = on & (F.col("_salt") == F.col("_copy"))
    if condition is not None:
        on = on & condition(F.col, lambda c: F.col(f"_r_{c}" if c in keys else f"_x_{c}"))
    return left.join(side, on, how).select(*names, *[F.col(f"_x_{c}").alias(c) for c in extra])


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """1-based row number inside each group of ``keys`` by ``order``; rows equal in ``order`` get different numbers.

    The rows are range-partitioned by key and order, so a hot group spans several partitions; the place of a row is its
    number inside its partition plus the sizes of the same group in earlier partitions. Range bounds are sampled, so
    the partitioned rows are written to the shared folder before they are read twice.
    """
    by_order = [F.col(c) for c in order]
    parts = df.repartitionByRange(*[F.col(c) for c in keys], *by_order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "ranks")
    sizes = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_part").alias("_o_part"),
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    local = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*by_order)))
    on = (F.col("_part") == F.col("_o_part")) & _match(keys, [f"_o_{k}" for k in keys], True)
    return local.join(offsets, on, "inner").select(
        *df.columns, (F.col("_rn") + F.col("_offset")).cast("bigint").alias(out)
    )


def running_totals(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``<c>_upto`` for every ``c`` of ``sums``: its total over the group's rows up to this one by ``order``.

    ``keys`` and ``order`` name a row. The rows are range-partitioned and written as in :func:`rank_within`: totals are
    made inside a partition, and what the group has in earlier partitions is added.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "running")
    ends = parts.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        F.col("_part").alias("_o_part"),
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in sums])
    on = (F.col("_part") == F.col("_o_part")) & _match(keys, [f"_o_{k}" for k in keys], True)
    return local.join(offsets, on, "inner").select(
        *df.columns, *[(F.col(f"_in_{c}") + F.col(f"_o_{c}")).alias(f"{c}_upto") for c in sums]
    )
