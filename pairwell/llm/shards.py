"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

The tree is cut at weighted medians, the weight being bytes, so that all leaves hold nearly the same bytes while rows that are alike in metadata
stay together. Equal texts are one point of the tree and go to one shard, unless such a group is too large for that (see ``group_share``).

A cut is searched on a 48-bit key of the node's widest dimension: 24 bits of coordinate and 24 bits of a hash that orders ties. Each step is one
aggregate that sums the bytes of 4,096 equal parts of the key range still in question, so the driver sees (nodes x 4,096) sums, never points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.session import discard_stored, stored

COORD_BITS = 24
DIGIT_BITS = 12
#: A cut may miss its target by this share of a shard's bytes; then the search goes no deeper.
TOLERANCE = 0.0005
ROW_BYTES = 8


def _tie(atom: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("tie"), atom), F.lit(1 << COORD_BITS))


def _coordinate(df: DataFrame, name: str, spread: dict) -> Column:
    """A dimension as an integer of 24 bits: numbers scaled on a log axis, other values hashed; missing ones are 0."""
    top = (1 << COORD_BITS) - 1
    if dict(df.dtypes)[name] in ("string", "boolean", "date", "timestamp"):
        return F.when(F.col(name).isNull(), 0).otherwise(F.shiftright(F.crc32(F.col(name).cast("string")), 32 - COORD_BITS)).cast("long")
    low, high = spread[name]
    if low is None or high <= low:
        return F.lit(0).cast("long")
    return F.coalesce(F.floor(F.log1p(F.col(name).cast("double") - low) / math.log1p(high - low) * top), F.lit(0)).cast("long")


def _table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A few rows of whole numbers for every task."""
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(f'({", ".join(f"{x}L" for x in r)})' for r in rows)} AS t({columns})"))


def _key(dims: int) -> Column:
    """The key of a point on the dimension that its node's row names: the coordinate, then the tie."""
    return F.shiftleft(F.element_at(F.array(*[F.col(f"c{d}") for d in range(dims)]), (F.col("dim") + 1).cast("int")), COORD_BITS) + F.col("tie")


def _cuts(atoms: DataFrame, nodes: dict[int, tuple[int, int]], dims: int, total: int, shards: int) -> dict[int, tuple[int, int]]:
    """node -> (dimension, last key of the left side), for every node of two shards or more.

    ``nodes``: node -> (shards of its left side, all its shards). What a step asks of each node is a row of a small table that goes to all tasks, so the
    plans do not grow with the nodes.
    """
    spark = atoms.sparkSession
    spans = [F.max(f"c{d}") - F.min(f"c{d}") for d in range(dims)]
    wide = _table(spark, "node", [(n,) for n, (_, k) in nodes.items() if k > 1])
    sums = atoms.join(wide, "node").groupBy("node").agg(F.sum("w").alias("w"), *[s.alias(f"s{d}") for d, s in enumerate(spans)]).collect()
    widest = {r["node"]: max(range(dims), key=lambda d: (r[f"s{d}"], -d)) for r in sums}
    goal = {r["node"]: r["w"] * nodes[r["node"]][0] // nodes[r["node"]][1] for r in sums}
    low = dict.fromkeys(widest, 0)  # the first key still in question, and the bytes below it
    below = dict.fromkeys(widest, 0)
    done: dict[int, tuple[int, int]] = {}
    for shift in range(2 * COORD_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        open_nodes = [n for n in widest if n not in done]
        if not open_nodes:
            break
        asked = _table(spark, "node, dim, low", [(n, widest[n], low[n]) for n in open_nodes])
        place = atoms.join(asked, "node").select("node", "w", (_key(dims) - F.col("low")).alias("place"))
        inside = place.where(F.col("place").between(0, (1 << (shift + DIGIT_BITS)) - 1))
        bins: dict[int, list[tuple[int, int]]] = {n: [] for n in open_nodes}
        for r in inside.groupBy("node", F.shiftright("place", shift).alias("part")).agg(F.sum("w").alias("w")).collect():
            bins[r["node"]].append((r["part"], r["w"]))
        for n in open_nodes:
            at = below[n]
            for digit, w in sorted(bins[n]):
                if at + w >= goal[n]:
                    break
                at += w
            first = low[n] + (digit << shift)
            if w * shards <= TOLERANCE * total or shift == 0:
                done[n] = (widest[n], first - 1 if goal[n] - at < at + w - goal[n] else first + (1 << shift) - 1)
            else:
                low[n], below[n] = first, at
    return done


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dims: tuple[str, ...] = ("source", "lang", "n_chars"),
    id: str = "doc_id",
    text: str = "text",
    group_share: int = 16,
    slot_rows: int = 65_536,
) -> DataFrame:
    """Every row of ``docs`` with its shard: id, size, text_crc32, law, shard, slot, grown_shard.

    ``shards`` is the number of leaves, or follows from ``target_bytes``: as many as the bytes need. Shards are numbered along the tree, so equal or
    neighbouring numbers are alike in metadata. ``slot`` numbers a shard's rows from 0 without gaps. ``law`` is ``bytes``: the shards' sizes are
    near equal. ``grown_shard`` is null, since another number of shards makes another tree.

    A group of equal texts stays whole while it has at most 1/``group_share`` of a shard's bytes and a quarter of a shard's rows; a larger one is
    spread row by row, like rows of different texts. At most ``(group_share + 4) * shards`` groups can be larger, so their list is broadcast.

    A null text counts as empty: size 8, text_crc32 0. A null dimension is the lowest value of its axis, a null id is kept as a row of its own, and
    repeated rows are rows like any other. An empty table gives an empty result. Columns other than the id, text and dimensions are not read.
    """
    numbers = [d for d in dims if dict(docs.dtypes)[d] not in ("string", "boolean", "date", "timestamp")]
    ends = docs.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(d).cast("double")).alias(f"{k}_{d}") for d in numbers for k, f in (("low", F.min), ("high", F.max))]).first()
    spread = {d: (ends[f"low_{d}"], ends[f"high_{d}"]) for d in numbers}
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id).alias("doc_id"),
            (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("copy_of"),
            *[_coordinate(docs, d, spread).alias(f"c{i}") for i, d in enumerate(dims)],
        ).withColumn("rid", F.monotonically_increasing_id()),
        "kd-rows",
    )
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("w")).first()
    n, total = known["n"], known["w"]
    shards = shards or max(1, math.ceil(total / target_bytes))
    coords = [f"c{i}" for i in range(len(dims))]

    groups = rows.groupBy("copy_of", "text_crc32").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    large = F.broadcast(groups.where((F.col("w") * group_share * shards > total) & (F.col("n") > 1) | (F.col("n") * 4 * shards > n) & (F.col("n") > 1)).select("copy_of", "text_crc32", F.lit(True).alias("spread")))
    row_atom, text_atom = F.xxhash64("copy_of", "text_crc32", "rid"), F.xxhash64("copy_of", "text_crc32")
    rows_read = rows
    rows = rows.join(large, ["copy_of", "text_crc32"], "left").select("doc_id", "size", "text_crc32", "rid", *coords, F.when(F.col("spread"), row_atom).otherwise(text_atom).alias("atom"))
    points = rows.groupBy("atom").agg(F.sum("size").alias("w"), F.min_by(F.struct(*coords), "rid").alias("at"))
    points = stored(points.select("atom", "w", "at.*", _tie(F.col("atom")).alias("tie")), "kd-points")

    atoms, nodes = points.withColumn("node", F.lit(0).cast("long")), {0: shards}
    while any(k > 1 for k in nodes.values()) and total:
        cuts = _cuts(atoms, {a: (k // 2, k) for a, k in nodes.items()}, len(dims), total, shards)
        if not cuts:
            break
        table = _table(docs.sparkSession, "node, dim, last, right", [(a, d, last, a + nodes[a] // 2) for a, (d, last) in cuts.items()])
        side = F.when(_key(len(dims)) > F.col("last"), F.col("right")).otherwise(F.col("node"))
        deeper = stored(atoms.join(table, "node", "left").select("atom", "w", *coords, "tie", side.alias("node")), "kd-points")
        discard_stored(points)
        points = atoms = deeper
        nodes = {x: y for a, k in nodes.items() for x, y in (((a, k // 2), (a + k // 2, k - k // 2)) if a in cuts else ((a, 1),))}

    placed = stored(rows.join(atoms.select("atom", F.col("node").alias("shard")), "atom").select("doc_id", "size", "text_crc32", "rid", "shard"), "kd-placed")
    parts = max(1, math.ceil(n / shards / slot_rows))
    part = F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")
    counts = placed.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1
    numbered = placed.withColumn("part", part).withColumn("place", place).join(starts, ["shard", "part"])
    discard_stored(points, rows_read)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
