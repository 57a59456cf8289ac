"""Exact top-k inner products on a bit-sliced index.

Components are quantised to integers. A block of rows is indexed as bitmaps: one for each attribute and bit, with a bit for each row. A query's scores for
all rows of the block are the sum of attribute slices shifted by the bits of the query's coefficients; the sum is bitmap arithmetic (carry-save
adders), so it yields the slices of the scores. Rows are then selected from the most significant slice downward; rows still equal at the last slice
are the boundary, and the smallest ids of it fill the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.session import stored

SCALE = 256
#: Quantised components of this size or more have no bitmaps of 64-bit differences; they stop the run.
LIMIT = 1 << 61
#: Rows whose largest components differ by more bits than this are indexed apart, so that a few wild rows cost the others nothing.
ALIKE_BITS = 16


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of a list column whose vectors have one length."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if flat.size and np.abs(flat).max() >= LIMIT:
        raise OverflowError(f"a component of {np.abs(flat).max() / SCALE:g} has no exact score of 64 bits")
    return flat.astype(np.int64).reshape(len(vectors), -1 if len(flat) else 0)


def sliced(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """((attribute, bit, word) bitmaps of ``rows`` less their least component, that component); row i is bit i % 64 of word i // 64."""
    low = int(rows.min()) if rows.size else 0
    bits = max(1, (int(rows.max()) - low).bit_length()) if rows.size else 1
    words = -(-len(rows) // 64)
    shifted = np.zeros((words * 64, rows.shape[1]), np.uint64)
    shifted[: len(rows)] = (rows - low).astype(np.uint64)
    planes = [np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little") for b in range(bits)]
    return np.ascontiguousarray(np.stack(planes, axis=1)).view(np.uint64).reshape(rows.shape[1], bits, words), low


def added(slices: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices of the sum of ``query[d] * attribute d``, least first; what to add to the number they spell).

    A coefficient is written in signed digits. A negative digit takes the complement of the slices, which turns minus x into (all ones less x) and a
    constant.
    """
    dims, bits, words = slices.shape
    plain = slices.reshape(dims * bits, words)
    size = np.abs(query)
    half = size >> 1
    odd = half ^ (size + half)
    digits = ((size + half) & odd, half & odd)
    piles: list[list[np.ndarray]] = []
    constant, ones = 0, (1 << bits) - 1
    for sign, values in ((1, digits[0]), (-1, digits[1])):
        for place in range(int(values.max()).bit_length() if dims else 0):
            at = np.flatnonzero((values >> place) & 1)
            negative = (query[at] < 0) == (sign > 0)
            constant -= int(negative.sum()) * (ones << place)
            for side, flip in ((at[~negative], False), (at[negative], True)):
                if len(side):
                    for b in range(bits):
                        while len(piles) <= place + b:
                            piles.append([])
                        taken = plain[side * bits + b]
                        piles[place + b].append(~taken if flip else taken)
    out = []
    weight = 0
    while weight < len(piles):
        pile = np.concatenate(piles[weight]) if piles[weight] else np.zeros((0, words), np.uint64)
        while len(pile) > 1:
            third = len(pile) // 3
            if third:
                a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                either = a ^ b
                carry = (a & b) | (c & either)
                pile = np.concatenate([either ^ c, pile[3 * third :]])
            else:
                carry = pile[:1] & pile[1:]
                pile = pile[:1] ^ pile[1:]
            if weight + 1 == len(piles):
                piles.append([])
            piles[weight + 1].append(carry)
        out.append(pile[0] if len(pile) else np.zeros(words, np.uint64))
        piles[weight] = []
        weight += 1
    return out, constant


def _members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def selected(scores: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores among the bitmap ``rows``, ties to the first place; in no order."""
    sure, maybe = np.zeros_like(rows), rows
    for s in reversed(scores):
        found = sure | (maybe & s)
        n = int(np.bitwise_count(found).sum())
        if n > k:
            maybe = maybe & s
        else:
            sure, maybe = found, maybe & ~s
            if n == k:
                return _members(sure)
    boundary = _members(maybe)
    return np.concatenate([got := _members(sure), boundary[: max(0, k - len(got))]])


def block_top(slices: np.ndarray, low: int, ids: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a block's k best rows for one query; ``ids`` ascend, and rows with the query's own id do not count."""
    rows = np.zeros(slices.shape[2] * 64, np.uint8)
    rows[: len(ids)] = 1
    rows[np.searchsorted(ids, query_id) : np.searchsorted(ids, query_id, "right")] = 0
    scores, constant = added(slices, query)
    at = selected(scores, np.packbits(rows, bitorder="little").view(np.uint64), k)
    # wide sums are spelled as Python integers; what is too large for the result stops the run
    total = np.zeros(len(at), np.int64 if len(scores) < 62 else object)
    for weight, s in enumerate(scores):
        total += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(total.dtype) << weight
    whole = [int(x) + constant + low * sum(query.tolist()) for x in total]
    if whole and max(map(abs, whole)) >= 1 << 63:
        raise OverflowError(f"the score of query {query_id} is beyond 64 bits")
    return ids[at], np.array(whole, np.int64)


_BLOCK = pa.schema([("dims", pa.int32()), ("bits", pa.int32()), ("low", pa.int64()), ("ids", pa.binary()), ("slices", pa.binary())])


def index(vectors: DataFrame, id: str, vector: str, block_rows: int) -> DataFrame:
    """Blocks of at most ``block_rows`` rows of one length and alike in size: dims, bits, low, ids (ascending), slices. The rows are dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}

        def block(kind: tuple[int, int]) -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in held.pop(kind))
            order = np.argsort(ids, kind="stable")
            slices, low = sliced(rows[order])
            return pa.RecordBatch.from_pylist([{"dims": kind[0], "bits": slices.shape[1], "low": low, "ids": ids[order].tobytes(), "slices": slices.tobytes()}], _BLOCK)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                same = np.flatnonzero(sizes == dims)
                rows = quantised(lists.take(pa.array(same)))
                large = np.abs(rows).max(axis=1, initial=0)
                alike = np.ceil(np.log2(large + 1.0) / ALIKE_BITS).astype(int)
                for size in np.unique(alike).tolist():
                    mine = np.flatnonzero(alike == size)
                    for part in np.array_split(mine, -(-len(mine) // block_rows)):
                        got = held.setdefault((dims, size), ([], []))
                        if sum(map(len, got[0])) + len(part) > block_rows:
                            yield block((dims, size))
                            got = held.setdefault((dims, size), ([], []))
                        got[0].append(ids[same[part]])
                        got[1].append(rows[part])
        for kind in list(held):
            yield block(kind)

    tasks = max(1, math.ceil(vectors.count() / block_rows))
    blocks = vectors.select(F.col(id).cast("long"), F.col(vector)).repartition(tasks).mapInArrow(run, "dims int, bits int, low long, ids binary, slices binary")
    return blocks.withColumn("part", F.spark_partition_id())


def _answered(k: int):
    """The function that reads the blocks of a part, then all queries in batches, and returns the best rows of each block for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for batch in batches:
            parts = batch.column("part").to_numpy()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for here in dict.fromkeys(parts.tolist()):
                if here != part:
                    part, blocks = here, []
                mine = batch.filter(pa.array(parts == here))
                is_block = mine.column("dims").is_valid()
                for row in mine.filter(is_block).select(_BLOCK.names).to_pylist():
                    ids = np.frombuffer(row["ids"], np.int64)
                    blocks.append((np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["bits"], -(-len(ids) // 64)), row["low"], ids))
                asked = mine.filter(pc.invert(is_block))
                names, lists = asked.column("query_id").to_numpy(), asked.column("query")
                sizes = np.diff(lists.offsets.to_numpy()[: len(lists) + 1]) if len(lists) else np.zeros(0, np.int64)
                for block in blocks:
                    of = np.flatnonzero(sizes == block[0].shape[0])
                    for q, vec in zip(names[of], quantised(lists.take(pa.array(of))) if len(of) else [], strict=True):
                        got, score = block_top(*block, q, vec, k)
                        found.append((np.full(len(got), q), got, score))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", block_rows: int = 32_768) -> DataFrame:
    """For each query its ``k`` best rows of ``vectors`` by integer inner product: query_id, rank, vec_id, score; ties go to the smaller id.

    Vectors that are not :func:`usable` and rows with a null id take no part, as query or candidate. A candidate with the query's own id does not count.
    Vectors of different lengths have no product. A candidate row that is repeated counts as often as it is there; of queries with one id and
    different vectors the smallest vector is asked. A query without candidates has no rows. Other columns are not read. Components of any size are
    scored exactly; a score that 64 bits cannot hold stops the run.

    The queries are sent to the blocks of the index, not the index to the queries: a task reads a block, then all queries as a stream, so its memory is
    one block and a batch of queries. Blocks are made smaller than ``block_rows`` where there would be fewer than cores. Each block returns at
    most ``k`` rows a query, from which the final list is ranked.
    """
    known = vectors.where(F.col(id).isNotNull() & usable(vector))
    asked = queries.where(F.col(id).isNotNull() & usable(vector)).groupBy(F.col(id).cast("long").alias("query_id")).agg(F.min(vector).alias("query"))
    spread = math.ceil(known.count() / known.sparkSession.sparkContext.defaultParallelism)
    blocks = stored(index(known, id, vector, min(block_rows, max(spread, 64))), "topk-index")
    parts = blocks.agg(F.max("part")).first()[0]
    columns = ["part", *_BLOCK.names, "query_id", "query"]
    to_all = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts or 0))))
    rows = blocks.unionByName(to_all, allowMissingColumns=True).select(*columns)
    dealt = rows.repartitionByRange((parts or 0) + 1, "part").sortWithinPartitions("part", F.col("dims").isNull())
    best = dealt.mapInArrow(_answered(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
