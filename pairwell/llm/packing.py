"""Packing of documents into token sequences of several context sizes (tiers), full to the last place.

A document's tokens, closed by an end token, are cut into whole windows of the longest tier; what remains goes to the tier of the smallest window that
holds it. Tiers are packed from the longest down: the longest piece left opens a window of its tier, and the gap behind it is filled by the longest piece
that fits, which comes from a shorter tier. Only where no piece fits is one cut. So windows are full, and documents are cut about once each at most.

Every task packs its own documents, a block of tokens at a time, and hands on what is left, less than one long window. The remains of up to ``fan_in``
tasks are packed together, and so on; the last remains fill windows of shorter tiers, and less than the smallest tier is padded, once for all documents.
Sequences are then dealt to step groups, each of one tier and of the same number of tokens, in turns by their attention cost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.bpe import encode_batch, vocabulary
from pairwell.llm.pretokens import by_bytes, column_bytes
from pairwell.session import discard_stored, stored
from pairwell.skew import rank_within

TIERS = (256, 512, 1024, 2048)
#: Bits of a sequence's number inside its task or group, and of the number of that task or group.
COUNT_BITS, GROUP_BITS = 28, 28
NAMES = ["row", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window"]

#: A column made of the pieces' tokens: (type, function from a list of token arrays to an Arrow array of that type).
Made = dict[str, tuple[str, Callable[[list[np.ndarray]], pa.Array]]]


class Piece(NamedTuple):
    row: int
    doc_id: object
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:at]), self._replace(start=self.start + at, ids=self.ids[at:])


class Pool:
    """Pieces by length, none longer than the longest tier."""

    def __init__(self, longest: int):
        self.by_length: list[list[Piece]] = [[] for _ in range(longest + 1)]
        self.lengths = 0  # a bit for each length that is there
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        if n:
            self.by_length[n].append(piece)
            self.lengths |= 1 << n
            self.tokens += n

    def take(self, length: int) -> Piece:
        at = self.by_length[length]
        piece = at.pop()
        if not at:
            self.lengths ^= 1 << length
        self.tokens -= length
        return piece

    def longest(self, most: int) -> int:
        """The greatest length that is there and at most ``most``; 0 if there is none."""
        return max((self.lengths & ((2 << most) - 1)).bit_length() - 1, 0)

    def next(self, gap: int) -> Piece:
        """The longest piece of at most ``gap`` tokens, else the head of the shortest longer one."""
        if n := self.longest(gap):
            return self.take(n)
        above = self.lengths >> gap
        head, tail = self.take(gap + (above & -above).bit_length() - 1).cut(gap)
        self.put(tail)
        return head


class Packer:
    """Sequences as rows: pieces with their place. ``base`` is added to the numbers of sequences."""

    def __init__(self, tiers: tuple[int, ...], base: int):
        self.tiers, self.base, self.count = tiers, base, 0
        self.pool = Pool(tiers[-1])
        self.placed: list[tuple[Piece, int, int, int]] = []  # piece, sequence, offset, window

    def close(self, pieces: list[Piece], window: int) -> None:
        offset = 0
        for p in pieces:
            self.placed.append((p, self.base + self.count, offset, window))
            offset += len(p.ids)
        self.count += 1

    def add(self, piece: Piece) -> None:
        """Whole long windows stand alone, the rest is routed to its tier."""
        while len(piece.ids) >= self.tiers[-1]:
            head, piece = piece.cut(self.tiers[-1])
            self.close([head], self.tiers[-1])
        self.pool.put(piece)

    def fill(self, window: int) -> None:
        pieces, gap = [], window
        while gap:
            pieces.append(self.pool.next(gap))
            gap -= len(pieces[-1].ids)
        self.close(pieces, window)

    def pack(self, keep: int) -> None:
        """Fill windows until the pool holds less than ``keep`` tokens, or less than the longest tier."""
        while self.pool.tokens >= max(keep, self.tiers[-1]):
            opening = self.pool.longest(self.tiers[-1])
            self.fill(next(w for w in self.tiers if w >= opening))

    def finish(self) -> None:
        """Use up the pool: windows of shorter tiers, then one sequence that is padded."""
        self.pack(0)
        for window in reversed(self.tiers):
            while self.pool.tokens >= window:
                self.fill(window)
        if self.pool.tokens:
            self.fill(self.pool.tokens)

    def rest(self) -> list[Piece]:
        """What is in the pool, which is empty then; the order follows from the pieces' lengths."""
        left = []
        while n := self.pool.longest(self.tiers[-1]):
            left.append(self.pool.take(n))
        return left

    def rows(self) -> list[tuple[Piece, int, int, int]]:
        placed, self.placed = self.placed, []
        return placed


def _little(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())


#: The tokens of a piece as little-endian unsigned 32-bit integers.
TOKENS: Made = {"ids": ("binary", _little)}


def _record(placed: list, left: list[Piece], part: int, made: Made, kind: pa.DataType) -> pa.RecordBatch:
    """Placed pieces with their columns, and open pieces with their tokens, which have no sequence yet."""
    pieces = [p[0] for p in placed]
    rows = [(p.row, p.doc_id, p.start, len(p.ids), p.doc_tokens, s, o, w) for p, s, o, w in placed] + [(p.row, p.doc_id, p.start, len(p.ids), p.doc_tokens, None, None, None) for p in left]
    kinds = [pa.int64(), kind, *[pa.int64()] * (len(NAMES) - 2)]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
    for _, f in made.values():
        got = f([p.ids for p in pieces])
        columns.append(pa.concat_arrays([got, pa.nulls(len(left), got.type)]))
    carried = pa.concat_arrays([pa.nulls(len(placed), pa.binary()), _little([p.ids for p in left])])
    columns += [carried, pa.array([part] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*NAMES, *made, "carried", "part"])


def _merging(tiers: tuple[int, ...], made: Made, last: bool, base: int) -> Callable[[pa.Table], pa.Table]:
    """The function that packs the remains of one group of tasks, and with ``last`` leaves nothing open."""

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.sort_by([("part", "ascending"), ("row", "ascending"), ("start", "ascending")])
        packer = Packer(tiers, base + (group << COUNT_BITS))
        for row, doc, start, n, carried in zip(*(table.column(c).to_pylist() for c in ("row", "doc_id", "start", "doc_tokens", "carried")), strict=True):
            packer.add(Piece(row, doc, start, n, np.frombuffer(carried, "<u4")))
        packer.finish() if last else packer.pack(0)
        return pa.Table.from_batches([_record(packer.rows(), packer.rest(), group, made, table.schema.field("doc_id").type)])

    return run


def pack(
    docs: DataFrame, path: str, end: int = 1, tiers: tuple[int, ...] = TIERS, made: Made = TOKENS, id: str = "doc_id", text: str = "text",
    block_tokens: int = 1 << 20, batch_bytes: int = 4 << 20, fan_in: int = 64,
) -> DataFrame:
    """The pieces of all documents: doc_id, row, start, length, doc_tokens, sequence_id, offset, window, and the columns ``made`` of their tokens.

    A document is the tokens of its whole text by the byte-level BPE file at ``path``, then ``end``. ``start`` counts the document's tokens before the
    piece, ``doc_tokens`` all of them; ``offset`` is the piece's place in its sequence, without gaps. ``window`` is the length of the sequence, one of
    ``tiers`` for all but one of them. ``row`` numbers the rows of ``docs``, so repeated rows and null ids are told apart; each is a document of its own.
    A null or empty text is its end token alone. An empty table has no pieces. Other columns are not read.

    The input is read once, as it is partitioned. A task holds ``block_tokens`` and one document at a time; ``fan_in`` tasks' remains are less than
    ``fan_in`` long windows. A task that runs again packs the same pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(["row long", f"doc_id {kind}", *[f"{c} long" for c in NAMES[2:]], *[f"`{c}` {t}" for c, (t, _) in made.items()], "carried binary", "part long"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part = vocabulary(path), TaskContext.get().partitionId()
        packer, arrow, since = Packer(tiers, part << COUNT_BITS), None, 0
        for batch in batches:
            arrow = batch.column(1).type
            numbers, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = column_bytes(batch.column(2))
            for a, b in by_bytes(offsets, batch_bytes):
                tokens, at = encode_batch(v, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i in range(a, b):
                    own = np.append(tokens[at[i - a] : at[i - a + 1]], np.uint32(end))
                    packer.add(Piece(numbers[i], ids[i], 0, len(own), own))
                since += len(tokens) + b - a
                if since >= block_tokens:
                    # The last part of a block waits for shorter pieces of the next one.
                    packer.pack(block_tokens // 16)
                    since = 0
                if packer.placed:
                    yield _record(packer.rows(), [], part, made, arrow)
        if arrow is not None:
            packer.pack(0)
            yield _record(packer.rows(), packer.rest(), part, made, arrow)

    found = stored(rows.mapInArrow(encoded, schema), "pack-pieces")
    closed, level = [found.where("carried is null")], 0
    rest = found.where("carried is not null")
    while (parts := rest.agg(F.max("part")).first()[0]) is not None:
        level += 1
        last = parts < fan_in
        groups = rest.select("row", "doc_id", "start", "doc_tokens", "carried", "part", F.floor(F.col("part") / fan_in).cast("long").alias("group"))
        more = stored(groups.groupBy("group").applyInArrow(_merging(tiers, made, last, level << (COUNT_BITS + GROUP_BITS)), schema), "pack-pieces")
        closed.append(more.where("carried is null"))
        rest = more.where("carried is not null")
        if last:
            break
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.select("doc_id", "row", "start", "length", "doc_tokens", "sequence_id", "offset", "window", *made)


def step_groups(pieces: DataFrame, step_tokens: int = 1 << 15) -> DataFrame:
    """(sequence_id, window, cost, step): sequences dealt to training steps of one window and ``step_tokens`` tokens each.

    The cost of a sequence is the sum of its pieces' squared lengths, as attention inside documents has. In each tier the sequences go to the steps in
    turns by falling cost, every other turn backwards, so a tier's steps have nearly the same cost; only the last turn may leave steps short. Steps are
    numbered from 0, the longest tier first. No pieces give no steps.
    """
    whole = pieces.groupBy("sequence_id").agg(F.max("window").alias("window"), F.sum(F.col("length") * F.col("length")).alias("cost"))
    whole = stored(whole.withColumn("order", -F.col("cost")), "pack-sequences")
    sizes = sorted(((r["window"], r["n"]) for r in whole.groupBy("window").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    ranked = rank_within(whole, ["window"], ["order", "sequence_id"], "place")
    step, first = F.lit(None).cast("long"), 0
    for window, n in sizes:
        steps = math.ceil(n * window / step_tokens)
        turn, at = F.floor((F.col("place") - 1) / steps), (F.col("place") - 1) % steps
        step = F.when(F.col("window") == window, first + F.when(turn % 2 == 0, at).otherwise(steps - 1 - at)).otherwise(step)
        first += steps
    out = stored(ranked.select("sequence_id", "window", "cost", step.cast("long").alias("step")), "pack-steps")
    discard_stored(whole)
    return out
