"""Benchmark items inside documents, with edits, by a random-walk embedding of edit distance into Hamming distance and bit sampling.

The CGK walk reads a text from a place on: step j puts out the byte it stands on and moves on or stays, by a random bit for (j, byte). Texts that differ
by few edits give outputs that differ in few steps; a walk that meets no edit in its sampled steps gives the same ones. Walks start at every sign of a
document and of an item, and the sampled steps of a walk are its key. Repetition comes from the places: a window of an item's size has as many walks as
signs, and an edited copy keeps a share of their keys, all of them near one diagonal (place in the text minus place in the item). So equal keys are
counted for each item and narrow band of diagonals, which is one item-sized window of the text, and a window with enough of them is a candidate.

How many are enough is not chosen but found: for each length, copies of all items with edits at the full rate are planted in other text and searched the
same way, and the limit is what the target recall of them reaches. It grows with the length, while chance does not, so long items need few candidates.
Candidates pass a second count of the same kind, over shorter walks in their window, with a limit found alike. An exact edit distance decides.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairwell.llm.pretokens import by_bytes, column_bytes, giving_back

#: Classes of items: (from so many bytes on, steps of the counted walk, steps of the walk of the second count, bytes of a band of diagonals).
WALKS = ((80, 18, 12, 32), (40, 14, 10, 24), (16, 10, 8, 16))
#: Items below the last class are found by exact search, where they stand unedited.
SHORT = WALKS[-1][0]
#: Edited copies that pass each of the two counts when the limits are found; 0.9 of all copies are to be found.
PASSING = 0.97
#: Edited copies from which the limits are found, at least: of each item, and of all items of about one length (a tenth more or less).
ITEM_COPIES, LENGTH_COPIES = 16, 384
#: Copies of an item that are tried at once, and how many such turns one task takes.
TURN_COPIES, TASK_TURNS = 8, 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[[*range(0x09, 0x0E)]] = 0x20
#: Bits of the table that says whether some item has a key with such first bits.
SEEN_BITS = 22
CHUNK = 1 << 16


class Class(NamedTuple):
    """The items of one class: their sorted keys with item and place, a filter by first bits, and the limits of both counts by item."""

    steps: int
    second: int
    band: int
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    seen: np.ndarray
    least: np.ndarray
    least_second: np.ndarray
    seconds: list[np.ndarray | None]


class Items(NamedTuple):
    ids: list
    texts: list[bytes]
    classes: list[Class]
    short: dict[bytes, list[int]]  # text -> items


def normal(data: np.ndarray, ends: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with A-Z lowered and every run of ASCII white space one space, ``pad`` zeros after each; their starts; their ends)."""
    data = _LOWER[np.where(data == 0, 0x20, data)]
    first = np.zeros(len(data) + 1, bool)
    first[np.concatenate([[0], ends])] = True
    keep = (data != 0x20) | ~np.concatenate([[True], data[:-1] == 0x20])[: len(data)] & ~first[:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    kept, stops = data[keep], total[ends]
    out = np.zeros(len(kept) + pad * len(ends), np.uint8)
    out[np.arange(len(kept)) + pad * np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], stops])))] = kept
    starts = np.concatenate([[0], stops[:-1]])[: len(ends)] + pad * np.arange(len(ends))
    return out, starts, starts + np.diff(np.concatenate([[0], stops]))


LONGEST = WALKS[0][1]
PAD = LONGEST + 1
_BITS = np.random.default_rng(11).integers(0, 2, (LONGEST, 256), np.int32)
_BITS[:, 0] = 0  # at the end of a text the walk stays
#: Whether a step is sampled: of every run of nine all but one, so that an edit there does no harm.
_SAMPLED = np.arange(LONGEST) % 9 != 7


def places(data: np.ndarray) -> np.ndarray:
    """Where walks start: at every sign that is no space, in UTF-8."""
    return np.flatnonzero((data > 0x20) & ((data & 0xC0) != 0x80)).astype(np.int32)


def walk_keys(data: np.ndarray, at: np.ndarray, marks: set[int]) -> dict[int, np.ndarray]:
    """The keys of the walks from ``at`` after so many steps; ``data`` goes on for PAD bytes after the last place."""
    out = {m: np.empty(len(at), np.uint32) for m in marks}
    for a in range(0, len(at), CHUNK):
        here = at[a : a + CHUNK].copy()
        key, byte = np.zeros(len(here), np.uint32), np.empty(len(here), np.uint8)
        for j in range(max(marks)):
            np.take(data, here, out=byte)
            if _SAMPLED[j]:
                key *= np.uint32(0x9E3779B1)
                key += byte
            here += _BITS[j][byte]
            if j + 1 in marks:
                k = key ^ (key >> np.uint32(15))
                k *= np.uint32(0x85EBCA77)
                out[j + 1][a : a + CHUNK] = k ^ (k >> np.uint32(13))
    return out


def _bands(kind: Class, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, band, count): equal keys of each item in each two neighbouring bands of diagonals, where there are any.

    Band b holds the diagonals from b * width on, and so the windows that begin there; its neighbour takes the drift of insertions and deletions.
    """
    near = np.flatnonzero(kind.seen[keys >> np.uint32(32 - SEEN_BITS)])
    left, right = np.searchsorted(kind.keys, keys[near]), np.searchsorted(kind.keys, keys[near], "right")
    times = right - left
    rank = np.arange(times.sum()) + np.repeat(left - (np.cumsum(times) - times), times)
    shift = 1 + int(kind.offset.max(initial=0)) // kind.band
    band = (np.repeat(at[near].astype(np.int64), times) - kind.offset[rank]) // kind.band + shift
    cells, counts = np.unique(kind.item[rank].astype(np.int64) << 40 | band, return_counts=True)
    after = np.minimum(np.searchsorted(cells, cells + 1), max(len(cells) - 1, 0))
    counts = counts + np.where(cells[after] == cells + 1, counts[after], 0) if len(cells) else counts
    return cells >> 40, (cells & ((1 << 40) - 1)) - shift, counts


def _seconds(text: bytes, steps: int) -> np.ndarray:
    data = np.frombuffer(text + bytes(PAD), np.uint8)
    return np.unique(walk_keys(data, places(data[: len(text)]), {steps})[steps])


def _second_count(mine: np.ndarray, piece: np.ndarray, steps: int) -> int:
    at = places(piece)
    if not len(at):
        return 0
    keys = walk_keys(np.concatenate([piece, np.zeros(PAD, np.uint8)]), at, {steps})[steps]
    found = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
    return int((mine[found] == keys).sum()) if len(mine) else 0


def _tabled(texts: list[bytes], which: list[int], steps: int, second: int, band: int) -> Class:
    keys, item, offset = [], [], []
    for k in which:
        data = np.frombuffer(texts[k] + bytes(PAD), np.uint8)
        at = places(data[: len(texts[k])])
        at = at[at <= len(texts[k]) - steps // 2]  # about as many bytes are read
        keys.append(walk_keys(data, at, {steps})[steps])
        item.append(np.full(len(at), k, np.int32))
        offset.append(at)
    keys, item, offset = (np.concatenate(x) for x in (keys, item, offset))
    order = np.argsort(keys, kind="stable")
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[keys >> np.uint32(32 - SEEN_BITS)] = True
    none = np.zeros(len(texts), np.int64)
    seconds: list[np.ndarray | None] = [None] * len(texts)
    for k in which:
        seconds[k] = _seconds(texts[k], second)
    return Class(steps, second, band, keys[order], item[order], offset[order], seen, none, none.copy(), seconds)


def edited(rng: random.Random, text: bytes, edits: int) -> bytes:
    """``text`` with so many random edits: all kinds, or only substitutions, insertions or deletions."""
    kind = rng.choice("abcsid")
    out = bytearray(text)
    for _ in range(edits):
        how, i = kind if kind in "sid" else rng.choice("sid"), rng.randrange(len(out)) if out else 0
        sign = text[rng.randrange(len(text))]
        if how == "i" or not out:
            out.insert(i, sign)
        elif how == "d":
            del out[i]
        else:
            out[i] = sign
    return bytes(out)


def length_class(size: int) -> int:
    """One number for the class of walks and the length, to about a tenth, of an item of ``size`` bytes; -1 below the last class."""
    kind = next((i for i, (least, *_) in enumerate(WALKS) if size >= least), None)
    return -1 if kind is None else kind << 16 | round(math.log(size) / math.log(1.1))


def _turns(many: int) -> int:
    """How often the edited copies of each of so many items of one length are tried."""
    return -(-max(ITEM_COPIES, -(-LENGTH_COPIES // many)) // TURN_COPIES)


def _tried(text: bytes, turn: int, rate: float) -> Iterator[tuple[int, int, int]]:
    """(length class, 0 or 1, count) of both counts of edited copies of an item, planted in other text; they follow from the item and the turn alone."""
    size, rng = length_class(len(text)), random.Random(b"%d " % turn + text)
    _, steps, second, band = WALKS[size >> 16]
    alone = _tabled([text], [0], steps, second, band)
    for _ in range(TURN_COPIES):
        copy = edited(rng, text, int(rate * len(text)))
        before, after = (bytes(rng.choices(text, k=60)) for _ in range(2))
        data = np.frombuffer(before + b" " + copy + b" " + after + bytes(PAD), np.uint8)
        at = places(data[: len(data) - PAD])
        _, _, counts = _bands(alone, walk_keys(data, at, {steps})[steps], at)
        yield size, 0, int(counts.max(initial=0))
        yield size, 1, _second_count(alone.seconds[0], np.frombuffer(copy, np.uint8), second)


def _reached(tallies: dict[tuple[int, int, int], int]) -> dict[int, tuple[int, int]]:
    """Length class -> the limits of both counts, which PASSING of the copies reach; ``tallies`` says how many copies have each count."""
    by_count: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (size, number, value), times in tallies.items():
        by_count.setdefault((size, number), []).append((value, times))
    found = {}
    for key, pairs in by_count.items():
        values, times = zip(*sorted(pairs), strict=True)
        found[key] = values[int(np.searchsorted(np.cumsum(times), int((1 - PASSING) * (sum(times) - 1)), "right"))]
    return {size: (max(1, found[size, 0]), found[size, 1]) for size, number in found if not number}


def limits(known: DataFrame, rate: float = 0.2) -> dict[int, tuple[int, int]]:
    """Length class -> the limits of both counts for the items in column ``text``. Tasks try copies of every item; the driver gets how often each count came."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_flat(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([length_class(len(t)) for t in texts], pa.int32())], ["text", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, turn in zip(batch.column("text").to_pylist(), batch.column("turn").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*_tried(text, turn, rate), strict=True)], ["size", "number", "value"])

    items = known.select("text").mapInArrow(flat, "text binary, size int").where("size >= 0")
    many = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    if not many:
        return {}
    turns = F.create_map(*[F.lit(x) for size, n in many.items() for x in (size, _turns(n))])
    dealt = items.select("text", F.explode(F.sequence(F.lit(1), turns[F.col("size")])).alias("turn"))
    tasks = math.ceil(sum(n * _turns(n) for n in many.values()) / TASK_TURNS)
    tried = dealt.repartition(tasks, "text", "turn").mapInArrow(giving_back(run), "size int, number int, value int")
    return _reached({(r["size"], r["number"], r["value"]): r["count"] for r in tried.groupBy("size", "number", "value").count().collect()})


def _flat(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normal(raw, np.array([len(raw)]))[0].tobytes().strip()


def prepared(rows: list[tuple], rate: float = 0.2, reached: dict[int, tuple[int, int]] | None = None) -> Items:
    """The keys and limits of all items: (id, text) each. ``reached`` holds the limits of their lengths; else they are found here, from these items."""
    ids, texts = [i for i, _ in rows], [_flat(text) for _, text in rows]
    sizes = [length_class(len(text)) for text in texts]
    if reached is None:
        many = Counter(sizes)
        reached = _reached(Counter(x for text, size in zip(texts, sizes, strict=True) if size >= 0 for turn in range(1, _turns(many[size]) + 1) for x in _tried(text, turn, rate)))
    classes, longest = [], math.inf
    for least, steps, second, band in WALKS:
        which = [k for k, text in enumerate(texts) if least <= len(text) < longest]
        longest = least
        if which:
            classes.append(_tabled(texts, which, steps, second, band))
            for k in which:
                classes[-1].least[k], classes[-1].least_second[k] = reached[sizes[k]]
    short: dict[bytes, list[int]] = {}
    for k, text in enumerate(texts):
        if 0 < len(text) < SHORT:
            short.setdefault(text, []).append(k)
    return Items(ids, texts, classes, short)


def distance(item: bytes, text: bytes, most: int) -> int:
    """The least edit distance of ``item`` to any piece of ``text``, or ``most`` + 1 if it is larger: bits of one integer are a column of the table."""
    n = len(item)
    places: dict[int, int] = {}
    for i, b in enumerate(item):
        places[b] = places.get(b, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for b in text:
        equal = places.get(b, 0)
        x = equal | minus
        down = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(down | plus))
        less = plus & down
        if up & top:
            score += 1
        elif less & top:
            score -= 1
        up, less = up << 1 & full, less << 1 & full
        plus, minus = less | (full & ~(x | up)), up & x
        if score < best:
            best = score
            if not best:
                break
    return min(best, most + 1)


def _spots(items: Items, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, rate: float) -> dict[tuple[int, int], list[list[int]]]:
    """(text, item) -> runs of bytes of ``flat`` in which both counts suffice, in order and apart from each other."""
    at = places(flat)
    spots: dict[tuple[int, int], list[list[int]]] = {}
    if not len(at) or not items.classes:
        return spots
    keys = walk_keys(flat, at, {c.steps for c in items.classes})
    for kind in items.classes:
        item, band, counts = _bands(kind, keys[kind.steps], at)
        hit = counts >= kind.least[item]
        for k, b in zip(item[hit].tolist(), band[hit].tolist(), strict=True):
            size = len(items.texts[k])
            most = int(rate * size)
            low, high = b * kind.band - most, (b + 2) * kind.band + size + most
            first, last = max(int(np.searchsorted(ends, low, "right")), 0), int(np.searchsorted(starts, high))
            for t in range(first, last):
                x, y = max(int(starts[t]), low), min(int(ends[t]), high)
                runs = spots.setdefault((t, k), [])
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                elif y - x >= size - most and _second_count(kind.seconds[k], flat[x:y], kind.second) >= kind.least_second[k]:
                    runs.append([x, y])
    return spots


def found(items: Items, data: np.ndarray, offsets: np.ndarray, rate: float) -> dict[int, dict[int, int]]:
    """text -> {item: distance} of all texts in ``data`` that hold an item with at most ``rate`` edits a byte."""
    flat, starts, ends = normal(data, offsets[1:], PAD)
    out: dict[int, dict[int, int]] = {}
    for (t, k), runs in _spots(items, flat, starts, ends, rate).items():
        most = int(rate * len(items.texts[k]))
        best = min((distance(items.texts[k], flat[a:b].tobytes(), most) for a, b in runs), default=most + 1)
        if best <= most:
            out.setdefault(t, {})[k] = best
    if items.short:
        whole = flat.tobytes()
        for text, same in items.short.items():
            at = whole.find(text)
            while at >= 0:
                t = int(np.searchsorted(starts, at, "right")) - 1
                out.setdefault(t, {}).update(dict.fromkeys(same, 0))
                at = whole.find(text, int(starts[t + 1]) if t + 1 < len(starts) else len(whole))
    return out


def find(
    docs: DataFrame, benchmark: DataFrame, id: str = "item_id", item_text: str = "text", text: str = "text", out: str = "leaks", rate: float = 0.2, item_bytes: int = 4 << 20, batch_bytes: int = 1 << 20
) -> DataFrame:
    """``docs`` with a column ``out``: the items in the text, an array of (item, distance) by item, empty where there is none.

    An item is in a text if some piece of it is at an edit distance of at most ``rate`` times the item's length, both with A-Z lowered and each run of
    ASCII white space one space; lengths and edits are in bytes. Of the pieces at that limit nine in ten are found, of those with fewer edits more; what
    is found is exact. Items of under 16 bytes are found where they stand unedited; null or empty ones and those without id are never found; a null or
    empty text holds none. Repeated items are found each, repeated rows alike. An empty table of items leaves all texts clean. Every other column passes
    through; one that is called ``out`` is replaced. Texts are searched whole, and from every sign, whether a word begins there or not.

    The items' keys are broadcast: at most 20 bytes for each of ``item_bytes`` bytes of items, which are summed first. More of them are searched in
    several passes over ``docs``. The limits come from all items, whatever the passes.
    """
    known = benchmark.where(F.col(id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(id).alias("item"), F.col(item_text).alias("text"))
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, math.ceil(total / item_bytes))
    reached = limits(known, rate)
    kept = [c for c in docs.columns if c != out]
    kind = benchmark.schema[id].dataType.simpleString()
    result = docs.select(*kept).withColumn(out, F.array().cast(f"array<struct<item:{kind},distance:int>>"))
    for number in range(passes):
        rows = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number).orderBy("item", "text").collect()
        items = prepared([(r["item"], r["text"]) for r in rows], rate, reached)
        result = _marked(result, items, kept, text, out, rate, batch_bytes)
    return result


def _marked(docs: DataFrame, items: Items, kept: list[str], text: str, out: str, rate: float, batch_bytes: int) -> DataFrame:
    more = f"{out}_found"
    while more in docs.columns:
        more += "_"
    known = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(text))
            hits: dict[int, dict[int, int]] = {}
            for a, b in by_bytes(offsets, batch_bytes):
                hits |= {a + t: x for t, x in found(items, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rate).items()}
            lists = [[{"item": items.ids[k], "distance": d} for k, d in sorted(hits[i].items())] if i in hits else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*kept, out]], pa.array(lists, kinds)], [*kept, out, more])

    kinds = to_arrow_type(docs.schema[out].dataType)
    schema = docs.withColumn(more, F.col(out)).schema
    return docs.select(*kept, out).mapInArrow(giving_back(run), schema).withColumn(out, F.concat(out, more)).drop(more)
