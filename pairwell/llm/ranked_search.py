"""Ranked lexical search turned round: the items are indexed, the documents are streamed through the index.

The items' terms make an inverted index (term -> items with the number of repeats), which goes to every task. One pass over the documents counts the
terms that some item has, document by document, and the corpus figures; a second one, over those counts, expands each count along its term's list,
adds up scores, and keeps the best documents of each item in a bounded heap. The heaps of the tasks are merged in groups of bounded size.

The index is bounded: items are searched in groups of about ``item_bytes`` of text and 65,536 items at most, one pass a group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.bpe import gathered
from pairwell.llm.pretokens import by_bytes, column_bytes
from pairwell.session import discard_stored, stored

#: Parameters of the ranking: scale of a term's weight, of its saturation, and of its length part.
WEIGHT, SCALE, TF, LENGTH, BASE, SHARE = 1000, 1_000_000_000, 1000, 12, 100, 25
#: Tasks whose heaps are merged at a time.
FAN_IN = 256
#: Scores up to this are exact as doubles.
EXACT = 1 << 53
#: Scores that a task adds up at a time, and items of one pass.
CELLS, ITEMS = 1 << 21, 1 << 16

_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of the term of each place, terms of each text) of texts whose bytes are ``data[offsets[i]:offsets[i + 1]]``.

    A term is a maximal run of ASCII letters, digits and bytes beyond ASCII, A-Z lowered.
    """
    sign = _SIGN[data]
    starts = sign.copy()
    starts[1:] &= ~sign[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = sign[edges]
    first = np.flatnonzero(starts)
    stops = np.append(~sign, True)
    stops[edges] = True
    ends = np.flatnonzero(stops)
    last = ends[np.searchsorted(ends, first, "right")]
    bounds = np.empty(2 * len(first), np.int64)
    bounds[0::2], bounds[1::2] = first, last
    text, at = gathered(_LOWER[data], np.append(bounds, len(data)), np.arange(0, 2 * len(first), 2))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.searchsorted(first, offsets))


class Index(NamedTuple):
    """The items of one group: their ids, the sorted terms, and for term t the items ``item[lists[t]:lists[t + 1]]`` with their repeats."""

    ids: list
    terms: pa.Array
    lists: np.ndarray
    item: np.ndarray
    times: np.ndarray


def indexed(items: list[tuple[int, str | None]]) -> Index:
    posts: dict[bytes, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(items):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        found, places, _ = terms(raw, np.array([0, len(raw)]))
        for t, n in Counter(places.tolist()).items():
            posts.setdefault(found[t].as_py(), []).append((i, n))
    names = sorted(posts)
    flat = np.array([p for t in names for p in posts[t]], np.int64).reshape(-1, 2)
    lists = np.concatenate([[0], np.cumsum([len(posts[t]) for t in names])]).astype(np.int64)
    return Index([i for i, _ in items], pa.array(names, pa.large_binary()), lists, flat[:, 0].copy(), flat[:, 1].copy())


def _counted(docs: DataFrame, names: pa.Array, batch_bytes: int) -> DataFrame:
    """Per document with a term: doc_id, n (its terms), terms and tf (of those in ``names``); per task one row more, without n, whose tf are document counts."""
    count = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, kind = np.zeros(count, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            data, offsets = column_bytes(batch.column(1))
            for a, b in by_bytes(offsets, batch_bytes):
                found, places, sizes = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                known = pc.index_in(found, names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                code, text = known[places], np.repeat(np.arange(b - a), sizes)
                keys, tf = np.unique(text[code >= 0] * count + code[code >= 0], return_counts=True)
                text, code = keys // max(count, 1), keys % max(count, 1)
                holding += np.bincount(code, minlength=count)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (code, tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])
                yield rows.filter(pa.array(sizes > 0))
        if kind is not None:
            at = np.flatnonzero(holding)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (at, holding[at])]], ["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


class Heaps:
    """The best ``k`` (score, document) of each item, by score, then by smaller document."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)  # a document needs this score to get in
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def push(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        in_ = score >= self.floor[item]
        item, score, doc = (np.concatenate(x) for x in ((self.item, item[in_]), (self.score, score[in_]), (self.doc, doc[in_])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.floor[item[place == self.k - 1]] = score[place == self.k - 1]
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def _best(counted: DataFrame, index: Index, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Per task and item the best ``k`` documents: part, item (its number), doc_id, score."""
    most = np.zeros(len(index.ids))
    np.add.at(most, index.item, np.repeat(weight, np.diff(index.lists)) * (SCALE / TF) * index.times)
    exact = bool((most < EXACT).all())
    items = len(index.ids)
    step = max(1, CELLS // max(items, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, none = Heaps(items, k), np.iinfo(np.int64).max
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                doc, n = batch.column(0).fill_null(none).to_numpy(), batch.column(1).to_numpy()
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy()[: len(lists) + 1])
                term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64)
                m = BASE - SHARE + SHARE * n * n_docs // n_terms
                row = np.repeat(np.arange(len(n)), sizes)
                worth = weight[term] * (SCALE * tf // (TF * tf + LENGTH * m[row]))
                # Along the lists of the terms, a bounded stretch of places at a time.
                spread = np.diff(index.lists)[term]
                ends = np.cumsum(spread)
                score = np.zeros(len(n) * items, np.float64 if exact else np.int64)
                a = 0
                while a < len(term):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
                    place = np.arange(ends[b - 1] - (ends[a - 1] if a else 0)) + np.repeat(index.lists[term[a:b]] - (ends[a:b] - spread[a:b]) + (ends[a - 1] if a else 0), spread[a:b])
                    to = np.repeat(row[a:b], spread[a:b]) * items + index.item[place]
                    gain = np.repeat(worth[a:b], spread[a:b]) * index.times[place]
                    if exact:
                        score += np.bincount(to, gain, len(score))
                    else:
                        np.add.at(score, to, gain)
                    a = b
                hit = np.flatnonzero(score >= np.tile(heaps.floor, len(n)))
                heaps.push(hit % items, score[hit].astype(np.int64), doc[hit // items])
        part = TaskContext.get().partitionId()
        docs = pa.array(heaps.doc, mask=heaps.doc == none)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heaps.item), part, np.int64)), pa.array(heaps.item), docs, pa.array(heaps.score)], ["part", "item", "doc_id", "score"])

    return counted.where("n is not null").mapInArrow(run, "part long, item long, doc_id long, score long")


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score): heaps merged by groups of FAN_IN tasks until one is left."""
    while True:
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        parts = heaps.agg(F.max("part")).first()[0]
        if parts is None or parts < FAN_IN:
            return heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        group = F.floor(F.col("part") / FAN_IN).cast("long")
        ranked = heaps.withColumn("part", group).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
        smaller = stored(ranked.where(F.col("rank") <= k).drop("rank"), "search-heaps")
        discard_stored(heaps)
        heaps = smaller


def search(docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = 4 << 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """Per item the ``k`` documents of highest score above 0: item_id, rank (from 1), doc_id, score. Equal scores go by smaller doc_id, a null one last.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. A document's score sums over the item's terms, repeats included,
    w * ((10^9 * tf) div (1000 * tf + 12 * m)); w is floor(1000 * ln((2N + 2) / (2df + 1))) and m is 100 - 25 + ((25 * n * N) div L), with N documents
    that have a term, L terms in all, n in the document, df documents with the term. All figures are of all documents.

    A null or empty text has no terms: such a document is not counted, such an item finds nothing. Repeated documents rank one by one; items that are
    equal in id and text are one item. Empty tables give no rows. Other columns are not read. An id of documents is a whole number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    given = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("octet_length(text) > 0").distinct()
    kind = given.schema["item_id"].dataType.simpleString()
    size = given.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    groups = max(math.ceil((size["bytes"] or 0) / item_bytes), math.ceil(size["n"] / ITEMS))
    given = stored(given.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(groups, 1)))), "search-items")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for g in range(groups):
        index = indexed([tuple(r) for r in given.where(F.col("group") == g).select("item_id", "text").orderBy("item_id", "text").collect()])
        counted = stored(_counted(rows, index.terms, batch_bytes), "search-counts")
        known = counted.agg(F.count("n").alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(index.terms), np.int64)
        for r in counted.where("n is null").select(F.explode(F.arrays_zip("terms", "tf")).alias("e")).groupBy("e.terms").agg(F.sum("e.tf").alias("n")).collect():
            df[r["terms"]] = r["n"]
        weight = np.array([math.floor(WEIGHT * math.log((2 * known["docs"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        heaps = stored(_best(counted, index, weight, known["docs"], known["terms"] or 1, k), "search-heaps")
        discard_stored(counted)
        best = _merged(heaps, k)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(index.ids)], f"item long, item_id {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
