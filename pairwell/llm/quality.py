"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A text is the average of learned vectors of its features: each word, each pair of words in a row, and each run of 3 to 5 bytes inside a word with its
edges, hashed to a row of one table. A softmax layer gives the class. Since the layer is linear in the average, scoring needs one number per row of the
table: the difference of the two classes' logits, looked up for every feature of every whole text and averaged.

Training sees all labelled texts, whole ones. They are dealt to parts of bounded size, a task learns a model from each, and the average of their tables
and biases is the model whose logit is the average of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.pretokens import by_bytes, column_bytes, giving_back
from pairwell.session import discard_stored, shuffles_freed, stored

SIZES = (3, 4, 5)
MIX = np.uint32(0x9E3779B1)
REPEAT = np.uint32(0x2545F491)
#: Bytes of the texts of either class that one task learns from, about, and numbers of a model that are added up at once.
PART_BYTES, BLOCK = 16 << 20, 1024
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Model(NamedTuple):
    table: np.ndarray  # one number per hashed feature: logit of label 1 less that of label 0
    bias: float
    bits: int
    vectors: np.ndarray | None  # of one model, not of an average
    weights: np.ndarray | None


def features(data: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, the text each is of) of texts that lie one after another in ``data`` and end at ``ends``.

    Words are runs of bytes that are no ASCII white space. A word's edges belong to its runs of bytes, so "<th" differs from "th" inside a word.
    """
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # A blank before and after every text: its first and last words have edges of their own.
    flat = np.insert(data, np.sort(np.concatenate([[0], ends[:-1], ends])), 0x20)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])) + 2)
    blank = _BLANK[flat]
    value = np.where(blank, 0, flat.astype(np.uint32) + 1)
    shift = np.uint32(32 - bits)
    found, of = [], []
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    # Whole words: a polynomial of the bytes modulo 2^32, from running sums of byte * odd power.
    power = np.cumprod(np.full(min(len(flat), 1 << 16), MIX, np.uint32), dtype=np.uint32)
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(flat)]])))
    sums = np.concatenate([[0], np.cumsum(value * power[place % len(power)], dtype=np.uint32)]).astype(np.uint32)
    words, text_of = sums[end] - sums[begin], owner[begin]
    found.append(((words ^ np.uint32(0x5BD1E995)) * MIX) >> shift)
    of.append(text_of)
    # Pairs of words in a row. A word said twice is one feature for all words, so that stammering can be learned from any of them.
    beside = np.flatnonzero(text_of[1:] == text_of[:-1])
    pair = np.where(words[beside] == words[beside + 1], REPEAT, words[beside] * MIX + words[beside + 1])
    found.append((pair * MIX) >> shift)
    of.append(text_of[beside])
    # Runs of n bytes: at least one byte of a word, blanks only at the edges.
    window = value.copy()
    inside = np.ones(len(flat), bool)
    for n in range(2, max(SIZES) + 1):
        if len(flat) < n:
            break
        window = window[:-1] * MIX + value[n - 1 :] + np.uint32(n)
        inside = inside[:-1] & ~blank[n - 2 : len(flat) - 1] if n > 2 else inside[:-1]
        if n in SIZES:
            at = np.flatnonzero(inside)
            found.append((window[at] * MIX) >> shift)
            of.append(owner[at])
    return np.concatenate(found), np.concatenate(of)


def train(texts: list[str], labels: list[int], bits: int = 16, dim: int = 8, epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 7) -> Model:
    """Fit vectors and softmax layer on labelled texts; the same input in the same order gives the same model.

    Classes are weighted by the square root of their rarity. Without texts of both classes the model is a constant: the share of label 1, or 1/2.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    weights = np.zeros((2, dim), np.float32)
    y = np.array(labels, np.int64)
    share = y.mean() if len(y) else 0.5
    bias = np.zeros(2, np.float32)
    if len(np.unique(y)) < 2:
        share = min(max(float(share), 0.01), 0.99)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits, vectors, weights)
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, n = np.unique(features(data, np.array([len(data)]), bits)[0], return_counts=True)
        bags.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    cost = np.sqrt(len(y) / (2 * np.bincount(y, minlength=2))).astype(np.float32)
    steps, done = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            step = rate * (1 - done / steps)
            done += 1
            for i in order[at : at + batch]:
                ids, n = bags[i]
                rows = vectors[ids]
                hidden = n @ rows if len(ids) else np.zeros(dim, np.float32)
                logits = weights @ hidden + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y[i]] -= 1
                p *= cost[y[i]] * step
                back = weights.T @ p
                weights -= np.outer(p, hidden)
                bias -= 0.1 * p
                # The average spreads the gradient over all features; the step on a vector is scaled back by the share of distinct ones.
                vectors[ids] = rows - np.outer(n * min(len(ids), 64), back)
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]), bits, vectors, weights)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ids, of = features(data, offsets[1:], model.bits)
    n = np.bincount(of, minlength=len(offsets) - 1)
    logit = np.bincount(of, weights=model.table[ids], minlength=len(offsets) - 1) / np.maximum(n, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def labelled(docs: DataFrame, labels: DataFrame, bound: int, max_bytes: int, id: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts of either class, those whose ids hash lowest, so every document has the same chance; :func:`fitted` takes all instead.

    A text of over ``max_bytes`` is no example (it is scored like any other), so the sample has at most ``2 * bound * max_bytes`` bytes.
    An id may be a number or a text. Rows without id or label do not count; of labels that disagree on an id the lowest counts; repeated documents count once.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(label).cast("int").alias("label"))
    ranked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(bound) for k in (0, 1)]
    picked = ranked[0].unionByName(ranked[1])
    texts = docs.where(F.col(id).isNotNull() & (F.coalesce(F.octet_length(text), F.lit(0)) <= max_bytes)).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = F.broadcast(picked).join(texts, "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (hash_order(r["id"]), r["id"]))]


def hash_order(x: object) -> int:
    """A place for an id: whole numbers and texts alike are told by their value, whatever the order of the rows."""
    n = x if isinstance(x, int) else int.from_bytes(hashlib.sha256(str(x).encode()).digest()[:8], "little")
    return n * 0x9E3779B97F4A7C15 % (1 << 64)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", batch_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text in column ``out`` (replaced if there is one).

    A null or empty text, or one of white space only, has no features: its score is the model's bias. Rows are scored one by one, so nulls elsewhere,
    repeated rows and empty tables need no care. The model, a table of 2^bits numbers, goes to the workers with the function.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).withColumn(out, F.lit(0.0)).schema
    small = model._replace(vectors=None, weights=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(text))
            found = [scores(small, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in by_bytes(offsets, batch_bytes)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.concatenate(found) if found else np.zeros(0))], [*kept, out])

    return docs.select(*kept).mapInArrow(giving_back(run), schema)


def held_out(id: Column) -> Column:
    """The fold that is never learned from: every fifth document by the CRC of its id as text; a null id is held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def examples(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, label, text) of every labelled document, whole. Which rows count is as in :func:`labelled`."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(label).cast("int").alias("label"))
    texts = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return known.join(texts, "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def dealt(rows: DataFrame, bound: int, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(``rows`` of :func:`examples` with a column ``part``, the number of parts): each has about ``bound`` texts and at most about ``part_bytes`` of either class.

    The larger class is cut into as many pieces as there are parts. The other one has fewer pieces, and each goes to several parts, so that all parts
    have the same share of it: every example is in some part, and one of few is in many.
    """
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    cuts = {r["label"]: max(1, -(-r["n"] // bound), -(-r["bytes"] // part_bytes)) for r in found}
    parts = max(cuts.values(), default=0)
    pieces = F.when(F.col("label") == 0, F.lit(cuts.get(0, 1))).otherwise(F.lit(cuts.get(1, 1))).cast("long")
    places = F.sequence(F.pmod(F.xxhash64("id"), pieces), F.lit(parts - 1).cast("long"), pieces)
    return rows.select("*", F.explode(places).alias("part")) if parts else rows.withColumn("part", F.lit(0).cast("long")), parts


def average(rows: DataFrame, parts: int) -> Model:
    """The average of the models that tasks learn from each part of ``rows`` (id, label, text, part): its logit is the average of theirs.

    A model goes to the shuffle in blocks, which are added up one by one; the driver gets the average alone.
    """

    def learn(rows: pa.Table) -> pa.Table:
        ids, texts, labels = (rows.column(c).to_pylist() for c in ("id", "text", "label"))
        order = sorted(range(len(ids)), key=lambda i: (hash_order(ids[i]), ids[i]))
        model = train([texts[i] for i in order], [labels[i] for i in order])
        blocks = [model.table[at : at + BLOCK].astype("<f4").tobytes() for at in range(0, len(model.table), BLOCK)]
        n = len(blocks)
        return pa.table({"block": pa.array(range(n), pa.int32()), "part": rows.column("part").combine_chunks().take([0] * n), "bias": [model.bias] * n, "numbers": pa.array(blocks, pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")  # sums do not depend on the order of arrival
        total = sum(np.frombuffer(x.as_py(), "<f4").astype("<f8") for x in rows.column("numbers"))
        return pa.table({"block": rows.column("block").slice(0, 1), "n": pa.array([len(rows)], pa.int64()), "bias": [sum(rows.column("bias").to_pylist())], "numbers": pa.array([total.tobytes()], pa.binary())})

    learned = rows.repartition(parts, "part").groupBy("part").applyInArrow(learn, "block int, part long, bias double, numbers binary")
    blocks = learned.groupBy("block").applyInArrow(add, "block int, n long, bias double, numbers binary").orderBy("block").collect()
    table = np.concatenate([np.frombuffer(r["numbers"], "<f8") / r["n"] for r in blocks]).astype(np.float32)
    return Model(table, blocks[0]["bias"] / blocks[0]["n"], len(table).bit_length() - 1, None, None)


def fitted(docs: DataFrame, labels: DataFrame, bound: int = 1000, part_bytes: int = PART_BYTES, label: str = "quality") -> Model:
    """The model learned from all labelled documents that are not held out, whole ones: the average over parts of about ``bound`` documents of either class."""
    # The join moves the texts of all documents, learning those of the labelled ones again: the files of one go before the other begins.
    with shuffles_freed(docs.sparkSession):
        kept = stored(examples(docs, labels.where(~held_out(F.col("doc_id"))), label=label), "quality-examples")
        rows, parts = dealt(kept, bound, part_bytes)
        model = average(rows, parts) if parts else train([], [])
        discard_stored(kept)
    return model
