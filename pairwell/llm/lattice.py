"""Language-model score of a text as its marginal probability over all subword segmentations.

The units are the pieces of a public vocabulary file, single bytes for what no piece covers, and the words of the training texts, each a unit that spans
the whole word. A piece starts with the weight that the file's score gives it; rounds of expectation-maximisation over the training texts fit the
weights to the corpus. The sum over all segmentations into pieces is the forward recursion in log space, for all distinct words of a block at once. With
c(w) the count of a word among N training tokens and Q(w) that sum as a probability of words, a word has (1 - v) c(w) / N + v Q(w), where v is the share
of training tokens that are their word's only one; one end closes a text. Both parts add up to 1, so scores of different texts compare. The probability by
the lattice of pieces alone, in which a word has (1 - e) Q(w) and the end e, its share of the training tokens, is returned beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.pretokens import by_bytes, column_bytes
from pairwell.session import discard_stored, stored

SPACE = 0x20
#: Pseudo-counts, all pieces together, that the file's weights keep against the counts of the corpus.
PRIOR = 1000.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Pieces(NamedTuple):
    child: np.ndarray  # (node, byte) -> node of the tree of pieces, 0 for none
    ends: np.ndarray  # node -> piece that ends there, or -1
    prior: np.ndarray  # weight of each piece by the file, adding up to 1
    opens: np.ndarray  # whether a piece begins a word


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file that lower-case words can use; word starts are a space before the first letter.

    The file's scores fall by one with every rank. They are read as a rank: a piece of rank r weighs 1 / (r + 100), and a byte as the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known: dict[bytes, float] = {}
    size = model.get_piece_size()
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        text = model.id_to_piece(i).replace("▁", " ").encode()
        if not _BLANK[np.frombuffer(text[1:], np.uint8)].any() and not any(0x41 <= b <= 0x5A for b in text):
            known[text] = 1 / (100 - model.get_score(i))
    for b in range(256):
        known.setdefault(bytes([b]), 1 / (100 + size))
    child, ends = [[0] * 256], [-1]
    for number, text in enumerate(known):
        at = 0
        for b in text:
            if not child[at][b]:
                child[at][b] = len(child)
                child.append([0] * 256)
                ends.append(-1)
            at = child[at][b]
        ends[at] = number
    weights = np.array(list(known.values()))
    return Pieces(np.array(child, np.int32), np.array(ends, np.int32), weights / weights.sum(), np.array([t[0] == SPACE for t in known]))


def _groups(data: np.ndarray, offsets: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their bytes as a matrix) for words of one length at a time, a space set before each."""
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    cut = np.flatnonzero(np.diff(sizes[order])) + 1
    for same in np.split(order, cut):
        n = int(sizes[same[0]]) if len(same) else 0
        for part in np.array_split(same, max(1, len(same) * (n + 1) // cells)):
            if len(part):
                rows = np.full((len(part), n + 1), SPACE, np.uint8)
                rows[:, 1:] = data[offsets[part][:, None] + np.arange(n)]
                yield part, rows


def _arcs(p: Pieces, rows: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(end, rows, piece) of all pieces that begin at a place of the rows."""
    live = np.arange(len(rows))
    node = np.zeros(len(rows), np.int32)
    for end in range(start + 1, rows.shape[1] + 1):
        node = p.child[node, rows[live, end - 1]]
        on = node > 0
        live, node = live[on], node[on]
        if not len(live):
            return
        piece = p.ends[node]
        hit = piece >= 0
        if hit.any():
            yield end, live[hit], piece[hit]


def word_scores(p: Pieces, weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, summed over its segmentations."""
    out = np.zeros(len(offsets) - 1)
    logs = np.log(weights)
    for which, rows in _groups(data, offsets):
        forward = np.full((rows.shape[1] + 1, len(rows)), -np.inf)
        forward[0] = 0
        for start in range(rows.shape[1]):
            for end, at, piece in _arcs(p, rows, start):
                forward[end, at] = np.logaddexp(forward[end, at], forward[start, at] + logs[piece])
        out[which] = forward[-1]
    return out


def expected(p: Pieces, weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each word taken ``counts`` times, over all its segmentations."""
    out = np.zeros(len(weights))
    logs = np.log(weights)
    for which, rows in _groups(data, offsets, 1 << 18):
        n = rows.shape[1]
        forward = np.full((n + 1, len(rows)), -np.inf)
        forward[0] = 0
        arcs = []
        for start in range(n):
            arcs.append(list(_arcs(p, rows, start)))
            for end, at, piece in arcs[start]:
                forward[end, at] = np.logaddexp(forward[end, at], forward[start, at] + logs[piece])
        backward = np.full((n + 1, len(rows)), -np.inf)
        backward[n] = 0
        for start in range(n - 1, -1, -1):
            for end, at, piece in arcs[start]:
                value = backward[end, at] + logs[piece]
                backward[start, at] = np.logaddexp(backward[start, at], value)
                share = np.exp(forward[start, at] + value - forward[n, at]) * counts[which[at]]
                out += np.bincount(piece, weights=share, minlength=len(out))
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the distinct lower-case words as binary, code of every word in order, number of words of each text).

    Words are runs of bytes that are no ASCII white space; A-Z are lowered.
    """
    flat = np.insert(_LOWER[data], offsets[1:], SPACE)
    ends = offsets[1:] + np.arange(1, len(offsets))
    blank = _BLANK[flat]
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    text = np.searchsorted(ends, begin, "right")
    bounds = np.append(begin, len(flat)).astype(np.int32)
    # A word with the blanks after it is one run of the buffer; what differs only in those blanks is joined below.
    kept = ~blank | np.concatenate([[False], ~blank[:-1]])
    packed = flat[kept]
    packed[_BLANK[packed]] = SPACE
    bounds = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
    if len(begin):
        packed, bounds = packed[bounds[0] :], bounds - bounds[0]
    found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(text, minlength=len(ends))


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets


def _trimmed(words: pa.Array) -> pa.Array:
    """Words without the one space that ends each."""
    data, offsets = _flat(words)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((offsets - np.arange(len(offsets))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[data != SPACE]))])


def blocks(docs: DataFrame, id: str, text: str, trained: Column, block_bytes: int) -> DataFrame:
    """Documents in blocks of about ``block_bytes`` of text, a row each: block, words, counts (in training texts), ids, trained, sizes, codes.

    ``codes`` are the places of all words of all texts in ``words``, packed.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), trained.alias("trained"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block string, words array<string>, counts array<bigint>, ids array<{kind}>, trained array<boolean>, sizes array<int>, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in by_bytes(offsets, block_bytes):
                words, codes, sizes = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words = _trimmed(words)
                counts = np.bincount(codes[np.repeat(flags[a:b], sizes)], minlength=len(words))
                frequent = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
                place = np.empty(len(words), np.int32)
                place[frequent] = np.arange(len(words), dtype=np.int32)
                packed = zstandard.ZstdCompressor(level=1).compress(place[codes].tobytes())
                one = [[f"{task.partitionId()}-{task.taskAttemptId()}-{number}"]]
                lists = [words.take(pa.array(frequent)).cast(pa.string()), pa.array(counts[frequent]), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes.astype(np.int32))]
                cells = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array(one[0]), *cells, pa.array([packed], pa.binary())], ["block", "words", "counts", "ids", "trained", "sizes", "codes"])
                number += 1

    return rows.mapInArrow(run, schema)


def _refit(table: DataFrame, path: str, weights: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """(weights of the pieces, weight of what ends a text) after one round over the training words; what the driver gets is a number for each piece.

    Pieces spell new words, so a word counts once for each block that has it, not as often as it is said.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        total = np.zeros(len(weights))
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                n = counts.values.to_numpy(zero_copy_only=False)
                used = np.flatnonzero(n)
                data, offsets = _flat(words.values.take(pa.array(used)).cast(pa.binary()))
                total += expected(p, weights, data, offsets, np.ones(len(used)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

    sums = table.select("words", "counts").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = PRIOR * pieces(path).prior
    for r in sums:
        counts[r["piece"]] += r["n"]
    whole = counts.sum() + ends + 1
    return counts / whole, (ends + 1) / whole


def score(docs: DataFrame, path: str, trained: Column, id: str = "doc_id", text: str = "text", rounds: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score, lattice_score. ``trained`` says which rows the model learns from.

    ``score`` is the log10 probability of the text by the lattice of words and pieces, ``lattice_score`` that by the lattice of pieces alone, ``base_score``
    that by add-one counts of whole words. Tokens are the words
    and one end; ``n_known`` of them are in training texts, which have ``train_tokens``. A null or empty text is its end alone. A null id, repeated rows
    and ties need no care, as every row is scored by itself (repeated training rows count each); a null ``trained`` means false. Without training rows
    all counts are 0 and the pieces keep the file's weights. Other columns are not read.

    Words are counted a block at a time before they are exchanged, so a word as common as can be is one row a block, and its count is a window over
    those rows. A text meets its words' counts in its block again. What grows with the vocabulary is never broadcast or collected.
    """
    table = stored(blocks(docs, id, text, F.coalesce(trained, F.lit(False)), block_bytes), "lattice-blocks")
    ends = table.agg(F.coalesce(F.sum(F.size(F.filter("trained", lambda x: x))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("words")).first()
    known = pieces(path)
    weights, end = known.prior * 0.99, 0.01
    for _ in range(rounds):
        weights, end = _refit(table, path, weights, ends["n"])
    kind = dict(table.dtypes)["ids"].removeprefix("array<")[:-1]
    opening = float(weights[known.opens].sum())
    stop = np.log(opening + end) - np.log(opening)  # a word is over where the next piece opens another, or the text ends

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = word_scores(p, weights, *_flat(batch.column("words")[i].values.cast(pa.binary()))) + stop
                cell = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("block", "ids", "sizes", "codes")], cell], ["block", "ids", "sizes", "codes", "spelled"])

    scored = table.select("block", "ids", "sizes", "codes", "words").mapInArrow(lattice, f"block string, ids array<{kind}>, sizes array<int>, codes binary, spelled array<float>")
    word = table.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("block", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    same = Window.partitionBy("word")
    counted = word.select("block", "place", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("first"))

    counted = stored(counted, "lattice-counts")
    of = counted.where("first").agg(F.count(F.when(F.col("c") > 0, 1)).alias("distinct"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    tokens, distinct = ends["words"] + ends["n"], of["distinct"] + (ends["n"] > 0)
    new = (of["once"] + 1) / (tokens + 2)
    seen = (1 - new) / tokens if tokens else 0.0
    last = np.log10(seen * ends["n"] if tokens else 1 - new)
    ending = (ends["n"] + 1) / (tokens + 2)

    def known_words(left: pa.Table, right: pa.Table) -> pa.Table:
        place, c = right.column("place").to_numpy(), right.column("c").to_numpy()
        counts = np.zeros(len(c), np.int64)
        counts[place] = c
        out = []
        for i in range(left.num_rows):
            ids, sizes, spelling = (left.column(c).combine_chunks()[i].values for c in ("ids", "sizes", "spelled"))
            sizes = sizes.to_numpy()
            at = np.frombuffer(zstandard.decompress(left.column("codes")[i].as_py()), np.int32)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(divide="ignore"):
                logs = np.logaddexp(np.log(seen * counts), np.log(new) + spelling.to_numpy().astype(np.float64)) / np.log(10)
            plain = spelling.to_numpy().astype(np.float64) / np.log(10) + np.log10(1 - ending)
            sums = [np.bincount(text_of, weights=x[at], minlength=len(sizes)) for x in (counts > 0, np.log10(counts + 1.0), logs, plain)]
            values = [sizes.astype(np.int64) + 1, sums[0].astype(np.int64), sums[1], sums[2] + last, sums[3] + np.log10(ending)]
            out.append(pa.table([ids, *map(pa.array, values)], ["id", "n_tokens", "n_known", "logs", "score", "lattice_score"]))
        return pa.concat_tables(out) if out else _EMPTY

    _EMPTY = pa.table({"id": pa.array([], pa.null()), "n_tokens": [], "n_known": [], "logs": [], "score": [], "lattice_score": []})
    rows = scored.groupBy("block").cogroup(counted.select("block", "place", "c").groupBy("block")).applyInArrow(known_words, f"id {kind}, n_tokens long, n_known long, logs double, score double, lattice_score double")
    rows = stored(rows, "lattice-rows")
    discard_stored(table, counted)
    base = F.col("logs") + F.log10(F.lit(ends["n"] + 1.0)) - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))
    return rows.select(
        F.col("id").alias("doc_id"), "n_tokens", (F.col("n_known") + (1 if ends["n"] else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "lattice_score",
    )
