"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The texts of a batch are split into pre-tokens, and each distinct one is encoded once. The symbols of all distinct pre-tokens lie in one flat array. A
round looks up the rank of every adjacent pair by binary search over the sorted pair keys, takes the lowest rank of each word, and merges all places of
that pair; only pairs next to a merge are looked up again. Words without a pair left leave the array.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.pretokens import by_bytes, column_bytes, giving_back, pretoken_starts

NO_RANK = np.int32(2**31 - 1)


class Vocabulary(NamedTuple):
    of_byte: np.ndarray  # byte -> id
    pairs: np.ndarray  # sorted keys (left id << 32 | right id)
    ranks: np.ndarray  # of each key
    merged: np.ndarray  # rank -> id
    data: np.ndarray  # bytes of all tokens, by id
    offsets: np.ndarray
    specials: dict[bytes, int]


def _printable() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if it is visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file of kind byte-level BPE, once for each Python worker."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    ids, signs = file["model"]["vocab"], _printable()
    pairs = [p if isinstance(p, list) else p.split(" ") for p in file["model"]["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    specials = {t["content"].encode(): t["id"] for t in file.get("added_tokens", [])}
    tokens = [b""] * (1 + max([*ids.values(), *specials.values()]))
    for token, i in ids.items():
        tokens[i] = bytes(signs[c] for c in token)
    for token, i in specials.items():
        tokens[i] = token
    of_byte = np.zeros(256, np.int64)
    for sign, b in signs.items():
        of_byte[b] = ids[sign]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    return Vocabulary(of_byte, keys[order], order.astype(np.int32), np.array([ids[a + b] for a, b in pairs], np.int64), np.frombuffer(b"".join(tokens), np.uint8), offsets, specials)


def gathered(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``data[offsets[i]:offsets[i + 1]]`` for i in ``which``, one after another, and their offsets."""
    sizes = offsets[which + 1] - offsets[which]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[which] - (ends - sizes), sizes)
    return data[at], np.concatenate([[0], ends]).astype(np.int64)


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    keys = left << 32 | right
    at = np.minimum(np.searchsorted(v.pairs, keys), max(len(v.pairs) - 1, 0))
    return np.where(v.pairs[at] == keys, v.ranks[at], NO_RANK) if len(v.pairs) else np.full(len(keys), NO_RANK)


def merge_rounds(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words whose bytes are ``data[offsets[i]:offsets[i + 1]]``."""
    sizes = np.diff(offsets)
    words = len(sizes)
    symbols = v.of_byte[data]
    owner = np.repeat(np.arange(words), sizes)
    rank = np.full(len(symbols), NO_RANK, np.int32)  # of the pair that begins here
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner] = _ranks(v, symbols[inner], symbols[inner + 1])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
        live = lowest != NO_RANK
        if not live.all():
            out.append((owner[~live], symbols[~live]))
            symbols, owner, rank, lowest = symbols[live], owner[live], rank[live], lowest[live]
            if not len(symbols):
                break
        here = rank == lowest
        at = np.flatnonzero(here)
        # Of places that overlap (a sign repeated), every other one from the left is merged.
        run = np.concatenate([[True], np.diff(at) != 1])
        at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
        symbols[at] = v.merged[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # their places after the right halves are gone
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        near = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        rank[near] = NO_RANK
        near = near[near + 1 < len(symbols)]
        near = near[owner[near] == owner[near + 1]]
        rank[near] = _ranks(v, symbols[near], symbols[near + 1])
    if not out:
        return np.zeros(0, np.int64), np.zeros(words + 1, np.int64)
    owner, symbols = (np.concatenate(x) for x in zip(*out, strict=True))
    return symbols[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=words))]).astype(np.int64)


def encode_batch(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts whose bytes are ``data[offsets[i]:offsets[i + 1]]``."""
    starts = pretoken_starts(data, offsets[1:], tuple(v.specials))
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    bounds = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    distinct = words.dictionary
    at = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].astype(np.int64)
    ids, ends = merge_rounds(v, np.frombuffer(distinct.buffers()[2], np.uint8), at)
    for special, i in v.specials.items():
        if (k := distinct.index(special).as_py()) >= 0:
            ids = np.concatenate([ids[: ends[k]], [i], ids[ends[k + 1] :]])
            ends = np.where(np.arange(len(ends)) > k, ends + 1 - (ends[k + 1] - ends[k]), ends)
    ids, to = gathered(ids, ends, words.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return ids.astype(np.uint32), to[np.searchsorted(starts, offsets)]


def decode_batch(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of runs of ids; bytes that are no UTF-8 become the replacement character."""
    data, ends = gathered(v.data, v.offsets, ids.astype(np.int64))
    raw, at = data.tobytes(), ends[offsets].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


class Coded(NamedTuple):
    """The ids of a run of texts: those of text i are ``ids[offsets[i]:offsets[i + 1]]``."""

    vocabulary: Vocabulary
    ids: np.ndarray
    offsets: np.ndarray

    def lists(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pa.array(self.ids.astype(np.int32)))

    def texts(self) -> list[str]:
        return decode_batch(self.vocabulary, self.ids, self.offsets)


def transcode(docs: DataFrame, path: str, columns: dict[str, tuple[str, Callable[[Coded], pa.Array | list]]], text: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with columns made from the ids of the whole ``text``: name -> (type, function of the ids of a run of texts).

    One pass over the rows: what is made from the ids or from the text they decode to needs no second one. A null or empty text has no ids. Every other
    column passes through as it is; one that is called like a made one is replaced. Rows are independent, so repeated rows give repeated results and an
    empty table gives none. Memory: a batch of at most ``batch_bytes`` of text, or of one longer text.
    """
    kept = [c for c in docs.columns if c not in columns]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], *[f"`{c}` {kind}" for c, (kind, _) in columns.items()]])
    inputs = kept if text in kept else [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(text))
            for a, b in by_bytes(offsets, batch_bytes):
                coded = Coded(v, *encode_batch(v, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                made = [f(coded) for _, f in columns.values()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], *[x if isinstance(x, pa.Array) else pa.array(x) for x in made]], [*kept, *columns])

    return docs.select(*inputs).mapInArrow(giving_back(run), schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>), as :func:`transcode` makes it; special strings in a text are their own ids."""
    return transcode(docs, path, {ids: ("array<int>", Coded.lists)}, text)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded", batch_ids: int = 1 << 20) -> DataFrame:
    """``docs`` with a column ``text``: what its ``ids`` stand for, special tokens included; null or no ids give an empty text."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept).withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column(ids).fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            for a, b in by_bytes(offsets - offsets[:1], batch_ids):
                texts = decode_batch(v, values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], pa.array(texts, pa.string())], [*kept, text])

    return docs.select(*kept).mapInArrow(run, schema)
