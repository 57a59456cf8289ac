"""Token counts of whole texts by a public tokenizer, in Arrow functions that return lengths only.

Texts are encoded in batches balanced by bytes: a long text is cut into pieces at places that no token spans, so one long text makes neither a large
batch nor a slow call, and the pieces' lengths are added up. Ids never leave the function.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.bpe import _printable
from pairwell.llm.pretokens import safe_pieces

#: The pre-tokenizing pattern of the byte-level files, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level(file: dict) -> Callable[[list[str]], list[int]] | None:
    """A faster encoder with the same vocabulary, where ids follow the order of the merges; else None."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    merges = [p if isinstance(p, list) else p.split(" ") for p in model.get("merges", [])]
    ids, plain = model["vocab"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model.get("type") != "BPE" or file.get("normalizer") or any(pre.get(k) != x for k, x in plain.items()) or model.get("ignore_merges"):
        return None
    made = [ids[a + b] for a, b in merges]
    if made != sorted(made) or len(ids) != 256 + len(set(made)):
        return None
    import tiktoken

    signs = _printable()
    specials = {t["content"]: t["id"] for t in file.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])}
    if len(specials) != len(file.get("added_tokens", [])):
        return None
    ranks = {bytes(signs[c] for c in token): i for token, i in ids.items() if token not in specials}
    coder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    return lambda texts: [len(coder.encode(x, allowed_special="all") if any(s in x for s in specials) else coder.encode_ordinary(x)) for x in texts]


@lru_cache(maxsize=2)
def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(a function from texts to their numbers of tokens, whether texts may be cut at safe places), once for each Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if fast := _byte_level(file):
        return fast, True
    import tokenizers

    whole = tokenizers.Tokenizer.from_str(json.dumps(file | {"truncation": None, "padding": None}))
    return lambda texts: [len(x) for x in whole.encode_batch(texts, add_special_tokens=False)], False


def _groups(pieces: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of at most ``limit`` bytes together, or of one longer piece."""
    at, size = 0, 0
    for i, p in enumerate(pieces):
        own = len(p) if p.isascii() else len(p.encode())
        if size and size + own > limit:
            yield at, i
            at, size = i, 0
        size += own
    if at < len(pieces):
        yield at, len(pieces)


def count_tokens(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", limit: int = 512, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), by the tokenizer file at ``path``.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids give a row each; an empty table gives none. Special strings inside a
    text count as the library counts them by default. Other columns are not read. A text is cut at a space between two signs only; one without any
    such place is encoded in one call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, may_cut = counter(path)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            pieces, owner = [], []
            for i, x in enumerate(texts):
                cut = safe_pieces(x, piece_chars) if may_cut else [x]
                pieces += cut
                owner += [i] * len(cut)
            found = [n for a, b in _groups(pieces, batch_bytes) for n in lengths(pieces[a:b])]
            n = np.bincount(np.array(owner, np.int64), weights=np.array(found, np.float64), minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
