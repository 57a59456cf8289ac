"""Splitting UTF-8 text into pre-tokens and byte chunks with numpy, for many texts in one buffer.

The rule is the usual one of byte-level BPE: contractions, runs of letters, of numbers and of other signs, each with the one space before it, and runs
of white space, of which the last one before a sign stands apart. It is stated on classes of characters: runs begin where the class changes, and only
the edges of white space and the apostrophes need a second look. No loop runs over characters or words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
#: What may follow an apostrophe as one token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_KINDS = ((LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s")))
_TABLE = np.full(0x110000, UNKNOWN, np.uint8)


def _kinds(points: np.ndarray) -> np.ndarray:
    """The class of each code point; those not met before are looked up once."""
    found = _TABLE[points]
    if (new := np.unique(points[found == UNKNOWN])).size:
        for p in new.tolist():
            _TABLE[p] = next((k for k, rule in _KINDS if rule.match(chr(p))), OTHER)
        found = _TABLE[points]
    return found


_ASCII = _kinds(np.arange(128))


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kinds = _ASCII[data & 0x7F]
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        first = data[lead].astype(np.int32)
        more = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) & 0x3F for i in (1, 2, 3)]
        two, three = first < 0xE0, first < 0xF0
        points = np.where(
            two,
            (first & 0x1F) << 6 | more[0],
            np.where(three, (first & 0x0F) << 12 | more[0] << 6 | more[1], (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]),
        )
        found = _kinds(points)
        kinds[lead] = kinds[lead + 1] = found
        kinds[lead[~two] + 2] = found[~two]
        kinds[lead[~three] + 3] = found[~three]
    return kinds


def pretoken_starts(data: np.ndarray, ends: np.ndarray, specials: tuple[bytes, ...] = ()) -> np.ndarray:
    """Offsets at which pre-tokens start, for texts that lie one after another in ``data`` and end at ``ends``.

    ``specials`` are cut out first, each a pre-token of its own; the text on either side of one is split as a text by itself.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)  # where a text, or a piece between special strings, begins
    edge[0] = edge[n] = True
    edge[ends] = True
    held = [m.span() for m in regex.finditer(b"|".join(map(regex.escape, sorted(specials, key=len, reverse=True))), data.tobytes())] if specials else []
    held = [(a, b) for a, b in held if not edge[a + 1 : b].any()]
    for a, b in held:
        edge[a] = edge[b] = True
    kinds = byte_kinds(data)
    starts = edge[:n].copy()
    starts[1:] |= kinds[1:] != kinds[:-1]

    # White space before a sign of the same piece: its last character stands apart, and goes with the sign if it is a plain space.
    sign = np.flatnonzero(starts[1:] & ~edge[1:n] & (kinds[:-1] == SPACE)) + 1
    last = sign - 1
    while (inner := (data[last] & 0xC0) == 0x80).any():
        last = last - inner
    starts[last] = True
    starts[sign[data[last] == 0x20]] = False

    # An apostrophe that begins a token and meets letters at once.
    mark = np.flatnonzero((data[:-1] == 0x27) & starts[:-1] & ~edge[1:n] & (kinds[1:] == LETTER))
    for word in CONTRACTIONS:
        size = len(word)
        at = mark[mark + size < n]
        fits = np.ones(len(at), bool)
        for i, letter in enumerate(word.encode(), 1):
            fits &= (data[at + i] == letter) & ~edge[at + i]
        at = at[fits]
        starts[at + 1] = False
        after = at + 1 + size
        after = after[after < n]
        starts[after] |= kinds[after] == LETTER
    for a, b in held:
        starts[a + 1 : b] = False
    return np.flatnonzero(starts)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts of a string column, offsets of the texts in them); nulls count as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] if len(offsets) else 0 : offsets[-1] if len(offsets) else 0]
    return data, offsets - offsets[:1]


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker returns to the system what it has freed: it stays, idle, while later stages need the executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
        if trim:
            trim(0)

    return wrapped


def by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one longer row; ``offsets`` as of :func:`column_bytes`."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def safe_pieces(text: str, size: int) -> list[str]:
    """``text`` cut into pieces of about ``size`` characters, each before a space between two other signs: no pre-token spans such a place."""
    if len(text) <= size:
        return [text]
    cuts, at = [0], size
    while at < len(text) and (m := _GAP.search(text, at)):
        cuts.append(m.start() + 1)
        at = m.start() + 1 + size
    return [text[a:b] for a, b in pairwise([*cuts, len(text)])]


_GAP = regex.compile(r"\S (?=\S)")
