"""Words of a column of texts as numpy arrays: where they are and what they are.

Texts are handled as UTF-8 bytes end to end; all separators are ASCII, so no
character is ever cut. Arrow numbers the distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Upper-case ASCII letters become lower-case, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = b" \t\n\x0b\x0c\r"


class Words(NamedTuple):
    code: np.ndarray      #: of each word, its number in ``names``
    doc: np.ndarray       #: of each word, the number of its text
    start: np.ndarray     #: of each word, the byte where it begins
    names: pa.Array       #: the distinct words (and separators, which no code names)


def byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to): neighbouring texts of about ``most`` bytes together, at least one each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, a line end behind each, and where each text begins."""
    wide = pc.fill_null(texts, "").cast(pa.large_string())
    flat = pc.binary_join_element_wise(wide, *pa.array(["", "\n"], wide.type))
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    raw = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return LOWER[raw], ends[:-1] - ends[0]


def words_of(buf: np.ndarray, doc_starts: np.ndarray, separators: np.ndarray) -> Words:
    """The maximal runs of bytes that are no separators; a line end must be one."""
    inside = ~separators[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts = edges[::2]
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    if not len(starts):
        return Words(np.zeros(0, np.int64), doc, starts, pa.array([], pa.large_string()))
    # words and the separators between them in turn, so that the bytes need no copy
    pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1,
                                   [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(buf)])
    coded = pieces.dictionary_encode()
    return Words(coded.indices.to_numpy()[::2].astype(np.int64), doc, starts,
                 coded.dictionary.cast(pa.large_string(), safe=False))
