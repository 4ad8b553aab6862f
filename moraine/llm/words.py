"""Words of many texts at once: byte classes, runs, and codes into a dictionary of distinct words.

A slice of texts is one byte buffer.  A table of 256 entries says for each byte
whether it belongs to a word, parts words, or ends a piece; runs of word bytes
are found by array operations and Arrow numbers the distinct ones.  UTF-8 bytes
of letters beyond ASCII are word bytes, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IN_WORD, GAP_BYTE, BREAK_BYTE = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """``doc`` and ``code`` of every word in order; ``first``: the word begins a piece (or a text)."""

    doc: np.ndarray
    code: np.ndarray
    first: np.ndarray
    dictionary: pa.Array


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``most`` bytes each; a longer row is a range of its own."""
    lo, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(lengths):
        yield lo, len(lengths)


def split_words(texts: pa.Array, kinds: np.ndarray) -> Words:
    """The words of all texts, A-Z lower-cased; ``kinds`` classes the 256 bytes."""
    data, offsets = raw_bytes(texts)
    kind = kinds[data]
    inside = kind == IN_WORD
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of texts that hold any
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    ends[before] = inside[before]
    at = np.flatnonzero(starts)
    lengths = np.flatnonzero(ends) + 1 - at
    bounds = np.zeros(len(at) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    array = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(LOWER[data[inside]]))
    coded = array.dictionary_encode()
    doc = np.searchsorted(offsets, at, "right") - 1
    piece = np.cumsum(kind == BREAK_BYTE)[at] if len(at) else np.zeros(0, np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
    return Words(doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first, coded.dictionary)
