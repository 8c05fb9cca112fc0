"""Words of many texts at once, as hashes in one array: the common ground of the word-level operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are taken in slices of about this many bytes, so memory doesn't follow the size of a batch. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into consecutive slices of at most ``limit`` bytes of text, or of one row. What Arrow keeps for later goes
    back to the system after each batch, as Spark's workers live on after a stage."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, base + limit, "right")) - at)
        yield batch.slice(at, n)
        at += n
    pa.default_memory_pool().release_unused()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z in lower case, and where each text's words begin (one more than texts). Null: no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0  # pieces before the first and after the last separator are empty
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's begin. Each distinct word of the slice is hashed once."""
    flat, offsets = words(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), offsets
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices)], offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
