"""Words ``[^\\x20\\x09-\\x0D]+`` of Arrow text columns as integer codes, whole texts, a few MB at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: UTF-8 bytes of text that are held as words at once (a longer text stands alone).
CHUNK_BYTES = 6 << 20


class Words(NamedTuple):
    start: int  # first row of the chunk within the batch
    codes: np.ndarray  # int32, one for each word, in order
    offsets: np.ndarray  # int64, rows + 1: the words of row i are codes[offsets[i]:offsets[i + 1]]
    vocabulary: pa.Array  # the distinct words


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``size`` bytes, with nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def encode(texts: pa.Array, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of each text; ``lower`` lower-cases A-Z and nothing else."""
    for start, part in chunks(texts, size):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            ends = np.concatenate([[0], np.cumsum(full)])[ends]
            flat = flat.filter(pa.array(full))
        coded = pc.dictionary_encode(flat)
        yield Words(start, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), ends, coded.dictionary)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, as int64."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words)).view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: spreads every bit of a uint64 over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
