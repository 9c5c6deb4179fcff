"""Words of many texts at once as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .language_id import mix64


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, offsets: where each text's words begin, and the end)."""
    _, hashes, idx, off = word_table(texts, lower)
    return hashes[idx], off


def word_table(texts: pa.Array, lower: bool = True):
    """(distinct words, their hashes, each word's place among them, offsets of the texts); null is empty.

    Lower-casing changes A-Z only; words are parted by space and 0x09 to 0x0D."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    off, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    off = off - off[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        mask = full.to_numpy(zero_copy_only=False)
        flat = flat.filter(full)
        off = np.concatenate([[0], np.cumsum(mask)])[off]
    d = flat.dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((h(w) for w in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return d.dictionary, hashes, d.indices.to_numpy().astype(np.int64), off


def shingles(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, offsets); a text of 1 to n - 1 words has one run, all its words."""
    sizes = np.diff(off)
    k = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(k)])
    start = np.repeat(off[:-1] - out_off[:-1], k) + np.arange(out_off[-1])
    last = np.repeat(off[1:], k)
    h = np.zeros(len(start), np.uint64)
    for j in range(n):
        at = start + j
        inside = at < last
        w = np.where(inside, words[np.minimum(at, max(0, len(words) - 1))] if len(words) else 0, 0).astype(np.uint64)
        h = h * np.uint64(0x9E3779B97F4A7C15) + w
    return mix64(h), out_off
