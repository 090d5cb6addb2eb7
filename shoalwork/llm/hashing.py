"""Vectorised hashing of words, shared by the operators on word sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
SLICE = 1 << 20  # bytes of text that are worked on at once
_S = [np.uint64(n) for n in (30, 27, 31)]
_M = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the splitmix64 finaliser)."""
    x = (x ^ (x >> _S[0])) * _M[0]
    x = (x ^ (x >> _S[1])) * _M[1]
    return x ^ (x >> _S[2])


def hash_strings(values: pa.Array) -> np.ndarray:
    """uint64 of each string; every distinct string is hashed once."""
    coded = values.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.empty(0, np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words of the texts in order; words are the maximal runs without space, tab, CR and LF. Null texts have none."""
    texts = texts.cast(pa.large_string())
    for sign in "\t\r\n":
        texts = pc.replace_substring(texts, sign, " ")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, bool)
    return row[keep], hash_strings(flat.filter(pa.array(keep)))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct: the set of runs of `words` consecutive words of each text."""
    row, word = word_hashes(texts)
    n = len(row) - words + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = row[:n] == row[words - 1 :]
    value = np.zeros(n, np.uint64)
    for k in range(words):
        value = mix(value * ODD[0] + word[k : k + n] + ODD[1])
    row, value = row[:n][whole], value[whole]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first].astype(np.int64), value[first]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (key, text) in slices of about SLICE bytes of text, one text at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // SLICE
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(at, [*at[1:], len(part)]):
            yield batch.slice(a, b - a)
