"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 7).

Short texts are encoded where they are read. A long text is cut in front of white space, where the tokenizer always
starts anew; a stretch that has no such place is halved until its parts are short. All parts are encoded in parallel;
those of one stretch are then joined like a tree: around each join a growing window is encoded again until it agrees with
both sides. Only these carry their text and spans beside their ids, and texts are worked on in slices of fixed size.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwork.llm.hashing import slices

LEAF = 6_000  # characters that are encoded at once
_loaded: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer: below SHOALWORK_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(os.environ.get("SHOALWORK_TOKENIZERS", "/opt/tokenizers"), name)


def load(path: str):
    """The tokenizer of the file, once for each Python worker; strings of special tokens are ordinary text."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True
    return _loaded[path]


def cut_points(text: str, leaf: int = LEAF) -> list[tuple[int, int, bool]]:
    """(from, to, joined): parts of at most `leaf` characters. joined tells that the part continues an unsplit stretch."""
    parts, start = [], 0
    while len(text) - start > leaf:
        at = next((i for i in range(start + leaf, start, -1) if text[i].isspace() and not text[i - 1].isspace()), 0)
        if at:
            parts.append((start, at, False))
            start = at
            continue
        end = next((i for i in range(start + leaf + 1, len(text)) if text[i].isspace() and not text[i - 1].isspace()), len(text))
        pieces = [(start, end)]
        while max(b - a for a, b in pieces) > leaf:  # halves of halves
            pieces = [half for a, b in pieces for half in ((a, (a + b) // 2), ((a + b) // 2, b))]
        parts += [(a, b, a > start) for a, b in pieces]
        start = end
    if start < len(text):
        parts.append((start, len(text), False))
    return parts


Encoded = tuple[list[int], list[int], list[int]]  # ids, start of each token and of each word, in characters


def encode_spans(encode: Callable, text: str, base: int = 0) -> Encoded:
    """Ids of the text with where their tokens and the tokenizer's words start."""
    found = encode(text)
    words, last = [], None
    for (a, _), w in zip(found.offsets, found.word_ids):
        if w != last:
            words.append(base + a)
            last = w
    return found.ids, [base + a for a, _ in found.offsets], words


def join_encoded(encode: Callable, text: str, left: Encoded, right: Encoded, cut: int, start: int, end: int, window: int = 64) -> Encoded:
    """The encoding of text[start:end] from those of text[start:cut] and text[cut:end].

    A window around the cut, which begins and ends at token starts of the sides, is encoded; it grows until it shares a
    whole token and all word starts with either side away from its own ends. A token sequence is the BPE encoding of a
    word if and only if each neighbouring pair is, so such a splice is exact. At worst the window is the whole text.
    """
    margin = 8  # beside a window's own ends words may be cut
    while True:
        i, j = max(0, bisect_left(left[1], cut - window)), bisect_left(right[1], cut + window)
        a = left[1][i] if left[1] and i < len(left[1]) else start
        b = right[1][j] if j < len(right[1]) else end
        if a <= start + margin:
            a = start
        if b >= end - margin:
            b = end
        ids, at, words = encode_spans(encode, text[a:b], a)
        if a == start and b == end:
            return ids, at, words
        first = _shared(left, (ids, at, words), a, cut, a + margin if a > start else a, cut - margin) if a > start else None
        last = _shared((ids, at, words), right, cut, b, cut + margin, b - margin, from_end=True) if b < end else None
        if (a == start or first is not None) and (b == end or last is not None):
            x, y = (0, 0) if a == start else first
            p, q = (len(ids), len(right[0])) if b == end else last
            if x >= 0 and y <= p:
                head = left[1][x] if a > start else start
                tail = right[1][q] if b < end else end
                merged_words = [w for w in left[2] if w < head] * (a > start) + [w for w in words if head <= w < tail] + [w for w in right[2] if w >= tail] * (b < end)
                if a > start and head in words and head not in left[2]:
                    merged_words = [w for w in merged_words if w != head]
                return (left[0][:x] if a > start else []) + ids[y:p] + (right[0][q:] if b < end else []), (left[1][:x] if a > start else []) + at[y:p] + (right[1][q:] if b < end else []), merged_words
        window *= 4


def _shared(one: Encoded, two: Encoded, low: int, high: int, safe_low: int, safe_high: int, from_end: bool = False) -> tuple[int, int] | None:
    """Positions, in one and in two, of a token that both hold within the safe range, if their words agree there."""
    if safe_high <= safe_low:
        return None
    inside = lambda words: [w for w in words if safe_low <= w <= safe_high]
    if inside(one[2]) != inside(two[2]):
        return None
    known = {s: k for k, s in enumerate(two[1]) if safe_low <= s < safe_high}
    span = [k for k, s in enumerate(one[1]) if safe_low <= s < safe_high]
    for k in reversed(span) if from_end else span:
        m = known.get(one[1][k])
        if m is None or one[0][k] != two[0][m] or k + 1 >= len(one[1]) or m + 1 >= len(two[1]) or one[1][k + 1] != two[1][m + 1]:
            continue
        if one[1][k] == one[1][k + 1]:  # a character of several tokens
            continue
        return (k, m)
    return None


def merge_tree(encode: Callable, text: str, parts: list[tuple[int, int, Encoded]]) -> Encoded:
    """Neighbouring parts of one stretch joined two by two, level by level."""
    while len(parts) > 1:
        level = []
        for k in range(0, len(parts) - 1, 2):
            (a, cut, left), (_, b, right) = parts[k], parts[k + 1]
            level.append((a, b, join_encoded(encode, text, left, right, cut, a, b)))
        parts = level + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0][2]


_IDS = pa.list_(pa.int32())
_PARTS = {"r": pa.string(), "part": pa.string(), "a": pa.int32(), "b": pa.int32(), "joined": pa.bool_(), "many": pa.bool_()}
_ENCODED = {"r": pa.string(), "a": pa.int32(), "b": pa.int32(), "joined": pa.bool_(), "part": pa.string(), "ids": _IDS, "at": _IDS, "words": _IDS}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())], names=list(kinds))


def _encode_short(path: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in slices(batches):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = tokenizer.encode_batch_fast([t or "" for t in part.column(1).to_pylist()], add_special_tokens=False)
                last = pa.array([len(x) for x in found], pa.int64()) if counts else pa.array([x.ids for x in found], _IDS)
                yield pa.RecordBatch.from_arrays([part.column(0), last], names=["k", "ids"])

    return run


def _cut_long(leaf: int):
    """(r, part, a, b, joined, many): the parts of each text; many tells that a part is one of several of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = cut_points(text, leaf)
                onward = [joined for _, _, joined in found[1:]] + [False]
                yield _batch([(key, text[a:b], a, b, joined, joined or more) for (a, b, joined), more in zip(found, onward)], _PARTS)

    return run


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False)
        for batch in slices(batches):
            rows = batch.to_pylist()
            alone = iter(tokenizer.encode_batch_fast([x["part"] for x in rows if not x["many"]], add_special_tokens=False))
            out = []
            for x in rows:
                ids, at, words = encode_spans(encode, x["part"], x["a"]) if x["many"] else (next(alone).ids, None, None)
                out.append((x["r"], x["a"], x["b"], x["joined"], x["part"] if x["many"] else None, ids, at, words))
            yield _batch(out, _ENCODED)

    return run


def _join_parts(path: str, counts: bool):
    """(r, ids), or (r, number of ids) with counts, of each text from its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False)
        for batch in batches:
            for r, parts in zip(batch.column(0), batch.column(1)):
                parts = parts.values
                parts = parts.take(pa.array(np.argsort(parts.field("a").to_numpy())))
                alone, ids, done, stretch = parts.field("part").is_null().to_numpy(zero_copy_only=False), parts.field("ids"), [], []
                for i in range(len(parts) + 1):
                    if stretch and (i == len(parts) or alone[i] or not parts.field("joined")[i].as_py()):
                        start = stretch[0]["a"]
                        text = "".join(p["part"] for p in stretch)
                        moved = [(p["a"] - start, p["b"] - start, (p["ids"], *([x - start for x in p[c]] for c in ("at", "words")))) for p in stretch]
                        done.append(np.array(merge_tree(encode, text, moved)[0], np.int32))
                        stretch = []
                    if i < len(parts):
                        if alone[i]:
                            done.append(ids[i].values.to_numpy())
                        else:
                            stretch.append(parts[i].as_py())
                whole = np.concatenate(done)
                last = pa.array([len(whole)], pa.int64()) if counts else pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), pa.array(whole))
                yield pa.RecordBatch.from_arrays([pa.array([r.as_py()], pa.string()), last], names=["r", "ids"])

    return run


def encode_corpus(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", leaf: int = LEAF, counts: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens) with counts=True: one row per row of docs.

    Null and empty texts give the empty list; blank texts are encoded as they are; no special tokens. Texts of more
    than `leaf` characters are cut, encoded in parts and joined exactly. Repeated rows and null keys are kept, other
    columns ignored. An empty table gives an empty result.
    """
    path = path or tokenizer_path()
    kind = dict(docs.dtypes)[key]
    result = "n_tokens" if counts else "ids"
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    is_long = F.length("t") > leaf
    short = source.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(_encode_short(path, counts), f"k {kind}, ids {'bigint' if counts else 'array<int>'}")
    # equal long texts are encoded once
    long = source.where(is_long).withColumn("r", F.md5("t"))
    once = long.groupBy("r").agg(F.first("t").alias("t"))
    cut = once.mapInArrow(_cut_long(leaf), "r string, part string, a int, b int, joined boolean, many boolean")
    encoded = cut.repartition("r", "a").mapInArrow(_encode_parts(path), "r string, a int, b int, joined boolean, part string, ids array<int>, at array<int>, words array<int>")
    whole = encoded.groupBy("r").agg(F.collect_list(F.struct("a", "b", "joined", "part", "ids", "at", "words")).alias("parts"))  # one text's own parts
    joined = whole.mapInArrow(_join_parts(path, counts), f"r string, ids {'bigint' if counts else 'array<int>'}")
    keyed = joined.join(long.select("k", "r"), "r").select("k", "ids")
    return short.unionByName(keyed).select(F.col("k").alias(key), F.col("ids").alias(result))
