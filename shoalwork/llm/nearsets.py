"""Pairs of texts whose word-run sets are similar, with no loss (problem 6).

The universe of runs is partitioned: within a band of set sizes every run is hashed to one of `segments` segments, many
enough that most hold one run of a set. The content of such a segment is indexed whole; of a crowded one the contents
with one run deleted are, again and again until one run is left, so that a run meets the same run whatever stands beside
it. Of two sets of similarity t, s1 and s2 runs large, s1 - o contents of the first are not those of the second, o being
t / (1 + t) * (s1 + s2). Each set has its contents allocated by cost: ordered by how often they occur in the corpus (a
sketch of fixed size over all rows), its cheapest s1 - o + need are indexed, and similar sets share at least `need` of
these. Candidates are first held against the parities of their sets by segment (which differ in no more places than the
sets do), then verified exactly on the whole sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwork.llm.hashing import ODD, mix, shingle_sets, slices
from shoalwork.operators.graph import components
from shoalwork.plans.cut import cut

BAND, SEGMENTS, GROWTH = 384, 4_096, 4  # the first band holds sets of up to BAND runs in SEGMENTS segments; each further band GROWTH times as many
NEED = 4  # segments that a pair must share before it is verified
SKETCH_BITS, RANGES = 23, 64  # counters of the cost sketch, whatever the corpus, and the ranges that are summed apart


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.ceil(np.log(np.maximum(sizes, 1) / BAND) / math.log(GROWTH) - 1e-12)).astype(np.int64)


def bound(size: int | np.ndarray, t: float):
    """The most runs of a set of this size that are missing from one of similarity t, whatever the other's size."""
    return np.floor(np.asarray(size) * (1 - t) + 1e-9).astype(np.int64)


def _segment(row: np.ndarray, value: np.ndarray, sizes: np.ndarray, t: float, segments: int):
    """(row, signature) of the contents of each row's segments, in its own band and, near its end, in the next.

    A segment with one run has its whole content, a crowded one what deletions leave of it: each of its runs alone.
    """
    band = band_of(sizes)
    out = []
    for shift in (0, 1):
        b = band + shift
        takes = np.ones(len(sizes), bool) if not shift else sizes >= t * (BAND * float(GROWTH) ** band) - 1
        use = takes[row]
        r, v = row[use], value[use]
        if len(r):
            segment = mix(v ^ ODD[2]) % (segments * float(GROWTH) ** b[r]).astype(np.uint64)
            out.append((r, mix(mix(v ^ ODD[3]) + mix(segment * ODD[0] + b[r].astype(np.uint64) * ODD[4]))))
    return out


def _sets(batch: pa.RecordBatch, words: int, least: int):
    row, value = shingle_sets(batch.column(1), words)
    sizes = np.bincount(row, minlength=batch.num_rows)
    keep = sizes[row] >= least
    return row[keep], value[keep], np.where(sizes >= least, sizes, 0)


def _survey(words: int, least: int, t: float, segments: int):
    """Of each row its key, the hash, size and parities of its set; at the end of each task its part of the sketch."""
    names = ["k", "set_hi", "set_lo", "size", "bits", "range", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in slices(batches):
            row, value, sizes = _sets(batch, words, least)
            if not len(row):
                continue
            for _, signature in _segment(row, value, sizes, t, segments):
                slot, times = np.unique(signature >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                counts[slot] = np.minimum(counts[slot] + times, 65_535)
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums = [np.add.reduceat(mix(value ^ odd), start).view(np.int64) for odd in (ODD[0], ODD[1])]
            at = row[start]
            none = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sizes[at].astype(np.int32)), _parities(row, value, sizes, start), none, pa.nulls(len(at), pa.binary())], names=names)
        parts = [(i, part) for i, part in enumerate(counts.reshape(RANGES, -1)) if part.any()]
        if parts:
            empty = [pa.nulls(len(parts), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([i for i, _ in parts], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for _, c in parts], pa.binary())], names=names)

    return run


def _parities(row: np.ndarray, value: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> pa.ListArray:
    """Of each set a bit for each of 512 segments (four times as many in each further band): whether it holds an odd number of runs.

    Two sets differ in at least as many runs as bits, which refutes most candidates without their sets.
    """
    at = row[start]
    long_words = (8 * GROWTH ** band_of(sizes[at])).astype(np.int64)
    first = np.cumsum(np.r_[0, long_words])
    which = np.cumsum(np.r_[False, row[1:] != row[:-1]])
    bit = (mix(value ^ ODD[4]) % (64 * long_words[which]).astype(np.uint64)).astype(np.int64)
    place, odd = np.unique(first[which] * 64 + bit, return_counts=True)
    place = place[odd % 2 == 1]
    out = np.zeros(first[-1], np.uint64)
    np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(out.view(np.int64)))


def _add_range(parts: pd.DataFrame) -> pd.DataFrame:
    """The sum of one range of counters over all tasks."""
    total = np.zeros((1 << SKETCH_BITS) // RANGES, np.uint32)
    for part in parts["sketch"]:
        total = np.minimum(total + np.frombuffer(zlib.decompress(part), np.uint16), 65_535)
    return pd.DataFrame({"range": parts["range"].iloc[:1], "sketch": [zlib.compress(total.astype(np.uint16).tobytes(), 1)]})


def _counters(parts: dict[int, bytes]) -> np.ndarray:
    out = np.zeros((RANGES, (1 << SKETCH_BITS) // RANGES), np.uint16)
    for i, part in parts.items():
        out[i] = np.frombuffer(zlib.decompress(part), np.uint16)
    return out.ravel()


def _index(words: int, least: int, t: float, segments: int, sketch, need: int):
    """(signature, key, tag) of the allocated contents; tag = (size * 64 + needed matches) * 65536 + rank by cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost_of = _counters(sketch.value)
        for batch in slices(batches):
            row, value, sizes = _sets(batch, words, least)
            if not len(row):
                continue
            for r, signature in _segment(row, value, sizes, t, segments):
                cost = cost_of[(signature >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((signature, cost, r))
                r, signature = r[order], signature[order]
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
                missing = bound(sizes, t)
                needed = np.clip(sizes - missing, 1, need)
                use = rank < (missing + needed)[r]
                r, rank = r[use], rank[use]
                tag = (sizes[r] * 64 + needed[r]) * 65_536 + np.minimum(rank, 65_535)
                yield pa.RecordBatch.from_arrays([pa.array(signature[use].view(np.int64)), batch.column(0).take(pa.array(r)), pa.array(tag.astype(np.int64))], names=["s", "k", "tag"])

    return run


def _set_arrays(words: int, least: int):
    """The set of each row as its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, value, _ = _sets(batch, words, least)
            start = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(start), pa.array(value.view(np.int64)))], names=["k", "runs"])

    return run


def _chosen(docs: DataFrame, keys: DataFrame, how: str, most: int = 500_000) -> DataFrame:
    """docs restricted to (or without) the keys: by broadcast up to `most` keys, else by a shuffle."""
    few = keys.limit(most + 1).count() <= most
    return docs.join(F.broadcast(keys) if few else keys, "k", how)


def similar_pairs(texts: DataFrame, key: str, text: str, threshold: float = 0.7, words: int = 3, least: int = 20, segments: int = SEGMENTS, need: int = NEED) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the texts whose sets of `words`-word runs have similarity (Jaccard) of at least `threshold`.

    pairs: a, b, shared, size_a, size_b between representatives of equal sets, a < b. members: k, rep, one row for each
    text of at least `least` distinct runs. Equal sets are compared once, through their smallest key; nothing is lost,
    sampled or capped. Null and short texts have no row; texts are read whole; other columns are ignored. Keys are
    bigints; a repeated row of a key counts once, null keys are left out. Empty tables give empty results.
    """
    spark = texts.sparkSession
    docs = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    surveyed = cut(docs.mapInArrow(_survey(words, least, threshold, segments), "k bigint, set_hi bigint, set_lo bigint, size int, bits array<bigint>, range int, sketch binary"))
    ranges = surveyed.where("sketch is not null").select("range", "sketch").groupBy("range").applyInPandas(_add_range, "range int, sketch binary")
    sketch = spark.sparkContext.broadcast({r["range"]: r["sketch"] for r in ranges.collect()})  # of fixed size
    sets = surveyed.where("sketch is null").drop("range", "sketch").dropDuplicates(["k"])
    reps = sets.groupBy("set_hi", "set_lo", "size").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = cut(sets.join(reps.where("n > 1"), ["set_hi", "set_lo", "size"]).where("k <> rep").select("k", "rep"))
    members = sets.select("k").join(copies, "k", "left").select("k", F.coalesce("rep", "k").alias("rep"))
    distinct = _chosen(docs, copies.select("k"), "left_anti")

    index = distinct.mapInArrow(_index(words, least, threshold, segments, sketch, need), "s bigint, k bigint, tag bigint")
    size = lambda c: F.shiftright(c, 22)
    wanted = lambda c: F.shiftright(c, 16).bitwiseAND(63)
    rank = lambda c: F.col(c).bitwiseAND(65_535)
    a, b = (index.select("s", F.col("k").alias(x), F.col("tag").alias(f"t{x}")) for x in "ab")
    fits = (F.least(size("ta"), size("tb")) >= F.greatest(size("ta"), size("tb")) * threshold - 1e-9) & (F.col("a") < F.col("b"))
    # of the contents that similar sets share, the first `need` by cost lie this far from the front of either
    least_shared = F.ceil((size("ta") + size("tb")) * (threshold / (1 + threshold)) - 1e-9)
    near = lambda x: F.when(rank(x) < 65_535, rank(x)).otherwise(0) < size(x) - least_shared + F.least(wanted("ta"), wanted("tb"))
    fits = fits & near("ta") & near("tb")
    met = a.join(b, "s").where(fits).groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(F.least(wanted("ta"), wanted("tb")).cast("int")).alias("need"))
    candidates = met.where("n >= need").select("a", "b")
    differ = lambda x, y: F.floor((x + y) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    candidates = cut(candidates)

    bits = sets.select("k", "size", "bits")
    pa_, pb = (bits.select(F.col("k").alias(x), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"w{x}")) for x in "ab")
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    likely = (F.size("wa") != F.size("wb")) | (apart <= differ(F.col("na"), F.col("nb")))
    close = cut(candidates.join(pa_, "a").join(pb, "b").where(likely).select("a", "b"))
    ids = close.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    runs = _chosen(distinct, ids, "left_semi").mapInArrow(_set_arrays(words, least), "k bigint, runs array<bigint>").dropDuplicates(["k"])
    ra, rb = (runs.select(F.col("k").alias(x), F.col("runs").alias(f"r{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ra", "rb"))
    sized = close.join(ra, "a").join(rb, "b").select("a", "b", shared.alias("shared"), F.size("ra").alias("size_a"), F.size("rb").alias("size_b"))
    pairs = cut(sized.where(F.col("shared") >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * threshold - 1e-9))
    return pairs, members


def all_pairs(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b): the pairs of texts behind pairs of representatives, and those within equal sets; each once, the smaller key first."""
    copies = members.where("k <> rep")
    several = copies.select("rep").distinct()
    group = members.join(several, "rep", "left_semi")
    inside = group.select("rep", F.col("k").alias("x")).join(group.select("rep", F.col("k").alias("y")), "rep").where("x < y").select("x", "y")
    left, right = (members.select(F.col("rep").alias(r), F.col("k").alias(k)) for r, k in (("a", "x"), ("b", "y")))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    return inside.unionByName(across).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def groups(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, representative, group_id, links): each text with the smallest key of equal sets, the smallest representative
    that a chain of similar pairs leads to, and the number of different sets it is similar to. Copies are not expanded."""
    ends = pairs.select("a", "b")
    links = ends.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    linked = components(ends).select(F.col("node").alias("rep"), F.col("component").alias("group_id")).join(links, "rep")
    return members.join(linked, "rep", "left").select(F.col("k").alias(key), F.col("rep").alias("representative"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
