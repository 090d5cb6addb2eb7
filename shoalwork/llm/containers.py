"""Filling containers of fixed capacity with documents (problem 8).

Only the histogram of lengths reaches the driver, and it has at most as many entries as the capacity. Best-fit runs over
counts of that histogram: containers with the same content are planned once with a multiplicity. Documents then take the
planned slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwork.plans.cut import cut


def plan_best_fit(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first container, per container, offset)], best-fit over counts, longest first.

    An entry covers the ranks up to the next entry's first; `per container` items of that length lie side by side in
    each of consecutive containers from `offset` on. Length 0 needs no room: all of it lies in the first container.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first container, how many)
    rooms: list[int] = []
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(room: int, first: int, many: int) -> None:
        if not many or not room:
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((first, many))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank, entries = histogram[length], 0, []

        def use(room: int, first: int, many: int) -> int:
            """Put items into this run of containers; how many containers were left unused."""
            nonlocal left, rank
            each = room // length
            full = min(many, left // each)
            if full:
                entries.append((rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if left and left < each and full < many:
                entries.append((rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            return many - full

        while left and (k := bisect_left(rooms, length)) < len(rooms):
            room = rooms[k]
            runs = groups.pop(room)
            del rooms[k]
            rest = []
            for first, many in runs:
                unused = use(room, first, many) if left else many
                if unused:
                    rest.append((first + many - unused, unused))
            for first, many in rest:
                put(room, first, many)
        if left:
            need = -(-left // (capacity // length))
            use(capacity, opened, need)
            opened += need
        plan[length] = entries
    if histogram.get(0):
        plan[0] = [(0, 0, 0, 0)]
    return plan


def fill_containers(sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", buckets: int = 256) -> DataFrame:
    """(key, piece, first_token, n_tokens, container_no, offset): every document in a container of the capacity.

    A document longer than the capacity is cut into full containers and a last piece that is packed like a document
    (piece counts from 0, first_token is where the piece starts in the document); no other is split. Empty documents lie
    in container 0. Ties take their slots in the order of the key; repeated rows are documents of their own; null sizes
    count as 0. An empty table gives an empty result. The rank within a length, which may hold any share of all rows, is
    made from counts of `buckets` hash buckets and a row number within each.
    """
    if capacity < 1:
        raise ValueError("capacity is at least 1")
    size_of = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    docs = sized.select(F.col(key).alias("k"), size_of.alias("n"))
    whole = F.floor(F.col("n") / capacity).cast("bigint")
    last = F.col("n") - whole * capacity
    pieces = docs.select("k", "n", F.posexplode(F.when(F.col("n") <= capacity, F.array("n")).otherwise(F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), whole.cast("int")), F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<bigint>"))))).alias("piece", "len"))
    pieces = cut(pieces.select("k", "piece", "len", (F.pmod(F.xxhash64("k", "piece"), F.lit(buckets))).cast("int").alias("b")))
    per_bucket = pieces.groupBy("len", "b").agg(F.count(F.lit(1)).alias("c"))
    histogram = {r["len"]: r["c"] for r in per_bucket.groupBy("len").agg(F.sum("c").alias("c")).collect()}  # at most capacity + 1 rows
    plan = plan_best_fit(histogram, capacity)
    before = per_bucket.select("len", "b", (F.sum("c").over(Window.partitionBy("len").orderBy("b")) - F.col("c")).alias("before"))
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("len", "b").orderBy("k", "piece")) - 1).join(before, ["len", "b"]).select("k", "piece", "len", (F.col("row") + F.col("before")).alias("rank"))
    arrays = {n: np.array(e, dtype=np.int64).reshape(-1, 4) for n, e in plan.items()}  # bounded by the capacity, not by the rows
    shared = sized.sparkSession.sparkContext.broadcast(arrays)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("len"):
                entries, rank = shared.value[n], part["rank"].to_numpy()
                e = entries[np.searchsorted(entries[:, 0], rank, side="right") - 1]
                each, within = np.maximum(e[:, 2], 1), rank - e[:, 0]
                step = within // each if n else np.zeros_like(rank)
                yield pd.DataFrame({"k": part["k"], "piece": part["piece"], "first_token": part["piece"].astype("int64") * capacity, "n_tokens": part["len"], "container_no": e[:, 1] + step, "offset": e[:, 3] + (within % each if n else 0) * n})

    kind = dict(sized.dtypes)[key]
    return ranked.mapInPandas(place, f"k {kind}, piece int, first_token bigint, n_tokens bigint, container_no bigint, offset bigint").withColumnRenamed("k", key)
