"""Clusterings of vectors and their quality."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwork.operators.graph import components
from shoalwork.plans.cut import cut

BLOCK = 512  # vectors compared at once


def blocks(points: DataFrame, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """(block, ids, data): the points packed into blocks of about `size` vectors, float64 in row order."""

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(batch["block"].iloc[0])], "ids": [batch["id"].to_numpy()], "data": [np.stack(batch["v"].to_numpy()).astype(np.float64).tobytes()]})

    count = max(1, -(-points.count() // size))
    placed = points.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
    return placed.groupBy("block").applyInPandas(pack, "block bigint, ids array<bigint>, data binary")


def within(points: DataFrame, key: str, vector: str, radius: float, pivots: int = 32) -> DataFrame:
    """(a, b): pairs of different points at most `radius` apart, a < b, each once.

    Every point is at home with its nearest of `pivots` points (drawn by hash) and visits each pivot that is at most
    2 * radius farther away than its home; by the triangle inequality two points within the radius meet at either home.
    Homes and visitors of a pivot meet in slices of about BLOCK vectors, one matrix product a meeting; a crowded pivot
    only has more slices.
    """
    source = points.select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    drawn = source.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not drawn:
        return points.sparkSession.createDataFrame([], "a bigint, b bigint")
    centre = np.array([r["v"] for r in drawn], np.float64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy())
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centre * centre).sum(1)[None] - 2 * x @ centre.T))
            home = d.argmin(1)
            i, q = np.nonzero(d <= d[np.arange(len(x)), home][:, None] + 2 * radius + 1e-9)
            ids = batch["id"].to_numpy()
            for rows, pivot, guest in ((np.arange(len(x)), home, False), (i, q, True)):
                yield pd.DataFrame({"pivot": pivot.astype(np.int32), "guest": guest, "id": ids[rows], "v": list(x[rows])})

    placed = cut(source.mapInPandas(place, "pivot int, guest boolean, id bigint, v array<double>"))
    most = placed.groupBy("pivot", "guest").count().agg(F.max("count")).first()[0]
    slices = max(1, -(-most // BLOCK))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pivot": [batch["pivot"].iloc[0]], "guest": [batch["guest"].iloc[0]], "slice": [batch["slice"].iloc[0]], "ids": [batch["id"].to_numpy()], "data": [np.stack(batch["v"].to_numpy()).tobytes()]})

    packed = cut(placed.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices))).groupBy("pivot", "guest", "slice").applyInPandas(pack, "pivot int, guest boolean, slice bigint, ids array<bigint>, data binary"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, xs, y, ys in zip(batch["data"], batch["ids"], batch["other_data"], batch["other_ids"]):
                xs, ys = np.asarray(xs), np.asarray(ys)
                a, b = np.frombuffer(x).reshape(len(xs), -1), np.frombuffer(y).reshape(len(ys), -1)
                d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
                i, j = np.nonzero((d <= radius * radius + 1e-9) & (xs[:, None] < ys[None]))  # at the home of the smaller key
                yield pd.DataFrame({"a": xs[i], "b": ys[j]})

    guests = packed.where("guest").select("pivot", F.col("slice").alias("o"), F.col("ids").alias("other_ids"), F.col("data").alias("other_data"))
    return packed.where("not guest").join(guests, "pivot").repartition("pivot", "slice", "o").mapInPandas(meet, "a bigint, b bigint")


def _near(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T <= radius * radius + 1e-9


def _links(x: np.ndarray, one: np.ndarray, y: np.ndarray, two: np.ndarray, radius: float) -> np.ndarray:
    """The pairs (label, label) of points of x and y within the radius, each once.

    The largest labels of both sides meet in growing parts, only until one pair is found; all others meet as a whole.
    """
    if not len(x) or not len(y):
        return np.zeros((0, 2), np.int64)
    large = []
    for labels in (one, two):
        names, n = np.unique(labels, return_counts=True)
        large.append(names[n.argmax()])
    found, big, other = [], one == large[0], two == large[1]
    if large[0] != large[1]:
        p, q = x[big], y[other]
        at = [(i, j) for i in range(0, len(p), BLOCK) for j in range(0, len(q), BLOCK)]
        if any(_near(p[i : i + BLOCK], q[j : j + BLOCK], radius).any() for i, j in sorted(at, key=sum)):
            found.append(np.array([large]))
    for p, lp, q, lq in ((x[~big], one[~big], y, two), (x[big], one[big], y[~other], two[~other])):
        for i in range(0, len(p), BLOCK):
            r, c = np.nonzero(_near(p[i : i + BLOCK], q, radius)) if len(q) else ([], [])
            found.append(np.unique(np.stack([lp[i : i + BLOCK][r], lq[c]], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _merged(labels: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The labels with linked ones united under the smallest."""
    to: dict[int, int] = {}

    def root(v: int) -> int:
        while v in to:
            if to[v] in to:
                to[v] = to[to[v]]
            v = to[v]
        return v

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            to[max(a, b)] = min(a, b)
    names, at = np.unique(labels, return_inverse=True)
    return np.array([root(v) for v in names.tolist()], np.int64)[at] if len(labels) else labels


def _first_labels(ids: np.ndarray, x: np.ndarray, radius: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, label of each point in that order or -1): core points told from neighbours alone, those known to be linked united."""
    centre = x[:: max(1, len(x) // 32)]
    d = (x * x).sum(1)[:, None] + (centre * centre).sum(1)[None] - 2 * x @ centre.T
    order = np.lexsort((d.min(1), d.argmin(1)))
    ids, x, label = ids[order], x[order], np.full(len(x), -1, np.int64)
    for at in range(0, len(x), BLOCK):
        part = slice(at, at + BLOCK)
        near = _near(x[part], x[part], radius)
        core = near.sum(1) >= least
        own, i, j = ids[part].copy(), *np.nonzero(near & core[:, None] & core[None])
        label[part] = np.where(core, _merged(own, np.stack([own[i], own[j]], axis=1)), -1)
    core = label >= 0
    label[core] = _merged(label[core], _links(x[core], label[core], x[core], label[core], radius))
    return order, label


def dbscan(points: DataFrame, key: str, vector: str, eps: float, min_samples: int = 5, size: int = 1 << 14) -> DataFrame:
    """(key, cluster): density clusters named by their smallest core point, -1 for noise. Keys are not negative.

    A core point has `min_samples` points within eps, itself included; a border point goes to the smallest cluster of the
    core points in reach. Points are packed into blocks of about `size`. A block first tells core points by their
    neighbours in it and unites those that are linked. Then all pairs of blocks meet, once to count the neighbours of the
    points that are left, and once for the links between united points and to border points. No pair of points leaves
    a meeting, only counts, linked labels and the few core points in reach of a border point.
    """
    def unpacked(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data)).reshape(n, -1)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64)
        order, label = _first_labels(ids, x, eps, min_samples)
        return pd.DataFrame({"block": [part["block"].iloc[0]], "ids": [ids[order]], "labels": [label], "data": [zlib.compress(x[order].tobytes(), 1)]})

    count = max(1, -(-points.count() // size))
    source = points.select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    packed = cut(source.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))).groupBy("block").applyInPandas(pack, "block bigint, ids array<bigint>, labels array<bigint>, data binary"))

    def met(left: DataFrame, meet, kind: str) -> DataFrame:
        """What meet makes of each two blocks, and of each with itself."""
        other = left.select(*(F.col(c).alias(f"other_{c}") for c in left.columns))
        pairs = left.join(other, F.col("block") <= F.col("other_block")).repartition(max(count * (count + 1) // 2, 1), "block", "other_block")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    one, two = ((np.asarray(row[f"{s}ids"]), np.asarray(row[f"{s}labels"]), unpacked(row[f"{s}data"], len(row[f"{s}ids"]))) for s in ("", "other_"))
                    yield from meet(one, two, row["block"] == row["other_block"])

        return pairs.mapInPandas(run, kind)

    def counts(one: tuple, two: tuple, same: bool) -> Iterator[pd.DataFrame]:
        for (ids, label, x), (_, _, y) in ((one, two), (two, one))[: 2 - same]:
            open_ = label < 0
            p, n = x[open_], [np.zeros(0, np.int64)]
            n += [_near(p[i : i + BLOCK], y, eps).sum(1) for i in range(0, len(p), BLOCK)]
            yield pd.DataFrame({"id": ids[open_], "n": np.concatenate(n)})

    more = met(packed, counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples)
    fresh = cut(more.select("id", F.pmod(F.xxhash64("id"), F.lit(count)).alias("block")))
    named = packed.join(fresh.groupBy("block").agg(F.collect_list("id").alias("fresh")), "block", "left")  # a block's own points

    def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["labels"] = [np.where(np.isin(ids, new), ids, label) if new is not None else label for ids, label, new in zip(batch["ids"], batch["labels"], batch["fresh"])]
            yield batch[["block", "ids", "labels", "data"]]

    ready = cut(named.mapInPandas(relabel, "block bigint, ids array<bigint>, labels array<bigint>, data binary"))

    def links(one: tuple, two: tuple, same: bool) -> Iterator[pd.DataFrame]:
        (_, l1, x1), (_, l2, x2) = one, two
        c1, c2 = l1 >= 0, l2 >= 0
        pairs = _links(x1[c1], l1[c1], x2[c2], l2[c2], eps)
        yield pd.DataFrame({"border": False, "a": pairs[:, 0], "b": pairs[:, 1]})
        for (ids, label, x), (_, names, y) in ((one, two), (two, one))[: 2 - same]:
            x, ids, y, names = x[label < 0], ids[label < 0], y[names >= 0], names[names >= 0]
            for i in range(0, len(x), BLOCK):
                r, c = np.nonzero(_near(x[i : i + BLOCK], y, eps)) if len(y) else (np.zeros(0, int),) * 2
                yield pd.DataFrame({"border": True, "a": ids[i : i + BLOCK][r], "b": names[c]})

    found = cut(met(ready, links, "border boolean, a bigint, b bigint").distinct())
    core = cut(ready.select(F.explode(F.arrays_zip("ids", "labels")).alias("x")).select(F.col("x.ids").alias("a"), F.col("x.labels").alias("label")).where("label >= 0"))
    joined = components(found.where("not border").select("a", "b").unionByName(core.select(F.col("label").alias("a"), F.col("label").alias("b")).distinct())).withColumnRenamed("node", "label")
    border = found.where("border").select("a", F.col("b").alias("label")).join(joined, "label").groupBy("a").agg(F.min("component").alias("component"))
    assigned = core.join(joined, "label").select("a", "component").unionByName(border)
    return source.select(F.col("id").alias("a")).join(assigned, "a", "left").select(F.col("a").alias(key), F.coalesce("component", F.lit(-1)).cast("bigint").alias("cluster"))


def kmeans(points: DataFrame, key: str, vector: str, k: int = 300, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(assignments (key, cluster), centres (cluster, centre)); at most as many clusters as points. Empty input gives none."""
    ready = points.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    n = ready.limit(k).count()
    spark = points.sparkSession
    if n == 0:
        return spark.createDataFrame([], f"{key} bigint, cluster int"), spark.createDataFrame([], "cluster int, centre array<double>")
    model = KMeans(k=max(1, min(k, n)), seed=seed, featuresCol="features", predictionCol="cluster").fit(ready)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    return model.transform(ready).select(key, "cluster"), centres


def bandwidth(points: DataFrame, key: str, vector: str, quantile: float, sample: int = 500) -> float:
    """Mean distance to the neighbour at the quantile, over a sample of that many points (a parameter of the estimate)."""
    drawn = points.select(F.col(vector).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(sample).collect()
    if not drawn:
        return 0.0
    x = np.array([r["v"] for r in drawn], np.float64)
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T))
    k = max(1, int(len(x) * quantile))
    found = float(np.partition(d, k - 1, axis=1)[:, k - 1].mean())
    return found if found > 1e-4 else max(0.5 * float(x.std()), 0.1)


def mean_shift(points: DataFrame, key: str, vector: str, width: float, rounds: int = 30, seeds: int = 256) -> DataFrame:
    """(key, cluster): modes of a flat kernel of that width; every point goes to its nearest mode, modes are numbered by support.

    Seeds are the bins of the width that hold most points, at most `seeds`. Each round averages, in one pass over the
    points, those within reach of each seed; only sums for the seeds leave the executors.
    """
    grid = points.groupBy(F.transform(vector, lambda x: F.round(x / width).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bin").limit(seeds).collect()
    centres = np.array([[b * width for b in r["bin"]] for r in grid], np.float64)
    if not len(centres):
        return points.sparkSession.createDataFrame([], f"{key} bigint, cluster int")
    data = cut(blocks(points, key, vector))

    def sums(at: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for raw, ids in zip(batch["data"], batch["ids"]):
                    x = np.frombuffer(raw).reshape(len(ids), -1)
                    near = ((x * x).sum(1)[:, None] + (at * at).sum(1)[None] - 2 * x @ at.T) <= width * width
                    yield pd.DataFrame({"s": np.arange(len(at)), "n": near.sum(0), "v": list(near.T.astype(np.float64) @ x)})

        width_of = at.shape[1]
        merged = data.mapInPandas(run, "s int, n bigint, v array<double>").groupBy("s").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("v")[i]) for i in range(width_of))).alias("v")).orderBy("s").collect()  # one row a seed
        return np.array([r["n"] for r in merged]), np.array([r["v"] for r in merged])

    support = np.zeros(len(centres))
    for _ in range(rounds):
        support, total = sums(centres)
        moved = np.where(support[:, None] > 0, total / np.maximum(support, 1)[:, None], centres)
        done = np.abs(moved - centres).max() < 1e-3 * width
        centres = moved
        if done:
            break
    modes: list[np.ndarray] = []
    for i in np.lexsort((*centres.T[::-1], -support)):
        if support[i] and all(np.linalg.norm(centres[i] - m) > width for m in modes):
            modes.append(centres[i])
    found = np.array(modes)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw, ids in zip(batch["data"], batch["ids"]):
                x = np.frombuffer(raw).reshape(len(ids), -1)
                yield pd.DataFrame({key: ids, "cluster": ((found * found).sum(1)[None] - 2 * x @ found.T).argmin(1).astype(np.int32)})

    return data.mapInPandas(nearest, f"{key} bigint, cluster int")


def agreement(pairs: DataFrame, truth: str, cluster: str) -> DataFrame:
    """(n, homogeneity, completeness, v_measure) of the rows that have both; zeros for fewer than two."""
    cells = pairs.where(F.col(truth).isNotNull() & F.col(cluster).isNotNull()).groupBy(truth, cluster).agg(F.count(F.lit(1)).alias("n"))
    t, c = Window.partitionBy(truth), Window.partitionBy(cluster)
    total = cells.agg(F.sum("n").alias("all"))
    joint = cells.withColumn("nt", F.sum("n").over(t)).withColumn("nc", F.sum("n").over(c)).crossJoin(F.broadcast(total))  # one row on the right
    share = lambda x: F.col("n") / F.col("all") * F.log(x)
    sums = joint.agg(F.coalesce(F.max("all"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(-share(x)), F.lit(0.0)).alias(k) for k, x in (("h_t", F.col("nt") / F.col("all")), ("h_c", F.col("nc") / F.col("all")), ("h_tc", F.col("n") / F.col("nc")), ("h_ct", F.col("n") / F.col("nt")))))
    few = F.col("n") < 2
    h = F.when(few, 0.0).when(F.abs("h_t") < 1e-12, 1.0).otherwise(1 - F.col("h_tc") / F.col("h_t"))
    k = F.when(few, 0.0).when(F.abs("h_c") < 1e-12, 1.0).otherwise(1 - F.col("h_ct") / F.col("h_c"))
    both = sums.select("n", h.alias("h"), k.alias("c"))
    return both.select(F.col("n").cast("bigint").alias("n"), F.round("h", 6).alias("homogeneity"), F.round("c", 6).alias("completeness"), F.round(F.when(F.col("h") + F.col("c") > 0, 2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))).otherwise(0.0), 6).alias("v_measure"))


def centroids(points: DataFrame, cluster: str, vector: str, width: int) -> DataFrame:
    """(cluster, n, centre)."""
    return points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(width))).alias("centre"))


def calinski_harabasz(points: DataFrame, cluster: str, vector: str, width: int) -> DataFrame:
    """(score): dispersion between clusters over that within, for each degree of freedom."""
    from shoalwork.functions.columns import squared_distance

    at = centroids(points, cluster, vector, width)
    mean = points.agg(F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(width))).alias("mean"))
    between = at.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("n") * squared_distance(F.col("centre"), F.col("mean"))).alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))  # one row on the right
    inside = points.join(at, cluster).agg(F.sum(squared_distance(F.col(vector), F.col("centre"))).alias("w"))
    return between.crossJoin(inside).select(F.round((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("score"))  # one row each


def davies_bouldin(points: DataFrame, cluster: str, vector: str, width: int) -> DataFrame:
    """(score): mean over clusters of the largest (spread + spread) / distance to another cluster."""
    from shoalwork.functions.columns import squared_distance

    at = centroids(points, cluster, vector, width)
    spread = points.join(at, cluster).groupBy(cluster).agg(F.avg(F.sqrt(squared_distance(F.col(vector), F.col("centre")))).alias("s"), F.first("centre").alias("centre"))
    one, two = (spread.select(F.col(cluster).alias(f"c{i}"), F.col("s").alias(f"s{i}"), F.col("centre").alias(f"m{i}")) for i in (1, 2))
    ratio = (F.col("s1") + F.col("s2")) / F.sqrt(squared_distance(F.col("m1"), F.col("m2")))
    return one.join(two, F.col("c1") != F.col("c2")).groupBy("c1").agg(F.max(ratio).alias("r")).agg(F.round(F.avg("r"), 6).alias("score"))  # clusters, not points


def silhouette(points: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """(score): exact mean silhouette in Euclidean distance; clusters of one point count 0.

    Every point meets every block of points, and only its sums of distances for each cluster leave the meeting.
    """
    kind = dict(points.dtypes)[cluster]
    packed = cut(blocks(points, key, vector))
    labels = points.select(F.col(key).cast("bigint").alias("id"), F.col(cluster).alias("c"))
    tagged = packed.select("block", F.explode("ids").alias("id")).join(labels, "id").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("id", F.col("c").cast("string")))).alias("labels"))  # a block's own points
    ready = cut(packed.join(tagged, "block"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, xs, y, ys, names in zip(batch["data"], batch["ids"], batch["other_data"], batch["other_ids"], batch["other_labels"]):
                names = dict(names)
                a, b = np.frombuffer(x).reshape(len(xs), -1), np.frombuffer(y).reshape(len(ys), -1)
                d = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))
                d[np.asarray(xs)[:, None] == np.asarray(ys)[None]] = 0
                own = np.array([names[i] for i in ys])
                for c in np.unique(own):
                    m = own == c
                    yield pd.DataFrame({"id": xs, "other": c, "s": d[:, m].sum(1), "n": int(m.sum())})

    other = ready.select(F.col("ids").alias("other_ids"), F.col("data").alias("other_data"), F.col("labels").alias("other_labels"), F.col("block").alias("o"))
    met = ready.drop("labels").join(other, F.lit(True)).repartition("block", "o").mapInPandas(meet, "id bigint, other string, s double, n bigint")
    sums = met.groupBy("id", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(labels.select("id", F.col("c").cast("string").alias("c")), "id")
    inner = F.max(F.when(F.col("other") == F.col("c"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1))))
    outer = F.min(F.when(F.col("other") != F.col("c"), F.col("s") / F.col("n")))
    per = sums.groupBy("id").agg(inner.alias("a"), outer.alias("b"))
    return per.agg(F.round(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))), 6).alias("score"))


GRAM_ROWS = 64  # rows of the Gram matrix that are summed together


def _stacked(batch: pd.DataFrame, width: int) -> np.ndarray:
    """The vectors of a batch as a matrix; given as arrays, or as lists of (place, value) of what is not zero."""
    values = batch["v"].to_numpy()
    if len(values) and len(values[0]) and isinstance(values[0][0], (dict, tuple)):
        out = np.zeros((len(values), width))
        for i, row in enumerate(values):
            for x in row:
                out[i, x["i"]] = x["w"]
        return out
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, width))


def gram(points: DataFrame, vector: str, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of outer products, sum, count) of the vectors: each task sums its own, stripes of the matrix are summed apart."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                m = _stacked(batch.iloc[at : at + BLOCK], width)
                total, first, n = total + m.T @ m, first + m.sum(0), n + len(m)
        if n:
            for at in range(0, width, GRAM_ROWS):
                yield pd.DataFrame({"stripe": [at], "data": [total[at : at + GRAM_ROWS].tobytes()], "first": [first[at : at + GRAM_ROWS].tobytes()], "n": [n]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [sum(np.frombuffer(x) for x in rows[c]).tobytes() for c in ("data", "first")]
        return pd.DataFrame({"stripe": rows["stripe"].iloc[:1], "data": sums[:1], "first": sums[1:], "n": [int(rows["n"].sum())]})

    kind = "stripe int, data binary, first binary, n bigint"
    rows = points.select(F.col(vector).alias("v")).mapInPandas(part, kind).groupBy("stripe").applyInPandas(add, kind).collect()  # width x width numbers
    rows.sort(key=lambda r: r["stripe"])
    if not rows:
        return np.zeros((width, width)), np.zeros(width), 0
    return np.concatenate([np.frombuffer(r["data"]).reshape(-1, width) for r in rows]), np.concatenate([np.frombuffer(r["first"]) for r in rows]), rows[0]["n"]


def principal_axes(points: DataFrame, key: str, vector: str, k: int, centred: bool = True, width: int | None = None) -> DataFrame:
    """(key, axes): coordinates on the k leading axes of the (centred) vectors; an axis' largest loading is positive.

    Vectors are arrays of one length, or with `width` lists of (i, w), the places and values of what is not zero. Axes
    that the vectors do not have are zeros; an empty table gives none.
    """
    axes, mean, _ = axes_of(points, vector, k, centred, width)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                rows = batch.iloc[at : at + BLOCK]
                yield pd.DataFrame({"k": rows["k"], "axes": list((_stacked(rows, len(mean)) - mean) @ axes)})

    kind = dict(points.dtypes)[key]
    return points.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(project, f"k {kind}, axes array<double>").withColumnRenamed("k", key)


def axes_of(points: DataFrame, vector: str, k: int, centred: bool, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes as columns, mean, share of the sum of squares that each explains)."""
    if width is None:
        row = points.select(F.size(vector).alias("n")).first()
        width = row["n"] if row else 1
    total, first, n = gram(points, vector, width)
    mean = first / max(n, 1) if centred else np.zeros(width)
    spread, axes = np.linalg.eigh(total - n * np.outer(mean, mean))
    spread, axes = np.maximum(spread[::-1], 0.0), axes[:, ::-1]
    axes = axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(0), np.arange(min(k, width))])
    axes = np.pad(np.where(spread[:k] > 1e-12 * max(spread[0], 1e-300), axes, 0.0), ((0, 0), (0, max(0, k - width))))
    return axes, mean, spread[:k] / max(spread.sum(), 1e-300)
