"""Mailings among unrelated mails, by Markov clustering (problem 3).

The similarity graph joins the passages of newly written text, link hosts and sender addresses that mails repeat together;
its weights are cosines over the mails. Markov clustering alternates distributed squaring of the sparse flow matrix,
inflation and pruning of small entries. Attractor rows define the clusters; a mail belongs to the one that most of its
passages flow to, and the mails of strongest flow represent it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwork.llm.hashing import slices
from shoalwork.llm.inherited import read_marks
from shoalwork.llm.mojibake import Classifier, fit, restore
from shoalwork.operators.graph import components
from shoalwork.operators.joins import small_side_join
from shoalwork.plans.cut import cut

LEAST_SHARE = 0.15  # of the mails with the more common of two features, in which the other one is too
PAIRS = 2_000_000  # that are summed at once within a task
NAME_SHARE = 10_000  # a first name is one that more than 1 / NAME_SHARE of the mails are signed with; there are fewer than NAME_SHARE of them
INFLATION, PRUNE, STILL = 1.4, 0.002, 1e-4
ROUNDS = 12  # at most
BLOCK = 1_000  # nodes of a component that is a block of its own in the matrix; flow never leaves a component
BUCKET = 1 << 15  # keys in a slice of a cluster
PASSAGE, ADDRESS, NOTICE = 0, 1, 2  # kinds of features: passages, link hosts and sender addresses, sentences of notices

_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_CUT = re.compile(r"[.!?…]+(?=\s|$)|。|\n\s*\n")
_SIGNS = "“”„«»‘’\"'()（）<>*:;,·–—-&¡¿#|+=_~"
_HOST = re.compile(r"(?:https?://)?(?:www\.)?([^/?#:\s]+)", re.I)
_SENDER = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")


def passages(text: str, names: frozenset[str] = frozenset()) -> list[str]:
    """The sentences of a text in the form in which they are compared: in lower case, without links, first names and
    holds other than letters, so that filled-in values do not matter; all other words stay."""
    if "://" in text or "www." in text.lower():
        text = _LINK.sub(" ", text)
    out = []
    for sentence in _CUT.split(text):
        words = [w for x in sentence.split() if ((w := x).isalpha() or (w := x.strip(_SIGNS)).isalpha()) and w not in names]
        kept = " ".join(words).lower()
        if len(words) >= 4 or (len(kept) >= 12 and not kept.isascii() and max(map(len, words)) >= 8):
            out.append(kept)
    return list(dict.fromkeys(out))


def _digest(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) >> 1


def _features(model: tuple, names: frozenset[str]):
    """(k, f, kind): the features of each mail's newly written text, and (without k) those of notices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Classifier(*model)
        for batch in slices(batches):
            rows = []
            for key, body, urls, sender in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not body:
                    continue
                lines = body.replace("\r", "").split("\n")
                mark, _ = read_marks(lines)
                new, _ = restore("\n".join("" if m else x for x, m in zip(lines, mark)), fitted)
                found = passages(new, names)
                rows += [(key, _digest(s), PASSAGE) for s in found]
                if "n" in mark:
                    rows += [(None, _digest(s), NOTICE) for s in passages("\n".join(x if m == "n" else "" for x, m in zip(lines, mark)), names)]
                if found:
                    sites = {m[1].lower() for u in urls or [] if u and (m := _HOST.match(u.strip()))}
                    rows += [(key, _digest("host " + s), ADDRESS) for s in sites]
                    if m := _SENDER.search(sender or ""):
                        rows.append((key, _digest("from " + m.group().lower()), ADDRESS))
            k, f, kind = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(f, pa.int64()), pa.array(kind, pa.int32())], names=["k", "f", "kind"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, da, db): how often two features stand together in the mails of a batch; all pairs of a mail's features."""
    for batch in batches:
        items = batch.column(0)
        row = pc.list_parent_indices(items).to_numpy(zero_copy_only=False)
        flat = items.flatten()
        f, d = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.lexsort((f, row))
        row, f, d = row[order], f[order], d[order]
        last = np.searchsorted(row, row, side="right") - 1  # the last feature of the same mail
        parts, held, at, gap = [], 0, np.arange(len(row)), 1
        while len(at := at[at + gap <= last[at]]):
            parts.append(np.stack([f[at], f[at + gap], d[at], d[at + gap]]))
            held += len(at)
            gap += 1
            if held > PAIRS:
                yield _summed(parts)
                parts, held = [], 0
        if parts:
            yield _summed(parts)


def _summed(parts: list[np.ndarray]) -> pa.RecordBatch:
    pair = np.concatenate(parts, axis=1)
    pair = pair[:, np.lexsort((pair[1], pair[0]))]
    first = np.flatnonzero(np.r_[True, (pair[0, 1:] != pair[0, :-1]) | (pair[1, 1:] != pair[1, :-1])])
    n = np.diff(np.r_[first, pair.shape[1]])
    pair = pair[:, first]
    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(n.astype(np.int64)), pa.array(pair[2]), pa.array(pair[3])], names=["a", "b", "n", "da", "db"])


def _flow(matrix: np.ndarray, inflation: float, prune: float, rounds: int) -> np.ndarray:
    """The flow matrix (columns sum to 1) after the rounds, or when it stays as it is."""
    np.fill_diagonal(matrix, matrix.max(0))
    matrix /= matrix.sum(0)
    for _ in range(rounds):
        new = (matrix @ matrix) ** inflation
        new /= new.sum(0)
        new[new < np.minimum(prune, new.max(0) / 2)] = 0
        new /= new.sum(0)
        still = np.abs(new - matrix).max() < STILL
        matrix = new
        if still:
            break
    return matrix


def _blocks(inflation: float, prune: float, rounds: int):
    """The flow of whole components, each as a matrix of its own."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("component", kind="stable")
        a, b, w, owner = (part[c].to_numpy() for c in ("a", "b", "w", "component"))
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
        nodes_of, attractors, flows = [], [], []
        for start, end in zip(starts, [*starts[1:], len(owner)]):
            if end - start == 1:  # two nodes: flow is even, the larger one attracts
                pair = np.array([a[start], b[start]])
                nodes_of.append(pair)
                attractors.append(np.full(2, pair.max()))
                flows.append(np.full(2, 0.5))
                continue
            nodes, at = np.unique(np.concatenate([a[start:end], b[start:end]]), return_inverse=True)
            m = np.zeros((len(nodes), len(nodes)))
            i, j = at[: end - start], at[end - start :]
            m[i, j] = m[j, i] = w[start:end]
            m = _flow(m, inflation, prune, rounds)
            best = len(nodes) - 1 - m[::-1].argmax(0)  # the larger node on ties
            nodes_of.append(nodes)
            attractors.append(nodes[best])
            flows.append(m[best, np.arange(len(nodes))])
        whole = lambda xs: np.concatenate(xs) if xs else []
        return pd.DataFrame({"node": whole(nodes_of), "attractor": whole(attractors), "flow": whole(flows)})

    return run


def markov_clusters(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(node, attractor, flow) of an undirected weighted graph with edges (a, b, w), each once.

    Flow never crosses components, so those of up to `block` nodes are squared as matrices of their own, many of them in
    a task; larger ones as one distributed sparse matrix. Ties go to the larger node. An empty graph gives none.
    """
    edges = cut(edges)
    found = components(edges.select("a", "b"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = found.join(sizes, "component").select(F.col("node").alias("a"), "component", "size")
    tagged = cut(edges.join(placed, "a"))
    groups = max(1, tagged.count() // 20_000)
    small = tagged.where(F.col("size") <= block).withColumn("group", F.pmod(F.xxhash64("component"), F.lit(groups)))
    done = small.groupBy("group").applyInPandas(_blocks(inflation, prune, rounds), "node bigint, attractor bigint, flow double")
    large = tagged.where(F.col("size") > block).select("a", "b", "w")
    best = cut(done)
    if large.limit(1).count():
        best = best.unionByName(_distributed(large, inflation, prune, rounds))
    for _ in range(3):  # attractors that flow on
        onward = best.select(F.col("node").alias("attractor"), F.col("attractor").alias("onward"))
        best = best.join(onward, "attractor", "left").select("node", F.coalesce("onward", "attractor").alias("attractor"), "flow")
    return best


def _distributed(edges: DataFrame, inflation: float, prune: float, rounds: int) -> DataFrame:
    """(node, attractor, flow) by distributed squaring.

    Each column of the flow matrix is a node's flow and sums to 1. A round squares the matrix, raises its entries to the
    power of `inflation`, drops those below `prune` of a column (or half its largest, if that is less) and scales the columns. It ends when no entry moves
    by STILL, as in the blocks, or after `rounds`.
    """
    both = edges.select(F.col("a").alias("col"), F.col("b").alias("row"), "w").unionByName(edges.select(F.col("b").alias("col"), F.col("a").alias("row"), "w"))
    loops = both.groupBy("col").agg(F.max("w").alias("w")).select("col", F.col("col").alias("row"), "w")
    column = Window.partitionBy("col")
    flow = cut(both.unionByName(loops).withColumn("v", F.col("w") / F.sum("w").over(column)).select("col", "row", "v"))
    for _ in range(rounds):
        step = flow.select("col", F.col("row").alias("via"), F.col("v").alias("v1")).join(flow.select(F.col("col").alias("via"), "row", F.col("v").alias("v2")), "via")
        squared = step.groupBy("col", "row").agg(F.sum(F.col("v1") * F.col("v2")).alias("v")).withColumn("v", F.pow("v", inflation))
        share = squared.withColumn("v", F.col("v") / F.sum("v").over(column)).withColumn("top", F.max("v").over(column)).where(F.col("v") >= F.least(F.lit(prune), F.col("top") / 2)).drop("top")
        new = cut(share.withColumn("v", F.col("v") / F.sum("v").over(column)))
        both_ways = new.unionByName(flow.withColumn("v", -F.col("v"))).groupBy("col", "row").agg(F.abs(F.sum("v")).alias("moved"))
        moved = both_ways.agg(F.max("moved").alias("m")).first()["m"]
        flow = new
        if moved is None or moved < STILL:
            break
    best = flow.groupBy("col").agg(F.max(F.struct("v", "row")).alias("m")).select(F.col("col").alias("node"), F.col("m.row").alias("attractor"), F.col("m.v").alias("flow"))
    return cut(best)


def first_names(mails: DataFrame, sender: str) -> frozenset[str]:
    """The first words of sender names that more than 1 / NAME_SHARE of the mails have."""
    word = F.regexp_extract(F.col(sender), r'^["\s]*(\p{Lu}[\p{L}\p{M}]+)\s+\p{Lu}[^<]*<', 1)
    counted = mails.select(word.alias("w")).where("w <> ''").groupBy("w").count()
    least = mails.count() // NAME_SHARE
    return frozenset(r["w"] for r in counted.where((F.col("count") > least) & (F.col("count") > 1)).select("w").collect())


def cluster_mails(mails: DataFrame, key: str = "email_index", body: str = "body", urls: str = "urls", sender: str = "sender", least: int = 2) -> DataFrame:
    """(key, cluster, flow): the mailing of each mail that has one; clusters are named by their smallest key.

    A mail needs `least` features (passages, link hosts, its sender) that flow to the cluster, one of them a passage, and
    a cluster two mails. Null and blank bodies and keys have no cluster; null senders and links only say nothing; repeated
    rows of a key count once; texts are read whole and other columns ignored. Ties go to the stronger flow, then to the
    larger attractor. An empty table gives none.
    """
    author = F.col(sender) if sender in mails.columns else F.lit(None).cast("string")
    docs = mails.where(F.col(key).isNotNull() & F.col(body).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(body).alias("b"), F.col(urls).alias("u"), author.alias("s"))
    model, names = fit(mails, [body], sample=4_000), first_names(docs, "s")
    found = cut(docs.mapInArrow(_features((model.log_p, model.log_share, model.vocabulary, model.raw, model.letters, model.own), names), "k bigint, f bigint, kind int"))
    notices = found.where(F.col("kind") == NOTICE).select("f").distinct()
    features = found.where(F.col("kind") != NOTICE)
    if docs.groupBy("k").count().where("count > 1").limit(1).count():  # repeated rows of a key
        features = features.distinct()
    often = cut(features.groupBy("f").agg(F.count(F.lit(1)).alias("df")).where("df > 1").join(notices, "f", "left_anti"))
    most = (often.agg(F.sum("df")).first()[0] or 0) // 1_000
    hot = often.where(F.col("df") > most)  # fewer than 1,000
    plain = features.join(F.broadcast(hot.select("f")), "f", "left_anti").join(often.where(F.col("df") <= most), "f")
    shared = cut(features.join(F.broadcast(hot), "f").unionByName(plain))
    whole = shared.groupBy("k").agg(F.collect_list(F.struct("f", "df")).alias("items")).select("items")  # one mail's own features
    pairs = whole.mapInArrow(_pairs, "a bigint, b bigint, n bigint, da bigint, db bigint").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("da").alias("da"), F.max("db").alias("db"))
    together = pairs.where((F.col("n") > 1) & (F.col("n") >= LEAST_SHARE * F.greatest("da", "db")))
    edges = together.select("a", "b", (F.col("n") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))
    flows = markov_clusters(edges).select(F.col("node").alias("f"), "attractor", "flow")
    flows = cut(flows)
    few = flows.join(F.broadcast(hot.select("f")), "f", "left_semi")
    held = shared.where(F.col("df") > most).join(F.broadcast(few), "f").unionByName(shared.where(F.col("df") <= most).join(flows, "f"))
    votes = held.groupBy("k", "attractor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == PASSAGE).alias("texts"), F.sum("flow").alias("flow"))
    best = votes.where((F.col("n") >= least) & (F.col("texts") >= 1)).groupBy("k").agg(F.max(F.struct("n", "flow", "attractor")).alias("m")).select("k", F.col("m.attractor").alias("attractor"), F.col("m.flow").alias("flow"))
    best = cut(best)
    clusters = best.groupBy("attractor").agg(F.min("k").alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return small_side_join(best, clusters, ["attractor"]).select(F.col("k").alias(key), "cluster", "flow")


def neighbours(clusters: DataFrame, key: str = "email_index") -> DataFrame:
    """(key_a, key_b): each member of a cluster with the next one by key.

    A cluster is cut into slices of the keys, so that one that holds any share of all rows is spread over tasks; the
    slices are joined at their ends.
    """
    sliced = clusters.select("cluster", F.col(key).alias("k"), F.floor(F.col(key) / BUCKET).alias("slice")).distinct()
    inside = sliced.select("k", F.lead("k").over(Window.partitionBy("cluster", "slice").orderBy("k")).alias("next")).where("next is not null")
    ends = sliced.groupBy("cluster", "slice").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    between = ends.select(F.col("high").alias("k"), F.lead("low").over(Window.partitionBy("cluster").orderBy("slice")).alias("next")).where("next is not null")
    return inside.unionByName(between).select(F.col("k").alias(f"{key}_a"), F.col("next").alias(f"{key}_b"))


def described(clusters: DataFrame, key: str = "email_index", members: int = 3) -> DataFrame:
    """(cluster, size, typical): each cluster with its size and the members of strongest flow."""
    part = clusters.withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)))
    local = part.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "part").orderBy(F.desc("flow"), key))).where(F.col("r") <= members)
    top = local.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("flow")).alias("o"), F.col(key).alias("k")))), 1, members).alias("t"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(top, "cluster").select("cluster", "size", F.transform("t", lambda x: x.k).alias("typical"))
