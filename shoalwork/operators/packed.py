"""Fields that pack several numbers, split into one row per value (problem 4).

A field is first cut at everything that cannot belong to a number; a quoted span stays whole. What remains doubtful are
unquoted runs such as 194,203: one number with a thousands sign, or two. Each such run is a small lattice whose edges
are the numbers that its groups of digits can form. Expectation-maximisation over the whole column learns how frequent
each value is and how often a comma joins; in the end the Viterbi path of each lattice is the split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwork.plans.cut import cut

#: Pieces of a field: a span in straight quotes, or a run of digits with commas and points between them.
PIECE = r"""("[^"]*"|'[^']*'|\d+(?:[.,]\d+)*)"""
#: A run whose commas may be thousands signs.
DOUBTFUL = r"^[1-9]\d{0,2}(,\d{3})+(\.0+)?$"
MAX_GROUPS = 6  # more groups of three digits exceed a bigint


def _edges(run: str) -> list[tuple[int, int, int]]:
    """(from group, to group, value) of every number that consecutive groups of the run can form."""
    groups = run.split(".")[0].split(",")
    out = []
    for i in range(len(groups)):
        for j in range(i + 1, min(len(groups), i + MAX_GROUPS) + 1):
            if j == i + 1 or groups[i][0] != "0":
                out.append((i, j, int("".join(groups[i:j]))))
    return out


def _with_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(key, row, at, *e) for key, row, at, piece in zip(batch["_key"], batch["_row"], batch["_at"], batch["_piece"]) for e in _edges(piece)]
        yield pd.DataFrame(out, columns=["_key", "_row", "_at", "i", "j", "_v"])


def _log_value(value: int, count: float, total: float, unseen: float, length_share: dict[int, float]) -> float:
    """Log probability of a value: its count, and of the mass of unseen values (Good-Turing) what its number of digits gets."""
    digits = len(str(value))
    back_off = (length_share.get(digits, 0.0) + 1e-4) * 10.0 ** (1 - digits) / 9
    return math.log(((1 - unseen) * count + unseen * total * back_off) / total)


def split_packed(rows: DataFrame, key: str = "campaign_label", text: str = "email_ids", value: str = "email_id", rounds: int = 3) -> DataFrame:
    """(key, pos, value): one row per number in the text field, pos counting from 1 within the field.

    A quoted span is one value, its commas being thousands signs; signs around a number (#, id:, .0, leading zeros)
    do not change it; spans and pieces without a digit are not counted, nor are numbers beyond a bigint. Null, blank and
    void fields give no row, an empty table an empty result. A repeated input row repeats its values; other columns are
    ignored. `rounds` of EM are run. How often an unquoted comma joins starts from
    the commas that can only separate and is learned with the values.
    """
    pieces = rows.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text")).where(f"_text rlike '[0-9]'")
    pieces = pieces.select("_key", "_row", F.posexplode(F.regexp_extract_all("_text", F.lit(PIECE), 1)).alias("_at", "_piece")).where("_piece rlike '[0-9]'")
    quoted = F.col("_piece").rlike("^[\"']")
    bare = F.regexp_replace(F.regexp_replace("_piece", "[\"']", ""), r"(?<=\d),(?=\d{3}(?!\d))", "")
    number = F.regexp_extract(F.when(quoted, bare).otherwise(F.col("_piece")), r"(\d+)", 1)
    pieces = pieces.withColumn("_doubt", ~quoted & F.col("_piece").rlike(DOUBTFUL))
    # an undoubted unquoted piece with commas is a list of numbers
    parts = F.when(F.col("_doubt") | quoted, F.array(number)).otherwise(F.split("_piece", ","))
    sure = pieces.where("not _doubt").select("_key", "_row", "_at", F.posexplode(parts).alias("_sub", "_n")).select("_key", "_row", "_at", "_sub", F.regexp_extract("_n", r"(\d+)", 1).try_cast("bigint").alias("_v")).where("_v is not null")
    doubtful = pieces.where("_doubt").select("_key", "_row", "_at", "_piece")

    fixed = sure.groupBy("_v").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    doubtful = cut(doubtful)
    if doubtful.limit(1).count():
        lattice = cut(doubtful.mapInPandas(_with_edges, "_key string, _row bigint, _at int, i int, j int, _v bigint"))
        fixed = counts = cut(fixed)
        outside = F.regexp_replace("_text", r"""("[^"]*"|'[^']*')""", " ")
        commas = rows.select(F.col(text).alias("_text")).agg(F.coalesce(F.sum(F.regexp_count(outside, F.lit(","))), F.lit(0)).alias("n")).first()["n"]
        apart = commas - doubtful.agg(F.sum(F.regexp_count("_piece", F.lit(",")))).first()[0]
        join = 1.0 / (apart + 20.0)
        for step in range(rounds + 1):
            share = counts.groupBy(F.length(F.col("_v").cast("string")).alias("d")).agg(F.sum("_c").alias("c"), F.count_if(F.col("_c") < 1.5).alias("once")).collect()  # at most 19 rows
            total = sum(r["c"] for r in share) or 1.0
            unseen = min(max(sum(r["once"] for r in share) / total, 0.05), 0.95)
            lengths = {r["d"]: r["c"] / total for r in share}
            scored = lattice.join(counts, "_v", "left").groupBy("_key", "_row", "_at").agg(F.collect_list(F.struct("i", "j", "_v", F.coalesce("_c", F.lit(0.0)).alias("c"))).alias("_edges"))
            last = step == rounds
            resolved = cut(scored.mapInPandas(_lattices(total, unseen, lengths, join, best=last), "_key string, _row bigint, _at int, i int, j int, _v bigint, w double"))
            if not last:
                learned = resolved.groupBy("_v").agg(F.sum("w").alias("_c"))
                sums = resolved.agg(F.sum(F.col("w") * (F.col("j") - F.col("i") - 1)).alias("joins"), F.sum("w").alias("values"), F.countDistinct("_row", "_at").alias("runs")).first()
                join = (sums["joins"] + 1e-3) / (sums["joins"] + sums["values"] - sums["runs"] + apart + 1.0)
                join = min(max(join, 1e-6), 1 - 1e-6)
                counts = cut(fixed.unionByName(learned).groupBy("_v").agg(F.sum("_c").alias("_c")))
        resolved = resolved.select("_key", "_row", "_at", F.col("i").alias("_sub"), "_v")
        sure = sure.unionByName(resolved)
    ordered = sure.groupBy("_row", "_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_sub", "_v"))).alias("_all"))  # a field's own values
    return ordered.select(F.col("_key").alias(key), F.posexplode("_all").alias("_p", "_x")).select(key, (F.col("_p") + 1).cast("bigint").alias("pos"), F.col("_x._v").alias(value))


def _lattices(total: float, unseen: float, lengths: dict[int, float], join: float, best: bool):
    """Forward-backward over each lattice (expected use of every edge), or its Viterbi path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, row, at, edges in zip(batch["_key"], batch["_row"], batch["_at"], batch["_edges"]):
                by_end: dict[int, list] = {}
                n = max(e["j"] for e in edges)
                for e in edges:
                    score = _log_value(e["_v"], e["c"], total, unseen, lengths) + (e["j"] - e["i"] - 1) * math.log(join) + (e["j"] < n) * math.log1p(-join)
                    by_end.setdefault(e["j"], []).append((e["i"], e["_v"], score))
                if best:
                    top = {0: (0.0, None)}
                    for j in range(1, n + 1):
                        top[j] = max(((top[i][0] + s, (i, v)) for i, v, s in by_end[j]), key=lambda x: (x[0], x[1]))
                    j = n
                    while j:
                        i, v = top[j][1]
                        out.append((key, row, at, i, j, v, 1.0))
                        j = i
                    continue
                add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
                forward, backward = {0: 0.0}, {n: 0.0}
                for j in range(1, n + 1):
                    forward[j] = add([forward[i] + s for i, _, s in by_end[j]])
                starts: dict[int, list] = {}
                for j, es in by_end.items():
                    for i, v, s in es:
                        starts.setdefault(i, []).append((j, v, s))
                for i in range(n - 1, -1, -1):
                    backward[i] = add([backward[j] + s for j, _, s in starts[i]])
                for j, es in by_end.items():
                    for i, v, s in es:
                        out.append((key, row, at, i, j, v, math.exp(forward[i] + s + backward[j] - forward[n])))
            yield pd.DataFrame(out, columns=["_key", "_row", "_at", "i", "j", "_v", "w"])

    return run
