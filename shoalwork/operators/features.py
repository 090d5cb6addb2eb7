"""Feature columns of mails, feature sets, term statistics and the busiest months."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwork.functions import columns as C
from shoalwork.operators.clustering import principal_axes
from shoalwork.plans.cut import cut

# Fixed values that results depend on: names of columns and contents of the feature sets.
TIME = ("day", "month", "year", "weekday", "workday", "date_sent", "time_sent")
SUBJECT = ("subject_length", "subject_whitespace_count", "subject", "subject_avg_idf", "subject_max_idf", "subject_n_terms")
BODY = ("num_urls", "has_urls", "body_word_count", "num_lines", "avg_word_length", "greeting", "body")
ORIGIN, RECEIVER = ("sender_name", "sender_email"), ("recipient_name", "recipient_email")
URLS = ("domains", "num_urls", "num_different_domains", "num_urls_with_ip", "num_short_urls", "has_at_symbol", "has_non_ascii_chars", "has_extra_http", "avg_subdomain_count", "avg_hyphen_count")
_COUNTS = ("num_urls", "has_urls", "body_word_count", "num_lines", "avg_word_length", "greeting", "subject_length", "subject_whitespace_count", "subject_avg_idf", "subject_max_idf", "subject_n_terms")
#: Feature set -> (categories, dropped columns).
FEATURE_SETS = {
    "fs1": ((TIME, SUBJECT, BODY, ORIGIN, RECEIVER, URLS), ()),
    "fs2": ((TIME, SUBJECT, BODY, URLS, ORIGIN), ("sender_email",)),
    "fs3": ((URLS, BODY, ORIGIN), ("body_word_count", "num_lines", "avg_word_length", "greeting", "body")),
    "fs4": ((SUBJECT, BODY), _COUNTS),
    "fs5": ((SUBJECT, BODY, RECEIVER, ORIGIN, URLS), (*_COUNTS, "recipient_email")),
    "fs6": ((SUBJECT, TIME, BODY, ORIGIN, URLS), ("sender_email", "greeting", "body", "subject")),
    "fs7": ((SUBJECT, BODY, ORIGIN, URLS), ("sender_email", "body")),
    "fs_test": ((SUBJECT, ORIGIN, RECEIVER, URLS), ()),
}


def terms(c):
    """Lower-case parts between white space."""
    return F.filter(F.split(F.lower(C.text(c)), rf"{C.SPACE}+"), lambda x: x != "")


def idf_lookup(idf: DataFrame) -> DataFrame:
    """(term, idf): terms in lower case, idf to three places, 0 where it is no number; of repeats the largest."""
    return idf.where("term is not null").groupBy(F.lower(F.trim("term")).alias("term")).agg(F.max(F.coalesce(F.round(F.col("idf").cast("double"), 3), F.lit(0.0))).alias("idf"))


def subject_idf(raw: DataFrame, idf: DataFrame) -> DataFrame:
    """(email_index, subject_avg_idf, subject_max_idf, subject_n_terms): unknown terms count 0, empty subjects are zeros."""
    exploded = raw.select("email_index", F.explode(terms(F.col("subject"))).alias("term"))
    weighed = exploded.join(idf_lookup(idf), "term", "left").groupBy("email_index").agg(F.avg(F.coalesce("idf", F.lit(0.0))).alias("a"), F.max(F.coalesce("idf", F.lit(0.0))).alias("m"), F.count(F.lit(1)).alias("n"))
    return raw.select("email_index").join(weighed, "email_index", "left").select("email_index", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("subject_avg_idf"), F.coalesce("m", F.lit(0.0)).alias("subject_max_idf"), F.coalesce("n", F.lit(0)).cast("bigint").alias("subject_n_terms"))


def features(raw: DataFrame, idf: DataFrame) -> DataFrame:
    """All feature columns of each mail in one wide plan; a feature set is a projection of it."""
    when, body, subject = F.col("_when"), C.text(F.col("body")), C.text(F.col("subject"))
    words = F.regexp_extract_all(F.lower(body), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    total = F.aggregate(F.transform(words, lambda w: F.length(w)), F.lit(0), lambda a, x: a + x)
    lines = F.when(body == "", 0).otherwise(F.size(F.split(F.regexp_replace(body, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r")))
    sender, receiver = C.person(F.col("sender")), C.person(F.col("receiver"), strip_quotes=False)
    found = C.links(F.col("body"))
    columns = {
        "day": F.dayofmonth(when).cast("bigint"), "month": F.month(when).cast("bigint"), "year": F.year(when).cast("bigint"), "weekday": F.date_format(when, "EEEE"),
        "workday": (F.weekday(when) < 5).cast("bigint"), "date_sent": F.date_format(when, "yyyy-MM-dd"), "time_sent": F.date_format(when, "HH:mm:ss"),
        "subject_length": F.length(subject).cast("bigint"), "subject_whitespace_count": F.regexp_count(subject, F.lit(C.SPACE)).cast("bigint"), "subject": subject,
        "has_urls": (F.size(found) > 0).cast("bigint"), "body_word_count": F.size(words).cast("bigint"), "num_lines": lines.cast("bigint"),
        "avg_word_length": F.when(F.size(words) > 0, F.round(total / F.size(words), 1)).otherwise(0.0), "greeting": C.greeting(F.col("body")), "body": body,
        "sender_name": sender[0], "sender_email": sender[1], "recipient_name": receiver[0], "recipient_email": receiver[1],
        **C.link_features(F.col("urls")),
    }
    timed = raw.withColumn("_when", F.try_to_timestamp(C.mail_time("date"), F.lit("yyyy-MM-dd HH:mm:ss")))
    wide = timed.select("email_index", *(c.alias(n) for n, c in columns.items()))
    return wide.join(subject_idf(raw, idf), "email_index")


def feature_set(wide: DataFrame, name: str) -> DataFrame:
    categories, dropped = FEATURE_SETS[name]
    return wide.select("email_index", *dict.fromkeys(c for group in categories for c in group if c not in dropped))


def monthly_counts(times: DataFrame, ts: str = "ts") -> DataFrame:
    """(month, n): mails of every month between the first and the last, 0 where there are none. Unreadable times (0) are left out."""
    counted = times.where(F.col(ts) > 0).groupBy(F.trunc(F.to_date(F.timestamp_seconds(ts)), "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = counted.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month")).join(counted, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def best_months(times: DataFrame, months: int = 6, ts: str = "ts") -> DataFrame:
    """(first_month, last_month, total) of the `months` consecutive months with most mails, the earliest on ties; the whole span if it is no longer."""
    counted = monthly_counts(times, ts)
    w = Window.orderBy("month").rowsBetween(-(months - 1), 0)  # one row per month
    rolled = counted.select("month", F.sum("n").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("rows"))
    n = counted.agg(F.count(F.lit(1)).alias("all"), F.sum("n").alias("sum"), F.min("month").alias("low"), F.max("month").alias("high"))
    best = rolled.where(F.col("rows") == months).agg(F.max(F.struct("total", (-F.unix_date("month")).alias("o"), "month")).alias("x"))
    return n.crossJoin(best).where("low is not null").select(  # one row each
        F.when(F.col("all") <= months, F.col("low")).otherwise(F.add_months("x.month", -(months - 1))).alias("first_month"),
        F.when(F.col("all") <= months, F.col("high")).otherwise(F.col("x.month")).alias("last_month"),
        F.when(F.col("all") <= months, F.col("sum")).otherwise(F.col("x.total")).alias("total"),
    )


def bag_of_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): counts of the runs of letters, digits and _ in lower case."""
    words = F.regexp_extract_all(F.lower(C.text(F.col(text))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


#: Function words that the vectorisers leave out unless others are given.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being",
    "below", "between", "both", "but", "by", "can", "cannot", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further",
    "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how", "if", "in", "into", "is", "it", "its", "itself", "me", "more", "most",
    "my", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over", "own", "same", "she", "should", "so", "some",
    "such", "than", "that", "the", "their", "theirs", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
    "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours",
)


def _accents() -> tuple[str, str]:
    """Letters with marks and the letters below the marks, by canonical decomposition."""
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) for c in map(chr, range(0xC0, 0x2000))]
    pairs = [(c, b) for c, b in pairs if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def grams(text: Column, longest: int = 1, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The terms of a text in order: words of two and more letters, digits or _ in lower case, without accents and stop
    words, and with `longest` 2 also each two words that then follow each other. Nulls and empty texts have none."""
    plain = F.regexp_replace(F.translate(F.lower(C.text(text)), *_accents()), r"\p{Mn}", "")
    words = F.filter(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda w: ~w.isin(*stop_words))
    if longest == 1:
        return words
    return F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def vectorise(docs: DataFrame, key: str, text: str, most: int, longest: int = 1, least: int = 1, largest_share: float = 1.0, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(key, place, term, weight): tf-idf vectors of unit length over the `most` most frequent terms, ties by term.

    Terms of fewer than `least` texts, or of more than `largest_share` of all, are left out first. Places number the terms
    in alphabetical order. Texts without any term have no row; a key is taken once for each of its rows.
    """
    bag = docs.select(key, F.explode(grams(F.col(text), longest, stop_words)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.select(key).distinct().agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    stats = bag.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n))
    kept = stats.where((F.col("df") >= least) & (F.col("df") <= largest_share * F.col("n_docs"))).orderBy(F.desc("total"), "term").limit(most)
    idf = kept.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), (F.row_number().over(Window.orderBy("term")) - 1).alias("place"))  # `most` rows
    raw = bag.join(F.broadcast(idf), "term").select(key, "place", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "place", "term", (F.col("w") / norm).alias("weight"))


def clustering_matrix(records: DataFrame, key: str, numeric: list[str], texts: list[str], most: int = 500) -> DataFrame:
    """(key, v): the records as dense vectors, numbers first, then up to `most` terms of each text field, scaled robustly.

    Numbers that cannot be read count 0. Text fields are taken as one- and two-word terms of at least 2 and at most 80 %
    of the records; a field without such terms adds nothing. Each column is centred at its median and divided by its
    quartile range (1 where that is 0); what a text does not hold counts as 0 in both. Keys are single; without any record
    there is no matrix (ValueError).
    """
    n = records.count()
    if not n:
        raise ValueError("no records")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    entry = lambda i, c: F.struct(F.lit(i).alias("i"), c.alias("w"))
    parts = [records.select(key, F.explode(F.array(*(entry(i, number(c)) for i, c in enumerate(numeric)))).alias("x")).select(key, "x.i", "x.w")] if numeric else []
    for at, field in enumerate(texts):
        parts.append(vectorise(records, key, field, most, 2, 2, 0.8).select(key, (F.col("place") + len(numeric) + at * most).alias("i"), F.col("weight").alias("w")))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = cut(cells)
    held = cells.groupBy("i").agg(F.count(F.lit(1)).alias("m"))
    counted = cells.select("i", "w", F.lit(1).cast("bigint").alias("times")).unionByName(held.where(F.col("m") < n).select("i", F.lit(0.0).alias("w"), (F.lit(n) - F.col("m")).alias("times")))
    quartiles = counted.groupBy("i").agg(F.percentile("w", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("times")).alias("q")).collect()  # a row for each column
    columns = sorted(r["i"] for r in quartiles)
    place = {i: k for k, i in enumerate(columns)}
    middle = np.array([q["q"][1] for q in sorted(quartiles, key=lambda r: r["i"])])
    spread = np.array([q["q"][2] - q["q"][0] or 1.0 for q in sorted(quartiles, key=lambda r: r["i"])])

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.iloc[at : at + 512]
                m = np.zeros((len(rows), len(columns)))
                for r, items in enumerate(rows["cells"]):
                    for x in items if items is not None else ():
                        m[r, place[x["i"]]] = x["w"]
                yield pd.DataFrame({"k": rows["k"], "v": list((m - middle) / spread)})

    lists = cells.groupBy(key).agg(F.collect_list(F.struct("i", "w")).alias("cells"))  # one record's own cells
    kind = dict(records.dtypes)[key]
    whole = records.select(key).join(lists, key, "left").select(F.col(key).alias("k"), "cells")
    return whole.mapInPandas(dense, f"k {kind}, v array<double>").withColumnRenamed("k", key)


def feature_set_with_topics(wide: DataFrame, topics: DataFrame, name: str) -> DataFrame:
    """A feature set that holds bodies, with the latent topics of these."""
    return feature_set(wide, name).join(topics, "email_index", "left")


def latent_topics(docs: DataFrame, key: str, text: str, topics: int = 10, most: int = 1_000, least: int = 2, largest_share: float = 0.8) -> DataFrame:
    """(key, lsa_topic_0, ...): the leading uncentred axes of the tf-idf vectors to four places; zeros for texts without terms."""
    weights = cut(vectorise(docs, key, text, most, 1, least, largest_share))
    lists = weights.groupBy(key).agg(F.collect_list(F.struct(F.col("place").alias("i"), F.col("weight").alias("w"))).alias("v"))  # one text's own terms
    found = principal_axes(lists, key, "v", topics, centred=False, width=most)
    return docs.select(key).distinct().join(found, key, "left").select(key, *(F.round(F.coalesce(F.col("axes")[i], F.lit(0.0)), 4).alias(f"lsa_topic_{i}") for i in range(topics)))


def inverse_frequency(bag: DataFrame, docs: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(term, df, total, idf) with idf = ln((1 + n) / (1 + df)) + 1; the `most` most frequent terms, ties by term."""
    n = docs.select(key).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    stats = bag.groupBy("term").agg(F.countDistinct(key).alias("df"), F.sum("tf").alias("total"))
    if most is not None:
        stats = stats.orderBy(F.desc("total"), "term").limit(most)
    return stats.crossJoin(F.broadcast(n)).select("term", "df", "total", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row on the right


def tfidf(bag: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): tf times idf, scaled to unit length for each document."""
    raw = bag.join(idf.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))
