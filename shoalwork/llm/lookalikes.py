"""Texts that look the same but are stored with other characters (problem 9).

DuckDB runs inside the Arrow partitions: one embedded SQL expression composes accents, drops invisible characters, maps
width and style forms, spaces and hyphens, and look-alike letters of other scripts to one form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwork.plans.cut import cut

# Greek and Cyrillic letters that are drawn like a Latin letter.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "α": "a", "ρ": "p",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
}
#: Hyphens drawn like the ASCII one.
HYPHENS = "‐‑"
_EMOJI = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}]"
_HOLD = ""  # stands for a joiner between emoji while the others are dropped


@lru_cache(maxsize=1)
def character_map() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer): characters with the one they become, and those that become several (ligatures). By rule from the Unicode data."""
    single, longer = dict.fromkeys(HYPHENS, "-"), {}
    for code in range(0xA0, 0x20000):
        char = chr(code)
        tag = unicodedata.decomposition(char).partition(">")[0]
        if unicodedata.category(char) == "Zs":
            single[char] = " "
        elif tag in ("<wide", "<narrow", "<font") or "ﬀ" <= char <= "ﬆ":
            to = unicodedata.normalize("NFKC", char)
            (single if len(to) == 1 else longer)[char] = to
        else:
            parts = unicodedata.normalize("NFD", char)
            if parts[0] in LOOKALIKES:
                to = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
                if len(to) == 1:
                    single[char] = to
    single = {a: LOOKALIKES.get(b, b) for a, b in single.items()}
    return "".join(single), "".join(single.values()), longer


@lru_cache(maxsize=1)
def form_sql(text: str = "text") -> str:
    """The SQL expression of a text's one form."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    source, target, longer = character_map()
    invisible = "".join(rf"\x{{{code:X}}}" for code in [*range(0xFE00, 0xFE10), *(c for c in range(0xA0, 0x10000) if unicodedata.category(chr(c)) == "Cf")])
    held = text
    for _ in range(2):  # neighbouring joiners share an emoji
        held = rf"regexp_replace({held}, '({_EMOJI}\x{{FE0F}}?)\x{{200D}}({_EMOJI})', '\1{_HOLD}\2', 'g')"
    seen = f"regexp_replace(nfc_normalize({held}), '[{invisible}]', '', 'g')"
    mapped = f"translate({seen}, {quote(source)}, {quote(target)})"
    for char, to in longer.items():
        mapped = f"replace({mapped}, {quote(char)}, {quote(to)})"
    return f"replace(nfc_normalize({mapped}), '{_HOLD}', '‍')"


def _in_duckdb(select: str):
    """Arrow batches through one DuckDB statement that reads from the view batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "600MB"}) as db:
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                result = db.execute(select).to_arrow_table()
                db.unregister("batch")
                yield from result.to_batches()

    return run


def visible_forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form): every text in its one form.

    Null texts stay null, empty ones empty; texts of any length are mapped whole. Repeated rows are repeated; other
    columns are ignored. Case, accents, signs, letters without a twin in LOOKALIKES and the number of spaces are kept.
    """
    kind = dict(docs.dtypes)[key]
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return source.mapInArrow(_in_duckdb(f"SELECT k, {form_sql()} AS form FROM batch"), f"k {kind}, form string").select(F.col("k").alias(key), "form")


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), the smaller key first: texts of one form that are not the same string, each pair once.

    Equal strings are no pair; null, empty and invisible texts have none; null keys are left out. Keys of one text are
    joined only with those of another text of its form, so a text that fills a third of the table is never compared
    with itself.
    """
    kind = dict(docs.dtypes)[key]
    select = f"WITH f AS (SELECT k, text, {form_sql()} AS form FROM batch) SELECT k, md5(form) AS f, md5(text) AS t FROM f WHERE regexp_matches(form, '[^\\s\\x{{200D}}]')"
    source = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    keyed = cut(source.mapInArrow(_in_duckdb(select), f"k {kind}, f string, t string").distinct())  # the forms are made once
    texts = keyed.select("f", "t").distinct()
    several = texts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    texts = texts.join(several, "f", "left_semi")
    other = texts.select("f", F.col("t").alias("u"))
    twins = texts.join(other, "f").where("t < u").select("t", "u")
    left = keyed.select(F.col("k").alias("x"), "t")
    right = keyed.select(F.col("k").alias("y"), F.col("t").alias("u"))
    pairs = twins.join(left, "t").join(right, "u").where("x <> y")
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()
