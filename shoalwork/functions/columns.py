"""Column expressions over addresses, links, dates and texts; all of them run inside the JVM."""

from __future__ import annotations

from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
FREEMAIL = ("gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "outlook.com", "hotmail.com", "live.com", "aol.com", "icloud.com", "proton.me", "protonmail.com", "gmx.com", "yandex.com")
SHORTENERS = ("bit.ly", "tinyurl.com", "short.link", "ow.ly", "goo.gl")
GREETINGS = ("good morning", "good afternoon", "good evening", "dearest", "greetings", "hello", "hi", "hey", "dear")
SPACE = r"[\t\n\x0B\f\r\x1C-\x20\x85\p{Z}]"  # white space in any script
BREAKS = r"\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029"  # signs that end a line
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINK = r"""(?i)(?:https?://|www\.)[^\s'"<>]+"""


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def address(c: Column) -> Column:
    """What stands in angle brackets, else the whole; trimmed, in lower case."""
    inner = F.regexp_extract(text(c), r"<([^>]*)>", 1)
    return F.lower(F.trim(F.when(text(c).rlike(r"<[^>]*>"), inner).otherwise(text(c))))


def addresses(c: Column) -> Column:
    """All addresses in order of appearance, each once; where none is well formed, the parts between , and ; that hold an @."""
    found = F.transform(F.regexp_extract_all(text(c), F.lit(f"({ADDRESS})"), 1), F.lower)
    parts = F.filter(F.transform(F.split(text(c), "[,;]"), address), lambda x: x.contains("@"))
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(parts))


def sender_key(c: Column) -> Column:
    """The first address, else the whole value as an address."""
    found = addresses(c)
    return F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise(address(c))


def email_domain(c: Column) -> Column:
    """What follows the last @, in lower case; empty without one."""
    return F.when(c.contains("@"), F.lower(F.trim(F.substring_index(c, "@", -1)))).otherwise(F.lit(""))


def is_freemail(c: Column) -> Column:
    return F.lower(F.trim(text(c))).isin(*FREEMAIL)


def links(c: Column) -> Column:
    """All links of a text, without trailing punctuation; repeats are kept."""
    found = F.regexp_extract_all(text(c), F.lit(f"({LINK})"), 1)
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")), lambda u: u != "")


def with_scheme(u: Column) -> Column:
    return F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("http://"), u))


def link_host(u: Column) -> Column:
    """User, host and port of a link in lower case."""
    return F.lower(F.regexp_extract(with_scheme(u), r"(?i)^https?://([^/?#]*)", 1))


def link_path(u: Column) -> Column:
    """Path, query and fragment of a link; / if all are empty. A bare ?, # or ; at the end falls away."""
    rest = F.regexp_replace(F.regexp_replace(with_scheme(u), r"(?i)^https?://[^/?#]*", ""), r"[?#;]$", "")
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def link_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(with_scheme(u), r"(?i)^(https?)://", 1))


def distinct_links(urls: Column) -> Column:
    """Links that differ by more than case and a final slash, the first of each in order."""
    keyed = F.transform(urls, lambda u: F.struct(F.regexp_replace(F.lower(u), "/+$", "").alias("key"), u.alias("url")))
    keep = lambda x, i: F.array_position(F.transform(keyed, lambda y: y.key), x.key) == i + 1
    return F.transform(F.filter(keyed, keep), lambda x: x.url)


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def lexical(s: Column) -> Column:
    """length, digits, hyphens, letters, others, share of digits, share of hyphens, entropy of the trimmed lower-case text; zeros for an empty one."""
    s = F.lower(F.trim(text(s)))
    n = F.length(s).cast("double")
    digits, hyphens, letters = (F.regexp_count(s, F.lit(p)).cast("double") for p in (r"\p{Nd}", "-", r"\p{L}"))
    others = F.regexp_count(s, F.lit(r"[^\p{L}\p{N}]")).cast("double")
    return F.when(n == 0, F.array_repeat(F.lit(0.0), 8)).otherwise(F.array(n, digits, hyphens, letters, others, digits / n, hyphens / n, entropy(s)))


_STAMP = r"^(?:[A-Za-z]{3}, )?(\d{1,2} [A-Za-z]{3} \d{4}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4}|GMT|UTC)$"
_PLAIN = r"^(\d{4}-\d{2}-\d{2})(?: (\d{2}:\d{2}:\d{2}))?$"


def local_time(c: Column) -> Column:
    """The date and time as written, without its zone; null for notations other than RFC 2822 and ISO with a space."""
    s = F.trim(text(c))
    mail = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(s, _STAMP, 1), F.regexp_extract(s, _STAMP, 2)), F.lit("d MMM yyyy HH:mm:ss"))
    plain = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(s, _PLAIN, 1), F.when(F.regexp_extract(s, _PLAIN, 2) == "", "00:00:00").otherwise(F.regexp_extract(s, _PLAIN, 2))), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(s.rlike(_STAMP), mail).when(s.rlike(_PLAIN), plain)


def unix_time(c: Column) -> Column:
    """Unix seconds of a date text; 0 where it cannot be read."""
    zone = F.regexp_extract(F.trim(text(c)), _STAMP, 3)
    shift = F.when(zone.rlike("^[+-]"), (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    return F.coalesce(F.unix_timestamp(local_time(c)) - shift, F.lit(0)).cast("bigint")


def week_key(t: Column) -> Column:
    """ISO year and week, like 2008-W01."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), t).cast("int"), F.weekofyear(t))


@F.pandas_udf(StringType())
def mail_time(dates: pd.Series) -> pd.Series:
    """Date and time as written (yyyy-MM-dd HH:mm:ss) of a mail's date header, read as leniently as mail programs do; null where it cannot be."""

    def read(d):
        try:
            return parsedate_to_datetime(d).strftime("%Y-%m-%d %H:%M:%S")
        except Exception:  # whatever the parser meets in junk
            return None

    return dates.map(read)


def greeting(body: Column) -> Column:
    """The greeting that a text starts with and what follows it: email, name, username, other or nothing."""
    first = F.regexp_replace(F.regexp_extract(F.regexp_replace(text(body), rf"^{SPACE}+", ""), rf"^([^{BREAKS}]*)", 1), rf"{SPACE}+$", "")
    start = rf"(?iuU)^({'|'.join(GREETINGS)})\b[,\s:!-]*([^\n,!?]*)"
    token, follow = F.lower(F.regexp_extract(first, start, 1)), F.regexp_replace(F.regexp_extract(first, start, 2), rf"{SPACE}+$", "")
    word = F.regexp_extract(follow, r"""(?U)([^\s,;:()<>"']+)""", 1)
    kind = F.when(follow == "", "").when(follow.rlike(r"(?U)[\w.-]+@[\w.-]+\.\w+"), ", email").when(word.rlike(r"^[A-Z][a-z'-]+$"), ", name").when(word.rlike(r"(?U)^[\w.-]{2,}$"), ", username").otherwise(", other")
    return F.when(token == "", F.lit("")).otherwise(F.concat(token, kind))


def person(c: Column, strip_quotes: bool = True) -> tuple[Column, Column]:
    """(name, address) of 'name <address>' or of a bare address, whose local part is the name; blanks else."""
    s = F.trim(text(c))
    form = r"^(.*)<([^<>]+)>\s*$"
    name = F.trim(F.regexp_extract(s, form, 1))
    if strip_quotes:
        name = F.trim(F.regexp_replace(name, '"', ""))
    bare = s.rlike(r"^[^\s<>@]+@[^\s<>@]+$")
    return (F.when(s.rlike(form), name).when(bare, F.substring_index(s, "@", 1)).otherwise(""), F.when(s.rlike(form), F.trim(F.regexp_extract(s, form, 2))).when(bare, s).otherwise(""))


def link_features(urls: Column) -> dict[str, Column]:
    """Counts and flags of a mail's links; the hosts as one text in alphabetical order."""
    urls = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull())
    host = lambda u: F.regexp_extract(F.regexp_replace(u, "https?://", ""), r"^([^/?]*)", 1)
    hosts, n = F.transform(urls, host), F.size(urls)
    count = lambda f: F.size(F.filter(urls, f))
    dots = lambda h: F.greatest(F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) - 1, F.lit(0))
    hyphens = lambda h: F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit("")))
    total = lambda f: F.aggregate(F.transform(F.filter(hosts, lambda h: h != ""), f), F.lit(0), lambda a, x: a + x)
    mean = lambda f: F.when(n > 0, F.round(total(f) / n, 2)).otherwise(F.lit(0.0))
    return {
        "domains": F.array_join(F.array_sort(F.filter(F.array_distinct(hosts), lambda h: h != "")), " "),
        "num_urls": n.cast("bigint"),
        "num_different_domains": F.size(F.array_distinct(hosts)).cast("bigint"),
        "num_urls_with_ip": count(lambda u: host(u).rlike(r"^\d+\.\d+\.\d+\.\d+")).cast("bigint"),
        "num_short_urls": count(lambda u: F.lower(u).rlike("|".join(s.replace(".", r"\.") for s in SHORTENERS))).cast("bigint"),
        "has_at_symbol": (count(lambda u: u.contains("@")) > 0).cast("bigint"),
        "has_non_ascii_chars": (count(lambda u: u.rlike(r"[^\x00-\x7F]")) > 0).cast("bigint"),
        "has_extra_http": (count(lambda u: u.rlike("http.*http")) > 0).cast("bigint"),
        "avg_subdomain_count": mean(dots),
        "avg_hyphen_count": mean(hyphens),
    }


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def shortened(c: Column, most: int) -> Column:
    """White space as single blanks, cut to `most` characters with ... behind."""
    s = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def epoch_number(name: Column) -> Column:
    """The number after 'epoch' in a file name, else its first number; null without one."""
    marked, first = F.regexp_extract(name, r"epoch[_-]?(\d+)", 1), F.regexp_extract(name, r"(\d+)", 1)
    return F.when(marked != "", marked).when(first != "", first).try_cast("int")


def relation_label(src: Column, etype: Column, dst: Column) -> Column:
    return F.concat_ws("->", src, etype, dst)
