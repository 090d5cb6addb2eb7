"""Queries of the campaign operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwork.functions import columns as C
from shoalwork.operators import clustering as K
from shoalwork.operators import features as T
from shoalwork.operators import graph as G
from shoalwork.operators import links as L
from shoalwork.operators import scaling as S
from shoalwork.operators import training as R
from shoalwork.operators.packed import split_packed
from shoalwork.plans.cut import cut
from shoalwork.sources.files import to_events
from shoalwork.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def raw(spark, folder):
    return table(spark, folder, "trec07_misp")


def mail(spark, folder):
    return G.mails(raw(spark, folder))


def edge(spark, folder):
    return G.edges(mail(spark, folder))


# Pieces of SQL that several queries share.
_ADDR = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_NORM = r"lower(trim(CASE WHEN regexp_matches({0}, '<[^>]*>') THEN regexp_extract({0}, '<([^>]*)>', 1) ELSE {0} END))"
_FREE = "'gmail.com','googlemail.com','yahoo.com','yahoo.co.uk','outlook.com','hotmail.com','live.com','aol.com','icloud.com','proton.me','protonmail.com','gmx.com','yandex.com'"
_STAMP = r"^(?:[A-Za-z]{3}, )?(\d{1,2} [A-Za-z]{3} \d{4}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4}|GMT|UTC)$"
_PLAIN = r"^(\d{4}-\d{2}-\d{2})(?: (\d{2}:\d{2}:\d{2}))?$"
MAILS = rf"""
r AS (SELECT email_index, coalesce(sender, '') AS s, coalesce(receiver, '') AS rc, coalesce(subject, '') AS subject, coalesce(body, '') AS body, trim(coalesce(date, '')) AS d, urls FROM trec07_misp),
t AS (SELECT *, CASE WHEN regexp_matches(d, '{_STAMP}') THEN try_strptime(regexp_extract(d, '{_STAMP}', 1) || ' ' || regexp_extract(d, '{_STAMP}', 2), '%d %b %Y %H:%M:%S')
                     WHEN regexp_matches(d, '{_PLAIN}') THEN try_strptime(regexp_extract(d, '{_PLAIN}', 1) || ' ' || CASE WHEN regexp_extract(d, '{_PLAIN}', 2) = '' THEN '00:00:00' ELSE regexp_extract(d, '{_PLAIN}', 2) END, '%Y-%m-%d %H:%M:%S') END AS lt,
             regexp_extract(d, '{_STAMP}', 3) AS z FROM r),
m AS (SELECT email_index,
        CASE WHEN len(regexp_extract_all(s, '{_ADDR}')) > 0 THEN lower(regexp_extract_all(s, '{_ADDR}')[1])
             WHEN len(list_filter(string_split_regex(s, '[,;]'), lambda x: contains(x, '@'))) > 0 THEN list_filter(list_transform(string_split_regex(s, '[,;]'), lambda x: {_NORM.format('x')}), lambda x: contains(x, '@'))[1]
             ELSE {_NORM.format('s')} END AS sender,
        list_distinct(CASE WHEN len(regexp_extract_all(rc, '{_ADDR}')) > 0 THEN list_transform(regexp_extract_all(rc, '{_ADDR}'), lambda x: lower(x))
             ELSE list_filter(list_transform(string_split_regex(rc, '[,;]'), lambda x: {_NORM.format('x')}), lambda x: contains(x, '@')) END) AS receivers,
        subject, body, list_distinct(list_filter(list_transform(coalesce(urls, []), lambda u: trim(coalesce(u, ''))), lambda u: u <> '')) AS urls, lt,
        CASE WHEN lt IS NULL THEN 0 ELSE CAST(epoch(lt) AS BIGINT) - CASE WHEN starts_with(z, '+') OR starts_with(z, '-') THEN (CAST(z[2:3] AS INT) * 3600 + CAST(z[4:5] AS INT) * 60) * CASE WHEN starts_with(z, '-') THEN -1 ELSE 1 END ELSE 0 END END AS ts,
        CASE WHEN lt IS NULL THEN '' ELSE strftime(lt, '%G-W%V') END AS week
      FROM t)"""
_HTTP = "CASE WHEN regexp_matches(u, '^https?://', 'i') THEN u ELSE 'http://' || u END"
_DOMAIN = "CASE WHEN contains({0}, '@') THEN lower(trim(string_split({0}, '@')[-1])) ELSE '' END"
EDGES = rf"""{MAILS},
lk AS (SELECT email_index, u, lower(regexp_extract({_HTTP}, '^https?://([^/?#]*)', 1, 'i')) AS host,
         CASE WHEN regexp_replace(regexp_replace({_HTTP}, '^https?://[^/?#]*', '', 'i'), '[?#;]$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace({_HTTP}, '^https?://[^/?#]*', '', 'i'), '[?#;]$', '') END AS stem
       FROM (SELECT email_index, unnest(urls) AS u FROM m)),
rcv AS (SELECT email_index, unnest(receivers) AS k FROM m),
e AS (SELECT 'has_sender' AS etype, CAST(email_index AS VARCHAR) AS src, sender AS dst, email_index FROM m WHERE sender <> ''
  UNION ALL SELECT 'has_receiver', CAST(email_index AS VARCHAR), k, email_index FROM rcv
  UNION ALL SELECT 'in_week', CAST(email_index AS VARCHAR), week, email_index FROM m WHERE week <> ''
  UNION ALL SELECT 'has_url', CAST(email_index AS VARCHAR), u, email_index FROM lk
  UNION ALL SELECT 'has_domain', CAST(email_index AS VARCHAR), host, email_index FROM lk WHERE host <> ''
  UNION ALL SELECT 'has_stem', CAST(email_index AS VARCHAR), stem, email_index FROM lk
  UNION ALL SELECT 'sender_from_domain', sender, d, min(email_index) FROM (SELECT sender, email_index, {_DOMAIN.format('sender')} AS d FROM m) WHERE d <> '' AND d NOT IN ({_FREE}) GROUP BY sender, d
  UNION ALL SELECT 'receiver_from_domain', k, d, min(email_index) FROM (SELECT k, email_index, {_DOMAIN.format('k')} AS d FROM rcv) WHERE d <> '' AND d NOT IN ({_FREE}) GROUP BY k, d)"""
_TARGET = "CASE etype WHEN 'has_sender' THEN 'sender' WHEN 'has_receiver' THEN 'receiver' WHEN 'in_week' THEN 'week' WHEN 'has_url' THEN 'url' WHEN 'has_domain' THEN 'domain' WHEN 'has_stem' THEN 'stem' ELSE 'email_domain' END"
_SOURCE = "CASE etype WHEN 'sender_from_domain' THEN 'sender' WHEN 'receiver_from_domain' THEN 'receiver' ELSE 'email' END"
ENDS = rf"""{EDGES}, ends AS (SELECT etype, {_SOURCE} AS ntype, src AS key, 'src' AS side FROM e UNION ALL SELECT etype, {_TARGET}, dst, 'dst' FROM e)"""


# --- sources, filters, counts over months


@query("SELECT email_index, label, orig_csv_index FROM trec07_misp WHERE label = 1")
def label_filter(spark, folder):
    return raw(spark, folder).where("label = 1").select("email_index", "label", "orig_csv_index")


@query(f"""WITH {MAILS}, c AS (SELECT CAST(date_trunc('month', make_timestamp(ts * 1000000)) AS DATE) AS month, count(*) AS n FROM m WHERE ts > 0 GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM c) SELECT s.month, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN c USING (month)""")
def monthly_counts(spark, folder):
    return T.monthly_counts(mail(spark, folder).select("ts"))


@query(f"""WITH {MAILS}, c AS (SELECT CAST(date_trunc('month', make_timestamp(ts * 1000000)) AS DATE) AS month, count(*) AS n FROM m WHERE ts > 0 GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM c),
f AS (SELECT s.month, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (month)),
w AS (SELECT month, sum(n) OVER (ORDER BY month ROWS 5 PRECEDING) AS total, count(*) OVER (ORDER BY month ROWS 5 PRECEDING) AS rows FROM f)
SELECT CAST(month - INTERVAL 5 MONTH AS DATE) AS first_month, month AS last_month, CAST(total AS BIGINT) AS total FROM w WHERE rows = 6 ORDER BY total DESC, month LIMIT 1""")
def best_months(spark, folder):
    return T.best_months(mail(spark, folder).select("ts"), 6)


@query(f"""WITH {MAILS} SELECT email_index, sender, array_to_string(list_sort(receivers), ' ') AS receivers, len(subject) AS len_subject, len(body) AS len_body, array_to_string(list_sort(urls), ' ') AS urls, CAST(ts AS BIGINT) AS ts, week FROM m""")
def mail_rows(spark, folder):
    m = mail(spark, folder)
    return m.select("email_index", "sender", F.array_join(F.array_sort("receivers"), " ").alias("receivers"), F.length("subject").cast("bigint").alias("len_subject"), F.length("body").cast("bigint").alias("len_body"), F.array_join(F.array_sort("urls"), " ").alias("urls"), "ts", "week")


@query("""SELECT p.email_index, count(*) AS documents, CAST(max(len(coalesce(t.subject, ''))) AS BIGINT) AS len_subject FROM
(SELECT email_index FROM misp_raw WHERE json_valid(payload)) p JOIN trec07_misp t USING (email_index) GROUP BY 1""")
def event_documents(spark, folder):
    parsed = G.parse_events(table(spark, folder, "misp_raw"))
    return parsed.groupBy("email_index").agg(F.count(F.lit(1)).alias("documents"), F.max(F.length("subject")).cast("bigint").alias("len_subject"))


@query(f"""WITH {MAILS} SELECT email_index, sender, array_to_string(list_sort(receivers), ' ') AS receivers, len(body) AS len_body FROM m""")
def event_round_trip(spark, folder):
    parsed = G.parse_events(to_events(raw(spark, folder)))
    return parsed.select("email_index", "sender", F.array_join(F.array_sort("receivers"), " ").alias("receivers"), F.length("body").cast("bigint").alias("len_body"))


# --- scalar functions


@query(r"""WITH x AS (SELECT email_index, unnest(list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '(?:https?://|www\.)[^\s''"<>]+', 0, 'i'), lambda u: regexp_replace(u, '[.,;:!?)]+$', '')), lambda u: u <> '')) AS url FROM trec07_misp)
SELECT email_index, url, count(*) AS n FROM x GROUP BY 1, 2""")
def link_extract(spark, folder):
    return raw(spark, folder).select("email_index", F.explode(C.links(F.col("body"))).alias("url")).groupBy("email_index", "url").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES} SELECT DISTINCT u AS url, host, stem, lower(regexp_extract({_HTTP}, '^(https?)://', 1, 'i')) AS scheme FROM lk")
def link_parse(spark, folder):
    u = F.col("url")
    return mail(spark, folder).select(F.explode("urls").alias("url")).distinct().select("url", C.link_host(u).alias("host"), C.link_path(u).alias("stem"), C.link_scheme(u).alias("scheme"))


@query("""WITH x AS (SELECT email_index, unnest(urls) AS u, generate_subscripts(urls, 1) AS i FROM trec07_misp), k AS (SELECT *, regexp_replace(lower(u), '/+$', '') AS key FROM x WHERE u IS NOT NULL)
SELECT email_index, arg_min(u, i) AS url FROM k GROUP BY email_index, key""")
def link_dedup(spark, folder):
    return raw(spark, folder).select("email_index", F.explode(C.distinct_links(F.filter("urls", lambda u: u.isNotNull()))).alias("url"))


@query(f"WITH {MAILS} SELECT email_index, unnest(receivers) AS address FROM m")
def address_extract(spark, folder):
    return raw(spark, folder).select("email_index", F.explode(C.addresses(F.col("receiver"))).alias("address"))


@query(f"WITH {MAILS} SELECT d AS domain, d IN ({_FREE}) AS freemail, count(*) AS n FROM (SELECT {_DOMAIN.format('sender')} AS d FROM m) GROUP BY 1, 2")
def sender_domains(spark, folder):
    d = C.email_domain(F.col("sender"))
    return mail(spark, folder).select(d.alias("domain"), C.is_freemail(d).alias("freemail")).groupBy("domain", "freemail").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {EDGES}, h AS (SELECT DISTINCT host AS s FROM lk WHERE host <> ''), c AS (SELECT s, unnest(string_split(s, '')) AS ch FROM h),
f AS (SELECT s, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2), en AS (SELECT f.s, -sum(n / len(f.s) * log2(n / len(f.s))) AS entropy FROM f GROUP BY f.s)
SELECT s AS host, CAST(len(s) AS DOUBLE) AS length, CAST(len(regexp_extract_all(s, '\p{{Nd}}')) AS DOUBLE) AS digits, CAST(len(regexp_extract_all(s, '-')) AS DOUBLE) AS hyphens, CAST(len(regexp_extract_all(s, '\p{{L}}')) AS DOUBLE) AS letters,
CAST(len(regexp_extract_all(s, '[^\p{{L}}\p{{N}}]')) AS DOUBLE) AS others, round(len(regexp_extract_all(s, '\p{{Nd}}')) / len(s), 6) AS digit_share, round(len(regexp_extract_all(s, '-')) / len(s), 6) AS hyphen_share, round(entropy, 6) AS entropy FROM h JOIN en USING (s)""")
def lexical_features(spark, folder):
    hosts = edge(spark, folder).where("etype = 'has_domain'").select(F.col("dst").alias("host")).distinct().withColumn("x", C.lexical(F.col("host")))
    names = ("length", "digits", "hyphens", "letters", "others", "digit_share", "hyphen_share", "entropy")
    return hosts.select("host", *((F.round(F.col("x")[i], 6) if i > 4 else F.col("x")[i]).alias(n) for i, n in enumerate(names)))


@query(f"WITH {MAILS} SELECT email_index, CAST(ts AS BIGINT) AS ts, week FROM m")
def mail_times(spark, folder):
    return mail(spark, folder).select("email_index", "ts", "week")


_WIDE_TIME = "CAST(day(lt) AS BIGINT) AS day, CAST(month(lt) AS BIGINT) AS month, CAST(year(lt) AS BIGINT) AS year, dayname(lt) AS weekday, CAST(isodow(lt) < 6 AS BIGINT) AS workday, strftime(lt, '%Y-%m-%d') AS date_sent, strftime(lt, '%H:%M:%S') AS time_sent"


_DAYS = "'mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'"
_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"
_MON = f"coalesce(list_position(list_transform({_MONTHS}, lambda x: x[1:3]), {{0}}), list_position({_MONTHS}, {{0}}))"
#: The date header taken apart by words, as mail programs do: an optional weekday, day, month, year, clock and zone, some of them in either order.
_DATED = rf"""w0 AS (SELECT email_index, regexp_extract_all(coalesce(date, ''), '[^\s\p{{Z}}]+') AS w FROM trec07_misp),
w1 AS (SELECT email_index, CASE WHEN len(w) = 0 THEN w WHEN ends_with(w[1], ',') OR lower(w[1]) IN ({_DAYS}) THEN w[2:] WHEN contains(w[1], ',') THEN list_prepend(regexp_replace(w[1], '^.*,', ''), w[2:]) ELSE w END AS w FROM w0),
w2 AS (SELECT email_index, CASE WHEN len(w) = 3 AND len(string_split(w[1], '-')) = 3 THEN string_split(w[1], '-') || w[2:] ELSE w END AS w FROM w1),
w3 AS (SELECT email_index, w, CASE WHEN len(w) = 4 THEN CASE WHEN contains(w[4], '+') THEN instr(w[4], '+') ELSE instr(w[4], '-') END ELSE 0 END AS i FROM w2),
w4 AS (SELECT email_index, CASE WHEN len(w) = 4 AND i > 1 THEN w[1:3] || [w[4][1:i-1], w[4][i:]] WHEN len(w) = 4 THEN w || [''] ELSE w END AS w FROM w3),
w5 AS (SELECT email_index, w[1] AS dd, lower(w[2]) AS mm, w[3] AS yy, w[4] AS tm, w[5] AS tz FROM w4 WHERE len(w) >= 5),
w6 AS (SELECT email_index, CASE WHEN {_MON.format('mm')} IS NULL THEN mm ELSE dd END AS dd, coalesce({_MON.format('mm')}, {_MON.format('lower(dd)')}) AS mo, yy, tm, tz FROM w5),
w7 AS (SELECT email_index, regexp_replace(dd, ',$', '') AS dd, mo, CASE WHEN instr(yy, ':') > 1 THEN tm ELSE yy END AS yy, CASE WHEN instr(yy, ':') > 1 THEN yy ELSE tm END AS tm, tz FROM w6 WHERE mo IS NOT NULL),
w8 AS (SELECT email_index, dd, mo, regexp_replace(yy, ',$', '') AS yy, tm, tz FROM w7),
w9 AS (SELECT email_index, dd, mo, CASE WHEN regexp_matches(yy, '^\d') THEN yy ELSE tz END AS yy, regexp_replace(tm, ',$', '') AS tm, CASE WHEN regexp_matches(yy, '^\d') THEN tz ELSE yy END AS tz FROM w8 WHERE yy <> ''),
wa AS (SELECT email_index, dd, mo, yy, tz, CASE WHEN contains(tm, ':') THEN string_split(tm, ':') ELSE string_split(tm, '.') END AS c FROM w9),
wb AS (SELECT email_index, mo, TRY_CAST(dd AS INT) AS dd, TRY_CAST(yy AS INT) + CASE WHEN TRY_CAST(yy AS INT) >= 100 THEN 0 WHEN TRY_CAST(yy AS INT) > 68 THEN 1900 ELSE 2000 END AS yy, TRY_CAST(c[1] AS INT) AS hh, TRY_CAST(c[2] AS INT) AS mi, TRY_CAST(coalesce(c[3], '0') AS INT) AS ss, tz FROM wa
  WHERE len(c) IN (2, 3) AND regexp_matches(dd, '^\d{{1,6}}$') AND regexp_matches(yy, '^\d{{1,6}}$') AND regexp_matches(c[1], '^\d{{1,6}}$') AND regexp_matches(c[2], '^\d{{1,6}}$') AND regexp_matches(coalesce(c[3], '0'), '^\d{{1,6}}$')),
lt AS (SELECT email_index, try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', yy, mo, dd, hh, mi, ss), '%Y-%m-%d %H:%M:%S') AS lt FROM wb
  WHERE hh < 24 AND mi < 60 AND ss < 60 AND yy <= 9999 AND NOT (regexp_matches(tz, '^[+-]?\d{{1,9}}$') AND (abs(TRY_CAST(tz AS INT)) // 100) * 3600 + (abs(TRY_CAST(tz AS INT)) % 100) * 60 >= 86400))"""


@query(f"WITH {_DATED} SELECT t.email_index, {_WIDE_TIME} FROM trec07_misp t LEFT JOIN lt USING (email_index)")
def time_features(spark, folder):
    return T.feature_set(wide(spark, folder), "fs1").select("email_index", *T.TIME)


def wide(spark, folder):
    return T.features(raw(spark, folder), table(spark, folder, "idf_terms"))


_IDF = "i AS (SELECT lower(trim(term)) AS term, max(coalesce(round(idf, 3), 0)) AS idf FROM idf_terms WHERE term IS NOT NULL GROUP BY 1)"
_SUBJECT = rf"""{_IDF}, st AS (SELECT email_index, unnest(list_filter(string_split_regex(lower(coalesce(subject, '')), '[\t\n\x0B\f\r\x1C-\x20\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) AS term FROM trec07_misp),
sa AS (SELECT email_index, avg(coalesce(idf, 0)) AS a, max(coalesce(idf, 0)) AS mx, count(*) AS n FROM st LEFT JOIN i USING (term) GROUP BY 1)"""


@query(rf"""WITH {_SUBJECT} SELECT t.email_index, len(coalesce(subject, '')) AS subject_length, CAST(len(regexp_extract_all(coalesce(subject, ''), '[\t\n\x0B\f\r\x1C-\x20\x{{85}}\p{{Z}}]')) AS BIGINT) AS subject_whitespace_count, coalesce(subject, '') AS subject,
round(coalesce(a, 0), 6) AS subject_avg_idf, coalesce(mx, 0) AS subject_max_idf, coalesce(n, 0) AS subject_n_terms FROM trec07_misp t LEFT JOIN sa USING (email_index)""")
def subject_features(spark, folder):
    return T.feature_set(wide(spark, folder), "fs1").select("email_index", *T.SUBJECT)


_BODY_SQL = r"""b AS (SELECT email_index, coalesce(body, '') AS body, regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}_]+') AS w,
  list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '(?:https?://|www\.)[^\s''"<>]+', 0, 'i'), lambda u: regexp_replace(u, '[.,;:!?)]+$', '')), lambda u: u <> '') AS lks FROM trec07_misp),
g AS (SELECT email_index, regexp_extract(trim(regexp_extract(regexp_replace(body, '^[\t\n\x0B\f\r\x1C-\x20\x{85}\p{Z}]+', ''), '^([^\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]*)', 1)), '(?i)^(good morning|good afternoon|good evening|dearest|greetings|hello|hi|hey|dear)\b', 1) AS tok,
  trim(regexp_extract(trim(regexp_extract(regexp_replace(body, '^[\t\n\x0B\f\r\x1C-\x20\x{85}\p{Z}]+', ''), '^([^\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]*)', 1)), '(?i)^(?:good morning|good afternoon|good evening|dearest|greetings|hello|hi|hey|dear)\b[,\s\p{Z}:!-]*([^\n,!?]*)', 1)) AS fol FROM b),
gg AS (SELECT email_index, CASE WHEN tok = '' THEN '' ELSE lower(tok) || CASE WHEN fol = '' THEN '' WHEN regexp_matches(fol, '[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+') THEN ', email' WHEN regexp_matches(regexp_extract(fol, '([^\s\p{Z},;:()<>"'']+)', 1), '^[A-Z][a-z''-]+$') THEN ', name'
  WHEN regexp_matches(regexp_extract(fol, '([^\s\p{Z},;:()<>"'']+)', 1), '^[\p{L}\p{N}_.-]{2,}$') THEN ', username' ELSE ', other' END END AS greeting FROM g)"""


@query(rf"""WITH {_BODY_SQL} SELECT b.email_index, CAST(len(lks) > 0 AS BIGINT) AS has_urls, len(w) AS body_word_count,
CAST(CASE WHEN body = '' THEN 0 ELSE len(string_split_regex(regexp_replace(body, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r')) END AS BIGINT) AS num_lines,
CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: len(x))) / len(w), 1) ELSE 0.0 END AS avg_word_length, greeting FROM b JOIN gg USING (email_index)""")
def body_features(spark, folder):
    return T.feature_set(wide(spark, folder), "fs1").select("email_index", "has_urls", "body_word_count", "num_lines", "avg_word_length", "greeting")


_PERSON = r"""CASE WHEN regexp_matches({0}, '^(.*)<([^<>]+)>\s*$') THEN {1} WHEN regexp_matches({0}, '^[^\s<>@]+@[^\s<>@]+$') THEN string_split({0}, '@')[1] ELSE '' END AS {2}_name,
CASE WHEN regexp_matches({0}, '^(.*)<([^<>]+)>\s*$') THEN trim(regexp_extract({0}, '^(.*)<([^<>]+)>\s*$', 2)) WHEN regexp_matches({0}, '^[^\s<>@]+@[^\s<>@]+$') THEN {0} ELSE '' END AS {2}_email"""


@query(rf"""WITH p AS (SELECT email_index, trim(coalesce(sender, '')) AS s, trim(coalesce(receiver, '')) AS q FROM trec07_misp) SELECT email_index,
{_PERSON.format('s', "trim(replace(trim(regexp_extract(s, '^(.*)<([^<>]+)>\\s*$', 1)), '" + '"' + "', ''))", 'sender')}, {_PERSON.format('q', "trim(regexp_extract(q, '^(.*)<([^<>]+)>\\s*$', 1))", 'recipient')} FROM p""")
def participant_features(spark, folder):
    return T.feature_set(wide(spark, folder), "fs1").select("email_index", *T.ORIGIN, *T.RECEIVER)


@query(r"""WITH p AS (SELECT email_index, list_filter(coalesce(urls, []), lambda u: u IS NOT NULL) AS us FROM trec07_misp),
h AS (SELECT *, list_transform(us, lambda u: regexp_extract(regexp_replace(u, 'https?://', '', 'g'), '^([^/?]*)', 1)) AS hs FROM p)
SELECT email_index, array_to_string(list_sort(list_filter(list_distinct(hs), lambda x: x <> '')), ' ') AS domains, len(us) AS num_urls, len(list_distinct(hs)) AS num_different_domains,
len(list_filter(hs, lambda x: regexp_matches(x, '^\d+\.\d+\.\d+\.\d+'))) AS num_urls_with_ip, len(list_filter(us, lambda u: regexp_matches(lower(u), 'bit\.ly|tinyurl\.com|short\.link|ow\.ly|goo\.gl'))) AS num_short_urls,
CAST(len(list_filter(us, lambda u: contains(u, '@'))) > 0 AS BIGINT) AS has_at_symbol, CAST(len(list_filter(us, lambda u: regexp_matches(u, '[^\x00-\x7F]'))) > 0 AS BIGINT) AS has_non_ascii_chars, CAST(len(list_filter(us, lambda u: regexp_matches(u, 'http.*http'))) > 0 AS BIGINT) AS has_extra_http,
CASE WHEN len(us) > 0 THEN round(coalesce(list_sum(list_transform(list_filter(hs, lambda x: x <> ''), lambda x: greatest(len(x) - len(replace(x, '.', '')) - 1, 0))), 0) / len(us), 2) ELSE 0.0 END AS avg_subdomain_count,
CASE WHEN len(us) > 0 THEN round(coalesce(list_sum(list_transform(list_filter(hs, lambda x: x <> ''), lambda x: len(x) - len(replace(x, '-', '')))), 0) / len(us), 2) ELSE 0.0 END AS avg_hyphen_count FROM h""")
def link_features(spark, folder):
    return T.feature_set(wide(spark, folder), "fs1").select("email_index", *T.URLS)


def _feature_query(name: str):
    def run(spark, folder):
        return T.feature_set(wide(spark, folder), name)

    run.__name__ = name
    return run


_PARTS = " JOIN ".join(f"({SQL[n]}) USING (email_index)" if i else f"({SQL[n]})" for i, n in enumerate(("time_features", "subject_features", "body_features", "participant_features", "link_features")))

for _name, (_groups, _dropped) in T.FEATURE_SETS.items():
    QUERIES[_name] = _feature_query(_name)
    SQL[_name] = f"SELECT email_index, {', '.join(dict.fromkeys(c for g in _groups for c in g if c not in _dropped))} FROM {_PARTS} JOIN (SELECT email_index, coalesce(body, '') AS body FROM trec07_misp) USING (email_index)"


# --- the graph


@query(f"WITH {EDGES} SELECT etype, src, dst, count(*) AS n FROM e GROUP BY 1, 2, 3")
def edge_list(spark, folder):
    return edge(spark, folder).groupBy("etype", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES}, k AS (SELECT {_TARGET} AS ntype, dst AS key, min(email_index) AS f FROM e GROUP BY 1, 2) SELECT ntype, key, row_number() OVER (PARTITION BY ntype ORDER BY f, key) - 1 AS idx FROM k")
def node_index(spark, folder):
    return G.node_index(edge(spark, folder))


@query(f"WITH {EDGES} SELECT {_TARGET} AS ntype, dst AS key, count(DISTINCT email_index) AS docfreq FROM e WHERE etype NOT LIKE '%from_domain' GROUP BY 1, 2")
def docfreq(spark, folder):
    return G.document_frequency(edge(spark, folder))


@query(f"WITH {EDGES} SELECT m.email_index, CAST(m.ts AS BIGINT) AS ts, len(body) AS len_body, len(subject) AS len_subject, coalesce(n, 0) AS n_urls FROM m LEFT JOIN (SELECT email_index, count(DISTINCT host) AS n FROM lk WHERE host <> '' GROUP BY 1) USING (email_index)")
def email_attrs(spark, folder):
    hosts = F.array_distinct(F.filter(F.transform("urls", C.link_host), lambda d: d != ""))
    return mail(spark, folder).select("email_index", "ts", F.length("body").cast("bigint").alias("len_body"), F.length("subject").cast("bigint").alias("len_subject"), F.size(hosts).cast("bigint").alias("n_urls"))


@query(f"WITH {ENDS} SELECT ntype, key, count(*) AS degree FROM ends GROUP BY 1, 2")
def degree_all(spark, folder):
    return G.degrees(edge(spark, folder))


@query(f"""WITH {ENDS}, nd AS (SELECT DISTINCT ntype, key FROM ends UNION SELECT 'email', CAST(email_index AS VARCHAR) FROM m), tot AS (SELECT ntype, count(*) AS nodes FROM nd GROUP BY 1),
per AS (SELECT etype, ntype, side, key, count(*) AS d FROM ends GROUP BY 1, 2, 3, 4), s AS (SELECT etype, ntype, side, count(*) AS any_n, count(*) FILTER (d = 1) AS one, count(*) FILTER (d >= 2) AS many FROM per GROUP BY 1, 2, 3)
SELECT etype, side, ntype, nodes, round(100.0 * (nodes - any_n) / nodes, 4) AS deg0_pct, round(100.0 * one / nodes, 4) AS deg1_pct, round(100.0 * many / nodes, 4) AS many_pct FROM s JOIN tot USING (ntype)""")
def degree_buckets(spark, folder):
    e = edge(spark, folder)
    nodes = G.endpoints(e).select("ntype", "key").unionByName(raw(spark, folder).select(F.lit("email").alias("ntype"), F.col("email_index").cast("string").alias("key"))).distinct()
    return G.connectivity(e, nodes)


@query(f"WITH {EDGES}, c AS (SELECT etype, dst AS key, count(*) AS n FROM e WHERE etype IN ('has_url', 'has_receiver', 'has_stem', 'has_domain', 'has_sender') GROUP BY 1, 2) SELECT etype, key, n, row_number() OVER (PARTITION BY etype ORDER BY n DESC, key) AS rank FROM c QUALIFY rank <= 10")
def top_entities(spark, folder):
    from pyspark.sql import Window

    counted = edge(spark, folder).where(F.col("etype").isin("has_url", "has_receiver", "has_stem", "has_domain", "has_sender")).groupBy("etype", F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("etype").orderBy(F.desc("n"), "key"))).where("rank <= 10")


@query(f"WITH {MAILS} SELECT week, count(*) AS n, repeat('█', CAST(least(50, count(*) // 10) AS INT)) AS bar FROM m WHERE week <> '' GROUP BY 1")
def week_distribution(spark, folder):
    return mail(spark, folder).where("week <> ''").groupBy("week").agg(F.count(F.lit(1)).alias("n")).select("week", "n", F.expr("repeat('█', int(least(50, n div 10)))").alias("bar"))


@query(f"WITH {ENDS}, nn AS (SELECT ntype, count(DISTINCT key) AS n FROM ends GROUP BY 1), ee AS (SELECT etype, count(*) AS n FROM e GROUP BY 1) SELECT 'node' AS part, ntype AS name, n FROM nn UNION ALL SELECT 'edge', etype, n FROM ee UNION ALL SELECT 'node', 'TOTAL', CAST(sum(n) AS BIGINT) FROM nn UNION ALL SELECT 'edge', 'TOTAL', CAST(sum(n) AS BIGINT) FROM ee")
def graph_summary(spark, folder):
    e = edge(spark, folder)
    nodes = G.endpoints(e).select("ntype", "key").distinct().groupBy(F.col("ntype").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("node"))
    kinds = e.groupBy(F.col("etype").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("edge"))
    return nodes.unionByName(kinds).rollup("part", "name").agg(F.sum("n").alias("n")).where("part is not null").select("part", F.coalesce("name", F.lit("TOTAL")).alias("name"), "n")


@query(f"WITH {EDGES} SELECT etype, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT etype, src, dst FROM e UNION ALL SELECT 'rev_' || etype, dst, src FROM e) GROUP BY 1")
def undirected_edges(spark, folder):
    return G.undirected(edge(spark, folder)).groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


_COLLAPSE = f"""{ENDS}, d1 AS (SELECT key FROM ends WHERE ntype = 'email_domain' GROUP BY key HAVING count(*) = 1),
c1 AS (SELECT 'email_domain' AS ntype, dst AS key, CASE etype WHEN 'sender_from_domain' THEN 'sender' ELSE 'receiver' END AS ptype, src AS parent FROM e WHERE etype LIKE '%from_domain' AND dst IN (SELECT key FROM d1)),
e1 AS (SELECT * FROM e WHERE NOT (etype LIKE '%from_domain' AND dst IN (SELECT key FROM d1))),
d2 AS (SELECT ntype, key FROM (SELECT {_TARGET} AS ntype, dst AS key FROM e1 UNION ALL SELECT {_SOURCE}, src FROM e1) WHERE ntype IN ('sender', 'receiver', 'url', 'domain', 'stem') GROUP BY 1, 2 HAVING count(*) = 1),
c2 AS (SELECT {_TARGET} AS ntype, dst AS key, 'email' AS ptype, src AS parent FROM e1 JOIN d2 ON d2.ntype = {_TARGET} AND d2.key = dst WHERE etype NOT LIKE '%from_domain'),
col AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
ke AS (SELECT e1.* FROM e1 WHERE NOT EXISTS (SELECT 1 FROM d2 WHERE d2.key = e1.dst AND d2.ntype = {_TARGET}))"""


@query(f"WITH {_COLLAPSE} SELECT ntype, key, ptype, parent, len(key) AS len FROM col")
def collapse_nodes(spark, folder):
    return G.collapse_single(edge(spark, folder))[1].select("ntype", "key", "ptype", "parent", F.length("key").cast("bigint").alias("len"))


@query(f"WITH {_COLLAPSE} SELECT etype, count(*) AS n, count(DISTINCT dst) AS targets FROM ke GROUP BY 1")
def collapse_edges(spark, folder):
    return G.collapse_single(edge(spark, folder))[0].groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("targets"))


@query(f"""WITH {_COLLAPSE}, inn AS (SELECT ptype AS ntype, parent AS key, sum(len(key)) AS i FROM c1 GROUP BY 1, 2), o AS (SELECT c2.*, i FROM c2 LEFT JOIN inn USING (ntype, key))
SELECT parent AS email, CAST(coalesce(sum(len(key)) FILTER (ntype = 'sender'), 0) AS DOUBLE) AS sender_len, CAST(coalesce(sum(i) FILTER (ntype = 'sender'), 0) AS DOUBLE) AS sender_domain_len,
CAST(coalesce(sum(len(key)) FILTER (ntype = 'receiver'), 0) AS DOUBLE) AS receiver_len, CAST(coalesce(sum(i) FILTER (ntype = 'receiver'), 0) AS DOUBLE) AS receiver_domain_len,
CAST(count(*) FILTER (ntype = 'url') AS DOUBLE) AS url_n, CAST(count(*) FILTER (ntype = 'domain') AS DOUBLE) AS domain_n, CAST(coalesce(sum(len(key)) FILTER (ntype = 'stem'), 0) AS DOUBLE) AS stem_len FROM o GROUP BY 1""")
def collapse_sums(spark, folder):
    return G.collapsed_sums(G.collapse_single(edge(spark, folder))[1])


_NUMBERED = f"""f AS (SELECT {_TARGET} AS ntype, dst AS key, min(email_index) AS first FROM ke GROUP BY 1, 2), ix AS (SELECT ntype, key, row_number() OVER (PARTITION BY ntype ORDER BY first, key) - 1 AS idx FROM f)"""


@query(f"WITH {_COLLAPSE}, {_NUMBERED} SELECT ntype, key, CAST(idx AS BIGINT) AS idx FROM ix")
def collapse_index(spark, folder):
    return G.node_index(G.collapse_single(edge(spark, folder))[0])


@query(f"""WITH {_COLLAPSE}, {_NUMBERED} SELECT etype, CAST(CASE WHEN {_SOURCE} = 'email' THEN CAST(src AS BIGINT) ELSE s.idx END AS BIGINT) AS src, CAST(t.idx AS BIGINT) AS dst FROM ke
JOIN ix t ON t.ntype = {_TARGET} AND t.key = dst LEFT JOIN ix s ON s.ntype = {_SOURCE} AND s.key = src""")
def indexed_edges(spark, folder):
    kept = cut(G.collapse_single(edge(spark, folder))[0])
    return G.indexed_edges(kept, G.node_index(kept))


@query(f"""WITH {ENDS}, nd AS (SELECT DISTINCT ntype, key FROM ends WHERE ntype <> 'week') SELECT DISTINCT etype, src, dst FROM e WHERE etype <> 'in_week'""")
def merged_edges(spark, folder):
    """Edges of a graph that was handed over twice and without its weeks."""
    e = edge(spark, folder)
    nodes = G.endpoints(e).where("ntype <> 'week'").select("ntype", "key")
    return G.merged(nodes, e.unionByName(e))[1]


@query(f"WITH {EDGES} SELECT etype, src, dst, count(*) AS n FROM e WHERE etype IN ('has_sender', 'has_receiver', 'has_domain', 'has_stem', 'has_url') GROUP BY 1, 2, 3")
def type_filter(spark, folder):
    return G.without_types(edge(spark, folder), ("week", "email_domain")).groupBy("etype", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES} SELECT dst AS key, count(*) AS degree FROM e WHERE etype = 'has_receiver' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_receiver(spark, folder):
    return G.top_receiver(edge(spark, folder))


@query(f"""WITH {EDGES}, d AS (SELECT DISTINCT etype, src, dst FROM e), hub AS (SELECT dst AS receiver FROM e WHERE etype = 'has_receiver' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ml AS (SELECT src AS email, receiver FROM d JOIN hub ON d.dst = receiver WHERE etype = 'has_receiver'), sn AS (SELECT a.src AS email, a.dst AS sender, b.dst AS sender_domain FROM d a JOIN d b ON a.etype = 'has_sender' AND b.etype = 'sender_from_domain' AND a.dst = b.src)
SELECT ml.email, ml.receiver, sn.sender, sn.sender_domain, rd.dst AS receiver_domain, u.dst AS url, dm.dst AS domain, st.dst AS stem, wk.dst AS week FROM ml LEFT JOIN sn USING (email) LEFT JOIN d rd ON rd.etype = 'receiver_from_domain' AND rd.src = ml.receiver
LEFT JOIN d u ON u.etype = 'has_url' AND u.src = ml.email LEFT JOIN d dm ON dm.etype = 'has_domain' AND dm.src = ml.email LEFT JOIN d st ON st.etype = 'has_stem' AND st.src = ml.email LEFT JOIN d wk ON wk.etype = 'in_week' AND wk.src = ml.email""")
def receiver_neighbourhood(spark, folder):
    return G.receiver_neighbourhood(edge(spark, folder))


@query(f"WITH {EDGES}, c AS (SELECT dst, count(DISTINCT email_index) AS n FROM e WHERE etype = 'has_stem' GROUP BY 1) SELECT count(*) FILTER (n > 1) AS stems_with_multiple_emails, count(*) AS total_stems FROM c")
def stem_multi_email(spark, folder):
    return G.shared_entities(edge(spark, folder), "has_stem").toDF("stems_with_multiple_emails", "total_stems")


@query(f"WITH {EDGES}, p AS (SELECT s.dst AS stem, d.dst AS domain, count(DISTINCT s.email_index) AS n FROM e s JOIN e d ON s.email_index = d.email_index AND s.etype = 'has_stem' AND d.etype = 'has_domain' GROUP BY 1, 2), q AS (SELECT stem, sum(n) AS t, max(n) AS mx FROM p GROUP BY 1 HAVING t > 1) SELECT count(*) AS stems_with_multiple_emails, count(*) FILTER (mx > 1) AS stems_sharing_domain FROM q")
def stem_domain_sharing(spark, folder):
    return G.stems_sharing_hosts(edge(spark, folder)).toDF("stems_with_multiple_emails", "stems_sharing_domain")


@query(f"WITH {EDGES}, c AS (SELECT dst, count(DISTINCT email_index) AS n FROM e WHERE etype = 'has_domain' GROUP BY 1) SELECT count(*) FILTER (n > 1) AS domains_with_multiple_emails, count(*) AS total_domains FROM c")
def domain_multi_email(spark, folder):
    return G.shared_entities(edge(spark, folder), "has_domain").toDF("domains_with_multiple_emails", "total_domains")


def _copies(spark, folder):
    return raw(spark, folder).where("orig_csv_index is not null")


@query("SELECT email_index AS node, min(email_index) OVER (PARTITION BY orig_csv_index) AS component FROM trec07_misp WHERE orig_csv_index IS NOT NULL")
def connected_components(spark, folder):
    """Components over the links of each mail with the first of the same source row."""
    rows = _copies(spark, folder)
    first = rows.groupBy("orig_csv_index").agg(F.min("email_index").alias("a"))
    return G.components(rows.join(first, "orig_csv_index").select("a", F.col("email_index").alias("b")))


@query()
def graph_components(spark, folder):
    """Sizes of the components of the whole graph, with the node of largest degree of each of the five largest."""
    e = edge(spark, folder)
    tag = lambda side, c: F.concat(F.element_at(F.create_map(*[x for k, v in G.SCHEMA.items() for x in (F.lit(k), F.lit(v[side]))]), F.col("etype")), F.lit(":"), F.col(c))
    found = G.components(e.select(tag(0, "src").alias("a"), tag(1, "dst").alias("b")))
    degree = G.degrees(e).select(F.concat("ntype", F.lit(":"), "key").alias("node"), "degree")
    return found.join(degree, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("degree", "node")).alias("hub")).orderBy(F.desc("size"), "component").limit(5).select("component", "size", F.col("hub.node").alias("hub"), F.col("hub.degree").alias("degree"))


@query(f"WITH {EDGES}, a AS (SELECT email_index, CAST(len(body) AS DOUBLE) AS len_body, CAST(len(subject) AS DOUBLE) AS len_subject, CAST(len(urls) AS DOUBLE) AS n_urls FROM m), s AS (SELECT avg(len_body) mb, greatest(stddev_samp(len_body), 1e-6) sb, avg(len_subject) ms, greatest(stddev_samp(len_subject), 1e-6) ss, avg(n_urls) mu, greatest(stddev_samp(n_urls), 1e-6) su FROM a) SELECT email_index, round((len_body - mb) / sb, 6) AS len_body, round((len_subject - ms) / ss, 6) AS len_subject, round((n_urls - mu) / su, 6) AS n_urls FROM a, s")
def zscore(spark, folder):
    return _rounded(S.zscore(_sizes(spark, folder), ["len_body", "len_subject", "n_urls"]))


@query(f"WITH {EDGES}, a AS (SELECT email_index, CAST(len(body) AS DOUBLE) AS len_body, CAST(len(subject) AS DOUBLE) AS len_subject, CAST(len(urls) AS DOUBLE) AS n_urls FROM m), s AS (SELECT quantile_cont(len_body, [0.25, 0.5, 0.75]) b, quantile_cont(len_subject, [0.25, 0.5, 0.75]) s, quantile_cont(n_urls, [0.25, 0.5, 0.75]) u FROM a) SELECT email_index, round((len_body - b[2]) / CASE WHEN b[3] = b[1] THEN 1 ELSE b[3] - b[1] END, 6) AS len_body, round((len_subject - s.s[2]) / CASE WHEN s.s[3] = s.s[1] THEN 1 ELSE s.s[3] - s.s[1] END, 6) AS len_subject, round((n_urls - u[2]) / CASE WHEN u[3] = u[1] THEN 1 ELSE u[3] - u[1] END, 6) AS n_urls FROM a, s")
def robust_scale(spark, folder):
    return _rounded(S.robust(_sizes(spark, folder), ["len_body", "len_subject", "n_urls"]))


def _sizes(spark, folder):
    return mail(spark, folder).select("email_index", F.length("body").cast("double").alias("len_body"), F.length("subject").cast("double").alias("len_subject"), F.size("urls").cast("double").alias("n_urls"))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- terms

_BAG = r"bag AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY 1, 2)"
_IDF_SQL = f"{_BAG}, idf AS (SELECT term, count(DISTINCT doc_id) AS df, CAST(sum(tf) AS BIGINT) AS total, ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM bag GROUP BY 1 ORDER BY total DESC, term LIMIT 2000)"


@query(f"WITH {_BAG} SELECT doc_id, term, tf FROM bag")
def bow(spark, folder):
    return T.bag_of_words(table(spark, folder, "documents"), "doc_id", "text")


@query(f"WITH {_IDF_SQL} SELECT term, df, total, round(idf, 6) AS idf FROM idf")
def idf(spark, folder):
    docs = table(spark, folder, "documents")
    return T.inverse_frequency(T.bag_of_words(docs, "doc_id", "text"), docs, "doc_id", 2000).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_IDF_SQL}, x AS (SELECT doc_id, term, tf * idf.idf AS w FROM bag JOIN idf USING (term)), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM x GROUP BY 1) SELECT doc_id, term, round(w / nrm, 6) AS weight FROM x JOIN nm USING (doc_id)")
def tfidf(spark, folder):
    docs = table(spark, folder, "documents")
    bag = T.bag_of_words(docs, "doc_id", "text")
    return T.tfidf(bag, T.inverse_frequency(bag, docs, "doc_id", 2000), "doc_id").withColumn("weight", F.round("weight", 6))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _vector_sql(text: str, most: int, longest: int, least: int = 1, share: float = 1.0) -> str:
    more = " UNION ALL SELECT email_index, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM wd" if longest == 2 else ""
    return rf"""WITH wd AS (SELECT email_index, list_filter(regexp_extract_all(strip_accents(lower(coalesce({text}, ''))), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM trec07_misp),
g AS (SELECT email_index, unnest(w) AS term FROM wd{more}), bag AS (SELECT email_index, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(DISTINCT email_index) AS n FROM trec07_misp),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM bag GROUP BY 1), kp AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM st, n WHERE df >= {least} AND df <= {share} * n ORDER BY total DESC, term LIMIT {most}),
pl AS (SELECT term, idf, row_number() OVER (ORDER BY term) - 1 AS place FROM kp), x AS (SELECT email_index, place, term, tf * idf AS w FROM bag JOIN pl USING (term))
SELECT email_index, CAST(place AS INT) AS place, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY email_index)), 6) AS weight FROM x"""


@query(_vector_sql("subject", 128, 2))
def subject_vectors(spark, folder):
    return T.vectorise(raw(spark, folder), "email_index", "subject", 128, 2).withColumn("weight", F.round("weight", 6))


@query(_vector_sql("body", 256, 1))
def body_vectors(spark, folder):
    return T.vectorise(raw(spark, folder), "email_index", "body", 256).withColumn("weight", F.round("weight", 6))


@query(_vector_sql("subject", 500, 2, 2, 0.8))
def field_vectors(spark, folder):
    """A text field as the clustering of feature sets takes it: 500 one- and two-word terms of at least 2 and at most 80 % of the mails."""
    return T.vectorise(raw(spark, folder), "email_index", "subject", 500, 2, 2, 0.8).withColumn("weight", F.round("weight", 6))


@query()
def lsa_topics(spark, folder):
    """Ten latent topics of the bodies' weights over 1,000 terms of at least 2 and at most 80 % of the mails."""
    return T.latent_topics(raw(spark, folder), "email_index", "body")


_NUMBERS = ("subject_length", "subject_whitespace_count", "body_word_count", "num_lines")


@query(f"""WITH sf AS ({SQL['subject_features']}), bf AS ({SQL['body_features']}), fv AS ({_vector_sql('subject', 300, 2, 2, 0.8)}),
c0 AS (SELECT email_index, unnest(range(4)) AS i, unnest([CAST(subject_length AS DOUBLE), CAST(subject_whitespace_count AS DOUBLE), CAST(body_word_count AS DOUBLE), CAST(num_lines AS DOUBLE)]) AS w FROM sf JOIN bf USING (email_index)
  UNION ALL SELECT email_index, place + 4, weight FROM fv), cl AS (SELECT DISTINCT i FROM c0), ce AS (SELECT email_index, i, coalesce(w, 0.0) AS w FROM (SELECT email_index FROM trec07_misp) CROSS JOIN cl LEFT JOIN c0 USING (email_index, i)),
q AS (SELECT i, quantile_cont(w, 0.5) AS med, quantile_cont(w, 0.75) - quantile_cont(w, 0.25) AS iqr FROM ce GROUP BY 1)
SELECT email_index, round(sum(abs((w - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END)), 3) AS total, CAST(count(*) AS BIGINT) AS width FROM ce JOIN q USING (i) GROUP BY 1""")
def fs_matrix(spark, folder):
    """Each row of the matrix that a clustering of a feature set starts from, as its width and the sum of its entries' sizes."""
    rows = T.clustering_matrix(wide(spark, folder).select("email_index", "subject", *_NUMBERS), "email_index", list(_NUMBERS), ["subject"], 300)
    return rows.select("email_index", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"), F.size("v").cast("bigint").alias("width"))


def _with_topics(name: str):
    def run(spark, folder):
        return T.feature_set_with_topics(wide(spark, folder), T.latent_topics(raw(spark, folder), "email_index", "body"), name)

    run.__name__ = f"{name}_topics"
    return run


for _name in ("fs1", "fs2", "fs4", "fs5", "fs7"):
    query()(_with_topics(_name))


@query()
def grid_point(spark, folder):
    """One point of a clustering grid: sizes and subjects of the mails as a matrix of up to 104 columns, density clustering at 1.5."""
    rows = cut(T.clustering_matrix(wide(spark, folder).select("email_index", "subject", *_NUMBERS), "email_index", list(_NUMBERS), ["subject"], 100))
    return K.dbscan(rows, "email_index", "v", 1.5, 5)


# --- clusterings and their quality


def vectors(spark, folder):
    return table(spark, folder, "embeddings")


_AGREE = """cells AS (SELECT t, c, count(*) AS n FROM x GROUP BY 1, 2), j AS (SELECT *, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS a FROM cells),
h AS (SELECT max(a) AS a, -sum(n / a * ln(nt / a)) AS ht, -sum(n / a * ln(nc / a)) AS hc, -sum(n / a * ln(n / nc)) AS htc, -sum(n / a * ln(n / nt)) AS hct FROM j), s AS (SELECT a, CASE WHEN abs(ht) < 1e-12 THEN 1 ELSE 1 - htc / ht END AS h, CASE WHEN abs(hc) < 1e-12 THEN 1 ELSE 1 - hct / hc END AS c FROM h)
SELECT CAST(a AS BIGINT) AS n, round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure FROM s"""


@query(f"WITH x AS (SELECT cluster_a AS t, cluster_b AS c FROM pair_votes_all WHERE cluster_a IS NOT NULL AND cluster_b IS NOT NULL), {_AGREE}")
def homogeneity(spark, folder):
    return K.agreement(table(spark, folder, "pair_votes_all"), "cluster_a", "cluster_b")


@query("SELECT cluster_a AS cluster, count(*) AS n, CAST(count(DISTINCT email_a_id) AS BIGINT) AS mails, cluster_a = -1 AS noise FROM pair_votes_all WHERE cluster_a IS NOT NULL GROUP BY 1")
def cluster_sizes(spark, folder):
    return table(spark, folder, "pair_votes_all").where("cluster_a is not null").groupBy(F.col("cluster_a").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("email_a_id").alias("mails")).withColumn("noise", F.col("cluster") == -1)


@query(r"""WITH p AS (SELECT campaign_label, unnest(regexp_extract_all(email_ids, '"[^"]*"|''[^'']*''|\d+(\.0+)?')) AS x FROM campaigns), g AS (SELECT DISTINCT CAST(regexp_extract(replace(x, ',', ''), '\d+') AS BIGINT) AS id FROM p WHERE regexp_matches(x, '\d')), c AS (SELECT DISTINCT email_a_id AS id FROM pair_votes_all WHERE cluster_a IS NOT NULL AND cluster_a <> -1)
SELECT (SELECT count(*) FROM g) AS labelled, (SELECT count(*) FROM g JOIN c USING (id)) AS covered, round((SELECT count(*) FROM g JOIN c USING (id)) / (SELECT count(*) FROM g), 6) AS coverage""")
def coverage(spark, folder):
    truth = split_packed(table(spark, folder, "campaigns")).select(F.col("email_id").alias("id")).distinct()
    seen = table(spark, folder, "pair_votes_all").where("cluster_a is not null and cluster_a <> -1").select(F.col("email_a_id").alias("id"), F.lit(1).alias("hit")).distinct()
    return truth.join(seen, "id", "left").agg(F.count(F.lit(1)).alias("labelled"), F.count("hit").alias("covered")).withColumn("coverage", F.round(F.col("covered") / F.col("labelled"), 6))


@query("""WITH v AS (SELECT DISTINCT pair_id, email_a_id, email_b_id FROM pair_votes_all WHERE regexp_replace(lower(trim(vote)), '[^a-z]+', '_', 'g') = 'same_campaign')
SELECT pair_id, email_a_id, email_b_id, a.subject AS subject_a, b.subject AS subject_b FROM v JOIN trec07_misp a ON a.email_index = email_a_id JOIN trec07_misp b ON b.email_index = email_b_id""")
def voted_pairs(spark, folder):
    same = F.regexp_replace(F.lower(F.trim("vote")), "[^a-z]+", "_") == "same_campaign"
    votes = table(spark, folder, "pair_votes_all").where(same).select("pair_id", "email_a_id", "email_b_id").distinct()
    side = lambda x: raw(spark, folder).select(F.col("email_index").alias(f"email_{x}_id"), F.col("subject").alias(f"subject_{x}"))
    return votes.join(side("a"), "email_a_id").join(side("b"), "email_b_id").select("pair_id", "email_a_id", "email_b_id", "subject_a", "subject_b")


@query("SELECT coalesce(strategy, '') AS strategy, CAST(count(*) FILTER (regexp_replace(lower(trim(vote)), '[^a-z]+', '_', 'g') = 'same_campaign') AS BIGINT) AS same_campaign, CAST(count(*) FILTER (regexp_replace(lower(trim(vote)), '[^a-z]+', '_', 'g') = 'different_campaign') AS BIGINT) AS different_campaign FROM (SELECT DISTINCT * FROM pair_votes_all) GROUP BY 1")
def pivot_votes(spark, folder):
    votes = table(spark, folder, "pair_votes_all").distinct().select(F.coalesce("strategy", F.lit("")).alias("strategy"), F.regexp_replace(F.lower(F.trim("vote")), "[^a-z]+", "_").alias("v"))
    return votes.groupBy("strategy").pivot("v", ["same_campaign", "different_campaign"]).agg(F.count(F.lit(1))).select("strategy", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("same_campaign", "different_campaign")))


_CENTRES = "p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p), ce AS (SELECT label, list(mean ORDER BY i) AS m, max(n) AS n FROM (SELECT label, i, avg(x) AS mean, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {_CENTRES}, s AS (SELECT label, avg(list_distance(v, m)) AS s, any_value(m) AS m FROM p JOIN ce USING (label) GROUP BY 1), r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.m, b.m)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY 1) SELECT round(avg(r), 6) AS score FROM r")
def davies_bouldin(spark, folder):
    return K.davies_bouldin(vectors(spark, folder), "label", "embedding", 64)


@query(f"WITH {_CENTRES}, g AS (SELECT list(mean ORDER BY i) AS g FROM (SELECT i, avg(x) AS mean FROM u GROUP BY 1)), b AS (SELECT sum(n * pow(list_distance(m, g), 2)) AS b, sum(n) AS n, count(*) AS k FROM ce, g), w AS (SELECT sum(pow(list_distance(v, m), 2)) AS w FROM p JOIN ce USING (label)) SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS score FROM b, w")
def calinski_harabasz(spark, folder):
    return K.calinski_harabasz(vectors(spark, folder), "label", "embedding", 64)


@query("WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS l, b.label AS o, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3), q AS (SELECT vec_id, max(CASE WHEN l = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN l <> o THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM q")
def silhouette(spark, folder):
    return K.silhouette(vectors(spark, folder), "vec_id", "label", "embedding")


@query("WITH RECURSIVE p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), nr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON list_distance(a.v, b.v) <= 1.15 AND a.vec_id <> b.vec_id), co AS (SELECT p.vec_id AS a FROM p LEFT JOIN nr ON nr.a = p.vec_id GROUP BY 1 HAVING count(nr.b) + 1 >= 5), ce AS (SELECT nr.a, nr.b FROM nr JOIN co x ON x.a = nr.a JOIN co y ON y.a = nr.b), rc AS (SELECT a, a AS r FROM co UNION SELECT ce.b, rc.r FROM rc JOIN ce ON ce.a = rc.a), cc AS (SELECT a, min(r) AS c FROM rc GROUP BY 1), bd AS (SELECT nr.a, min(cc.c) AS c FROM nr JOIN cc ON cc.a = nr.b WHERE nr.a NOT IN (SELECT a FROM co) GROUP BY 1) SELECT vec_id, CAST(coalesce(cc.c, bd.c, -1) AS BIGINT) AS cluster FROM p LEFT JOIN cc ON cc.a = vec_id LEFT JOIN bd ON bd.a = vec_id")
def dbscan(spark, folder):
    return K.dbscan(vectors(spark, folder), "vec_id", "embedding", 1.15, 5)


@query()
def body_clusters(spark, folder):
    return K.kmeans(vectors(spark, folder), "vec_id", "embedding", 300)[0]


@query()
def mean_shift(spark, folder):
    v = vectors(spark, folder)
    return K.mean_shift(v, "vec_id", "embedding", K.bandwidth(v, "vec_id", "embedding", 0.2))


@query()
def pca_baseline(spark, folder):
    return K.principal_axes(vectors(spark, folder), "vec_id", "embedding", 8)


# --- links and rankings


@query("WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, d.vec_id AS item, list_cosine_similarity(q.v, d.v) AS s FROM p q JOIN p d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id) SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, item) AS rank, round(s, 6) AS score FROM s QUALIFY rank <= 10")
def cosine_topk(spark, folder):
    v = vectors(spark, folder)
    return L.top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10).select("query", "item", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, q.label = d.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, d.v), 9) DESC, d.vec_id) AS rank FROM p q JOIN p d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id), f AS (SELECT query, min(rank) FILTER (hit AND rank <= 100) AS first FROM s GROUP BY 1 HAVING bool_or(hit)), k AS (SELECT unnest([1, 10, 50, 100]) AS k) SELECT k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(coalesce(avg(CASE WHEN first <= k THEN 1.0 / first END), 0), 6) AS mrr FROM f, k GROUP BY 1")
def recall_mrr(spark, folder):
    v = vectors(spark, folder)
    queries_, items = v.where("vec_id % 20 = 0"), v
    ranked = cut(L.top_k(queries_, items, "vec_id", "embedding", 100))
    truth = queries_.select(F.col("vec_id").alias("query"), "label").join(items.select(F.col("vec_id").alias("item"), "label"), "label").where("query <> item").select("query", "item")
    return L.hit_rate_mrr(ranked, truth, [1, 10, 50, 100])


_SPREAD = "((((((CAST({2} AS BIGINT) * 48271 + {0} % 2147483647) * 16807) % 2147483647) * 48271 + {1} % 2147483647) * 16807) % 2147483647)"


def _relations(spark, folder):
    return table(spark, folder, "pair_votes_all").where("pair_id is not null and email_a_id is not null and email_b_id is not null").select(F.coalesce("strategy", F.lit("")).alias("etype"), F.col("email_a_id").alias("src"), F.col("email_b_id").alias("dst")).distinct()


_REL = "rel AS (SELECT DISTINCT coalesce(strategy, '') AS etype, email_a_id AS src, email_b_id AS dst FROM pair_votes_all WHERE email_a_id IS NOT NULL AND email_b_id IS NOT NULL)"


@query(f"WITH {_REL}, o AS (SELECT *, row_number() OVER (PARTITION BY etype ORDER BY {_SPREAD.format('src', 'dst', 42)}, src, dst) - 1 AS p, count(*) OVER (PARTITION BY etype) AS n FROM rel) SELECT etype, src, dst, CASE WHEN p < floor(n * 0.1) THEN 'val' WHEN p < floor(n * 0.1) + floor(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM o")
def edge_split(spark, folder):
    return L.split_edges(_relations(spark, folder), "etype", "src", "dst").select("etype", "src", "dst", "split")


def _scored(spark, folder, relation=None):
    v = vectors(spark, folder)
    pos = _relations(spark, folder)
    n = v.count()
    labelled = pos.withColumn("label", F.lit(1)).unionByName(L.negatives(pos, "src", "dst", 10**6).withColumn("label", F.lit(0)))
    folded = labelled.select("etype", F.pmod("src", F.lit(n)).alias("src"), F.pmod("dst", F.lit(n)).alias("dst"), "label")
    return L.edge_scores(folded, v, v, "src", "dst", "vec_id", "embedding", relation)


_SCORED = f"""{_REL}, p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), nn AS (SELECT count(*) AS n FROM embeddings),
lb AS (SELECT etype, src, dst, 1 AS label FROM rel UNION ALL SELECT etype, src, {_SPREAD.format('src', 'dst', 7)} % 1000000, 0 FROM rel), sc AS (SELECT etype, label, src % n AS src, dst % n AS dst, list_dot_product(a.v, b.v) AS score FROM lb, nn JOIN p a ON a.vec_id = src % n JOIN p b ON b.vec_id = dst % n)"""


@query(f"""WITH {_SCORED}, r AS (SELECT etype, label, score, (rank() OVER w + (count(*) OVER (PARTITION BY etype, s9) - 1) / 2.0) AS rk FROM (SELECT *, round(score, 9) AS s9 FROM sc) WINDOW w AS (PARTITION BY etype ORDER BY s9)),
au AS (SELECT etype, (sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auroc FROM r GROUP BY 1),
g AS (SELECT etype, round(score, 9) AS s9, sum(label) AS ps, count(*) AS n FROM sc GROUP BY 1, 2), cu AS (SELECT etype, ps, sum(ps) OVER w AS tp, sum(n) OVER w AS seen, sum(ps) OVER (PARTITION BY etype) AS pos FROM g WINDOW w AS (PARTITION BY etype ORDER BY s9 DESC)), ap AS (SELECT etype, sum(ps / pos * tp / seen) AS ap FROM cu GROUP BY 1)
SELECT etype, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM au JOIN ap USING (etype)""")
def auroc_ap(spark, folder):
    return L.auroc_ap(_scored(spark, folder).withColumn("score", F.round("score", 9)), "etype")


@query(f"WITH {_SCORED} SELECT label, CAST(least(floor((score + 1) / (2.0 / 50)), 49) AS INT) AS bin, count(*) AS n FROM sc WHERE score BETWEEN -1 AND 1 GROUP BY 1, 2")
def pos_neg_histogram(spark, folder):
    scored = _scored(spark, folder)
    return S.histogram(scored.where("label = 1"), "score", -1.0, 1.0, 50).withColumn("label", F.lit(1)).unionByName(S.histogram(scored.where("label = 0"), "score", -1.0, 1.0, 50).withColumn("label", F.lit(0))).select("label", "bin", "n")


@query(f"WITH {_SCORED}, w AS (SELECT etype, label, src, dst, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z, i: z[1] * z[2] * (1 + (i - 1) % 4) / 2.5)), 6) AS score FROM (SELECT etype, label, src % n AS src, dst % n AS dst FROM lb, nn) JOIN p a ON a.vec_id = src JOIN p b ON b.vec_id = dst) SELECT etype, label, src, dst, score, count(*) AS n FROM w GROUP BY ALL")
def distmult_scores(spark, folder):
    scored = _scored(spark, folder, [(1 + i % 4) / 2.5 for i in range(64)])
    return scored.withColumn("score", F.round("score", 6)).groupBy("etype", "label", "src", "dst", "score").agg(F.count(F.lit(1)).alias("n"))


_WEIGHTS = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(4)]


@query(f"""WITH {_REL}, p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), nn AS (SELECT count(*) AS n FROM embeddings), ed AS (SELECT src % n AS src, dst % n AS dst FROM rel, nn),
u AS (SELECT dst, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ed JOIN p ON p.vec_id = ed.src), mn AS (SELECT dst, list(x ORDER BY i) AS m FROM (SELECT dst, i, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY 1), wt AS (SELECT {_WEIGHTS} AS w)
SELECT vec_id, {', '.join(f"round(greatest(list_dot_product(v, CAST(w[{k + 1}] AS DOUBLE[])) + coalesce(list_dot_product(m, CAST(w[{4 - k}] AS DOUBLE[])), 0), 0), 6) AS h{k}" for k in range(4))} FROM p LEFT JOIN mn ON mn.dst = p.vec_id, wt""")
def sage_mean(spark, folder):
    v = vectors(spark, folder)
    n = v.count()
    e = _relations(spark, folder).select(F.pmod("src", F.lit(n)).alias("src"), F.pmod("dst", F.lit(n)).alias("dst"))
    out = L.sage_layer(e, v, v, "vec_id", "embedding", _WEIGHTS, _WEIGHTS[::-1])
    return out.select("vec_id", *(F.round(F.col("embedding")[k], 6).alias(f"h{k}") for k in range(4)))


@query("SELECT round(avg(sqrt(list_dot_product(v, v))), 6) AS mean, round(max(sqrt(list_dot_product(v, v))), 6) AS most FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def vector_norms(spark, folder):
    return R.norms(vectors(spark, folder), "embedding")


@query(f"WITH {_SCORED} SELECT count(*) AS n, round(avg((1 - label) * score + greatest(-score, 0) + ln(1 + exp(-abs(score)))), 6) AS loss, round(avg(CASE WHEN (score >= 0) = (label = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM sc")
def link_loss(spark, folder):
    return R.accuracy(_scored(spark, folder), "score", "label")


@query(f"WITH {_SCORED}, g AS (SELECT etype, src, score, label, max(score / 0.1) OVER w AS m FROM sc WINDOW w AS (PARTITION BY etype, src)), l AS (SELECT etype, score, label, ln(sum(exp(score / 0.1 - m)) OVER (PARTITION BY etype, src)) + m AS lse FROM g) SELECT etype, round(avg(lse - score / 0.1), 5) AS loss FROM l WHERE label = 1 GROUP BY 1")
def link_contrast(spark, folder):
    scored = _scored(spark, folder).withColumn("g", F.struct("etype", "src"))
    w = R.contrast(scored.withColumn("one", F.lit(1)), "g", "score", "label")
    counts = scored.where("label = 1").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return w.join(counts, "g").groupBy(F.col("g.etype").alias("etype")).agg(F.round(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), 5).alias("loss"))


@query()
def relation_training(spark, folder):
    """The relation vector that a DistMult head learns for all relations together."""
    v = vectors(spark, folder)
    weights = R.train_relation(_scored(spark, folder).drop("score"), v, "src", "dst", "label", "vec_id", "embedding")
    return spark.createDataFrame([(i, round(w, 6)) for i, w in enumerate(weights)], "dim int, weight double")


@query()
def dbscan_grid(spark, folder):
    return R.grid(vectors(spark, folder), "vec_id", "embedding", "label", [1.05, 1.15, 1.25])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
