"""Hand-computed values and invariants of the campaign operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwork.functions import columns as C
from shoalwork.operators import clustering as K
from shoalwork.operators import features as T
from shoalwork.operators import graph as G
from shoalwork.operators import links as L
from shoalwork.operators import scaling as S
from shoalwork.sources import files


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(column.alias("x")).first()["x"]


def test_links(spark):
    v = F.col("v0")
    assert one(spark, C.links(v), "Click here to visit http://example.com/path?query=test for great deals!") == ["http://example.com/path?query=test"]
    assert one(spark, C.links(v), "https://another-site.org/page.") == ["https://another-site.org/page"]
    assert one(spark, C.links(v), None) == []
    assert one(spark, C.distinct_links(v), ["http://example.com", "http://example.com", "http://EXAMPLE.COM", "http://example.com/"]) == ["http://example.com"]
    for url, host, path in (("http://example.com/page1", "example.com", "/page1"), ("www.A.com?q=1#x", "www.a.com", "?q=1#x"), ("https://u@H.com:80", "u@h.com:80", "/"), ("http://a.b/?", "a.b", "/")):
        assert (one(spark, C.link_host(v), url), one(spark, C.link_path(v), url)) == (host, path)


def test_addresses_and_texts(spark):
    v = F.col("v0")
    assert one(spark, C.address(v), '"Bob" <Bob@X.com>') == "bob@x.com"
    assert one(spark, C.addresses(v), "A@x.com, b@y.org; a@X.com") == ["a@x.com", "b@y.org"]
    assert one(spark, C.email_domain(v), "a@b@C.com") == "c.com" and one(spark, C.email_domain(v), "nobody") == ""
    assert one(spark, C.is_freemail(v), " Gmail.com ") is True
    assert one(spark, C.lexical(v), "aab") == pytest.approx([3, 0, 0, 3, 0, 0, 0, 0.9182958340544896])
    assert one(spark, C.lexical(v), "") == [0.0] * 8 and one(spark, C.lexical(v), None) == [0.0] * 8
    assert one(spark, C.unix_time(v), "Tue, 10 Apr 2007 12:00:00 -0400") == 1176220800 and one(spark, C.unix_time(v), "bad") == 0
    assert one(spark, C.week_key(F.to_date(v)), "2007-12-31") == "2008-W01"
    for body, kind in (("Dear John,", "dear, name"), ("Hello", "hello"), ("hi bob@x.com", "hi, email"), ("hey user_1", "hey, username"), ("Yo", ""), (None, "")):
        assert one(spark, C.greeting(v), body) == kind
    name, address = C.person(v)
    assert (one(spark, name, '"Al" <a@b.c>'), one(spark, address, '"Al" <a@b.c>')) == ("Al", "a@b.c")
    assert (one(spark, name, "al@b.com"), one(spark, address, "al@b.com")) == ("al", "al@b.com")
    f = C.link_features(v)
    urls = ["http://1.2.3.4/x", "http://bit.ly/a-b"]
    assert [one(spark, f[k], urls) for k in ("num_different_domains", "num_urls_with_ip", "num_short_urls", "avg_subdomain_count", "avg_hyphen_count")] == [2, 1, 1, 1.0, 0.0]  # 2 and 0 beyond the first dot


def test_best_months(spark):
    def best(counts, n):
        rows = [(int(np.datetime64(f"{m}-15", "s").astype(int)),) for m, c in counts.items() for _ in range(c)]
        r = T.best_months(spark.createDataFrame(rows, "ts long"), n).first()
        return str(r.first_month)[:7], str(r.last_month)[:7]

    assert best({"2007-01": 1, "2007-02": 5, "2007-03": 5, "2007-04": 1}, 2) == ("2007-02", "2007-03")
    assert best({"2007-01": 5, "2007-02": 5, "2007-03": 1, "2007-04": 5, "2007-05": 5}, 2) == ("2007-01", "2007-02")
    assert best({"2007-01": 4, "2007-03": 4, "2007-04": 1}, 2) == ("2007-03", "2007-04")
    assert best({"2007-01": 4, "2007-02": 4}, 6) == ("2007-01", "2007-02")
    assert T.best_months(spark.createDataFrame([], "ts long")).collect() == []


MAILS = [
    (0, 1, "A <ab@x.org>", "r@y.org, s@y.org", "s", "2007-12-31 10:00:00", "b", ["http://d.com/1", "http://d.com/2"]),
    (1, 2, "xyz@x.org", "r@y.org", None, "junk", None, None),
    (2, 3, "xyz@x.org", None, "t", None, "c", ["http://e.com/1"]),
]


def mail_rows(spark):
    return spark.createDataFrame(MAILS, "email_index long, orig_csv_index long, sender string, receiver string, subject string, date string, body string, urls array<string>")


def test_graph(spark):
    e = G.edges(G.mails(mail_rows(spark))).cache()
    assert e.where("etype = 'has_domain'").count() == 3  # one for each link
    assert G.endpoints(e).count() == 2 * e.count() == G.degrees(e).agg(F.sum("degree")).first()[0]
    idx = {(r.ntype, r.key): r.idx for r in G.node_index(e).collect()}
    assert idx[("sender", "ab@x.org")] == 0 and idx[("sender", "xyz@x.org")] == 1 and idx[("domain", "e.com")] == 1
    kept, folded = G.collapse_single(e)
    names = {(r.ntype, r.key) for r in folded.collect()}
    assert ("domain", "d.com") not in names and ("domain", "e.com") in names  # two links to a host are two edges
    again, none = G.collapse_single(kept)
    assert none.count() == 0 and again.count() == kept.count()
    assert G.top_receiver(e).first()["key"] == "r@y.org"
    assert G.receiver_neighbourhood(e).count() == 5  # mail 0: 2 links x 1 host x 2 paths; mail 1: one row
    assert G.without_types(e, ("week", "nothing")).count() == e.count() - 1
    assert G.undirected(e).count() == 2 * e.count()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 103)]
    for parts in (1, 16):  # whole in one forest, and in pieces
        got = {r.node: r.component for r in G.components(spark.createDataFrame(pairs, "a long, b long").repartition(parts)).collect()}
        assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[103] == 103
    texts = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r.node: r.component for r in G.components(texts).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert G.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_events(spark):
    raw = mail_rows(spark)
    direct = G.mails(raw).select("email_index", "sender", "receivers", "subject", "body", "urls")
    back = G.parse_events(files.to_events(raw)).select("email_index", "sender", "receivers", "subject", "body", "urls")
    assert sorted(map(str, direct.collect())) == sorted(map(str, back.collect()))
    attr = '"Attribute":[{"type":"email-src","value":"a@b.cc"},{"type":"email-subject","value":"x"},{"type":"email-subject","value":"y"}]'
    docs = [f'[{{"Event":{{"email_index":1,{attr}}}}}]', f'{{"response":{{"Event":{{"email_index":2,{attr}}}}}}}', f'{{"response":{{"Event":[{{"email_index":3,{attr}}}]}}}}', '{"Event":{"email_index":4', None, ""]
    rows = G.parse_events(spark.createDataFrame([(d,) for d in docs], "payload string")).collect()
    assert sorted((r.email_index, r.sender, r.subject) for r in rows) == [(1, "a@b.cc", "y"), (2, "a@b.cc", "y"), (3, "a@b.cc", "y")]


def test_agreement(spark):
    def score(t, p):
        return tuple(K.agreement(spark.createDataFrame(list(zip(t, p)), "t int, c int"), "t", "c").first())

    assert score([0, 0, 1, 1], [0, 0, 1, 1]) == (4, 1.0, 1.0, 1.0) == score([0, 0, 1, 1], [7, 7, 3, 3])
    assert score([0, 0, 1, 1], [0, 0, 0, 0]) == (4, 0.0, 1.0, 0.0)
    assert score([1], [1]) == (1, 0.0, 0.0, 0.0)


def cloud(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.15, (n // 3, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 0))])
    x[:5] = x[0]
    return x, spark.createDataFrame([(i, [float(v) for v in r], i * 3 // n) for i, r in enumerate(x)], "id long, v array<double>, label int")


def test_distance_join_and_density(spark):
    x, points = cloud(spark)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.3)) if a < b}
    got = [tuple(r) for r in K.within(points, "id", "v", 0.3).collect()]
    assert set(got) == want and len(got) == len(want)
    labels = {r.id: r.cluster for r in K.dbscan(points, "id", "v", 0.3, 5).collect()}
    assert len({c for c in labels.values() if c >= 0}) == 3
    core = (d <= 0.3).sum(1) >= 5
    assert all(labels[i] >= 0 for i in np.flatnonzero(core))
    assert all(labels[a] == labels[b] for a, b in want if core[a] and core[b])


def test_density_clusters_over_blocks(spark, monkeypatch):
    """Blocks of any size give the clusters of all pairs, and no task hands on the pairs within reach."""
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.normal(c, 0.4, (120, 3)) for c in ((0, 0, 0), (1.6, 0, 0), (9, 9, 9))] + [rng.uniform(-4, 12, (160, 3))])
    near = ((at[:, None] - at[None]) ** 2).sum(2) <= 0.6**2 + 1e-9
    core, label = near.sum(1) >= 5, np.arange(len(at))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(at)).min(1), label)
        if (new == label).all():
            break
        label = new
    reach = np.where(near & core[None], label[None], len(at)).min(1)
    expected = np.where(core, label, np.where(reach < len(at), reach, -1)).tolist()
    assert (reach[~core] < len(at)).any() and -1 in expected
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "id long, v array<double>")
    cuts, real = [], K.cut
    monkeypatch.setattr(K, "cut", lambda x: cuts.append(y := real(x)) or y)
    monkeypatch.setattr(K, "BLOCK", 16)
    for size in (50, 1 << 14):
        cuts.clear()
        assert [r.cluster for r in K.dbscan(df, "id", "v", 0.6, 5, size=size).orderBy("id").collect()] == expected
    assert max(c.count() for c in cuts if "data" not in c.columns) <= 3 * len(at) < near.sum() // 2
    assert K.dbscan(df.limit(0), "id", "v", 0.6).collect() == []


def test_cluster_scores(spark):
    x, points = cloud(spark)
    y = np.arange(300) * 3 // 300
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    a = np.array([d[i, (y == y[i])].sum() / 99 for i in range(300)])
    b = np.array([min(d[i, y == c].mean() for c in range(3) if c != y[i]) for i in range(300)])
    assert K.silhouette(points, "id", "label", "v").first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-5)
    assert len({r.cluster for r in K.mean_shift(points, "id", "v", 1.0).collect()}) == 3
    assert K.kmeans(points, "id", "v", 3)[1].count() == 3


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 8.0, 5.0)], "id int, a double, b double")
    assert [r.b for r in S.zscore(df, ["a", "b"]).collect()] == [0.0] * 3
    assert [r.b for r in S.robust(df, ["b"]).collect()] == [0.0] * 3
    assert [r.a for r in S.zscore(df.limit(1), ["a"]).collect()] == [0.0]


def test_links_split_and_scores(spark):
    e = spark.range(105).select(F.lit("r").alias("t"), F.col("id").alias("s"), (F.col("id") * 7 % 13).alias("d"))
    parts = {r.split: r["count"] for r in L.split_edges(e, "t", "s", "d").groupBy("split").count().collect()}
    assert parts == {"val": 10, "test": 10, "train": 85}
    scored = spark.createDataFrame([("g", 0.9, 1), ("g", 0.9, 0), ("g", 0.5, 1), ("g", 0.1, 0)], "t string, score double, label int")
    r = L.auroc_ap(scored, "t").first()
    assert r.auroc == pytest.approx(0.625) and r.ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3, abs=1e-6)
    ranked = spark.createDataFrame([(1, 10, 1), (2, 20, 4), (3, 30, 2)], "query long, item long, rank int")
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, 31)], "query long, item long")
    assert tuple(L.hit_rate_mrr(ranked, truth, [4]).first()) == (4, 0.666667, 0.625)
    assert L.supervised_types(G.SCHEMA, "sender") == ["sender_from_domain"]
    with pytest.raises(ValueError):
        L.supervised_types({}, "email")
    assert L.sample_neighbours(e, "s", "d", 2).groupBy("d").count().agg(F.max("count")).first()[0] == 2


def test_streams(spark, tmp_path):
    from shoalwork.streaming.windows import windowed

    spark.sql("select timestamp'2007-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2007-01-01 02:00:00', 'a' union all select timestamp'2007-01-05', 'b'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", ["k"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 3


def test_files(spark, tmp_path):
    raw = mail_rows(spark)
    e = G.edges(G.mails(raw))
    files.write_graph(G.node_index(e), e, str(tmp_path / "g"))
    nodes, back = files.read_graph(spark, str(tmp_path / "g"))
    assert back.count() == e.count() and nodes.count() == G.node_index(e).count()
    doc = files.cluster_document(spark.createDataFrame([(0, -1), (1, 2)], "email_index long, cluster int"), raw.select("email_index", "subject"), "email_index", "x")
    assert {r.cluster: r.size for r in doc.collect()} == {-1: 1, 2: 1}
    files.write_csv(spark.createDataFrame([("a", "1.23456"), ("b", "x")], "term string, idf string"), str(tmp_path / "idf"))
    assert sorted(tuple(r) for r in files.read_idf_csv(spark, str(tmp_path / "idf")).collect()) == [("a", 1.235), ("b", 0.0)]


def test_mail_times_are_those_of_the_general_parser(spark):
    from email.utils import parsedate_to_datetime

    dates = [
        "Tue, 10 Apr 2007 12:00:00 -0400", "10 Apr 07 12:00 EST", "Sun Apr  1 16:38:02 2007", "10-Apr-07 12:00:01 GMT", "Tue, 10 Apr 2007 12.30",
        "April 10 2007 12:00:00", "Tue, 31 Apr 2007 12:00:00 +0000", "2007-04-10 12:00:00", "10 Apr 2007 12:00:00 +9900", "junk", "", None, "10 Apr 1969 1:2:3",
    ]

    def want(d):
        try:
            return parsedate_to_datetime(d).strftime("%Y-%m-%d %H:%M:%S")
        except Exception:
            return None

    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(dates)), "i int, d string").select("i", C.mail_time("d").alias("t")).collect()}
    assert got == {i: want(d) for i, d in enumerate(dates)} and sum(v is not None for v in got.values()) >= 6


def test_greetings_and_spaces_of_any_script(spark):
    bodies = ["Dear Élodie,", "Dear John,", " Hello", "hi bob@x.com", "hey user_1", "Yo", None, "Dear «!»"]
    got = [r.g for r in spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", C.greeting(F.col("b")).alias("g")).orderBy("i").collect()]
    assert got[:7] == ["dear, username", "dear, name", "hello", "hi, email", "hey, username", "", ""]
    row = spark.createDataFrame([("a b  c ",)], "s string").select(F.regexp_count("s", F.lit(C.SPACE)).alias("n"), T.terms(F.col("s")).alias("t")).first()
    assert row.n == 4 and row.t == ["a", "b", "c"]


def test_collapse_in_two_steps(spark):
    e = spark.createDataFrame(
        [("has_sender", "0", "ab", 0), ("has_sender", "1", "xyz", 1), ("has_sender", "2", "xyz", 2), ("has_sender", "3", "q@d.org", 3), ("sender_from_domain", "q@d.org", "d.org", 3),
         ("has_domain", "0", "d", 0), ("has_domain", "0", "d", 0), ("in_week", "0", "2007-W01", 0)], "etype string, src string, dst string, email_index long")
    kept, collapsed = G.collapse_single(e)
    assert {tuple(r) for r in collapsed.collect()} == {("sender", "ab", "email", "0"), ("email_domain", "d.org", "sender", "q@d.org"), ("sender", "q@d.org", "email", "3")}
    assert G.collapse_single(kept)[1].count() == 0  # once is enough
    sums = {r.email: (r.sender_len, r.sender_domain_len, r.receiver_len) for r in G.collapsed_sums(collapsed).collect()}
    assert sums == {"0": (2.0, 0.0, 0.0), "3": (7.0, 5.0, 0.0)}
    index = G.node_index(kept)
    assert {(r.ntype, r.key): r.idx for r in index.collect()} == {("sender", "xyz"): 0, ("domain", "d"): 0, ("week", "2007-W01"): 0}
    assert sorted((r.etype, r.src, r.dst) for r in G.indexed_edges(kept, index).collect() if r.etype == "has_sender") == [("has_sender", 1, 0), ("has_sender", 2, 0)]
    assert G.collapse_single(e.limit(0))[1].count() == 0


def test_merged_graph(spark):
    nodes = spark.createDataFrame([("email", "0", 1), ("email", "0", 1), ("sender", "a", None)], "ntype string, key string, x int")
    e = spark.createDataFrame([("has_sender", "0", "a"), ("has_sender", "0", "a"), ("has_sender", "9", "a"), ("has_url", "0", "u")], "etype string, src string, dst string")
    once, held, counts = G.merged(nodes, e)
    assert once.count() == 2 and [tuple(r) for r in held.collect()] == [("has_sender", "0", "a")]
    assert {(r.kind, r.name): r.rows for r in counts.collect()} == {("node", "email"): 2, ("node", "sender"): 1, ("edge", "has_sender"): 3, ("edge", "has_url"): 1}


def test_terms_of_vectors(spark):
    texts = ["The café, a CAFE!", "red engine and red ferry", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("term", F.lit("clash"))
    got = {r.k: r.g for r in df.select("k", T.grams(F.col("t"), 2).alias("g")).collect()}
    assert got == {0: ["cafe", "cafe", "cafe cafe"], 1: ["red", "engine", "red", "ferry", "red engine", "engine red", "red ferry"], 2: [], 3: []}
    rows = T.vectorise(df, "k", "t", 3, 2).collect()
    assert {r.term for r in rows} == {"cafe", "red", "cafe cafe"} and [r.place for r in sorted(rows, key=lambda r: r.term)] == [0, 1, 2]
    assert abs(sum(r.weight**2 for r in rows if r.k == 0) - 1) < 1e-9 and not [r for r in rows if r.k > 1]
    assert T.vectorise(df.limit(0), "k", "t", 3).count() == 0


def test_axes_equal_the_singular_vectors(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "k long, v array<double>").repartition(3)
    for centred in (True, False):
        x = m - m.mean(0) if centred else m
        u, d, _ = np.linalg.svd(x, full_matrices=False)
        got = np.array([r.axes for r in K.principal_axes(df, "k", "v", 2, centred).orderBy("k").collect()])
        assert np.allclose(np.abs(got), np.abs(u[:, :2] * d[:2]))
    topics = T.latent_topics(spark.createDataFrame([(1, "red engine"), (2, "red ferry"), (3, None)], "k long, t string"), "k", "t", topics=2, most=4, largest_share=1.0)
    assert {r.k: r.lsa_topic_0 for r in topics.collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


def test_clustering_matrix(spark):
    rows = [(1, "3", "red engine"), (2, None, "red engine"), (3, "x", None), (4, "5", "blue")]
    df = spark.createDataFrame(rows, "k long, n string, t string").withColumn("i", F.lit("clash"))
    got = {r.k: list(r.v) for r in T.clustering_matrix(df, "k", ["n"], ["t"], 5).collect()}
    assert len(got[1]) == 4  # the number, and engine, red, red engine
    n = np.array([3.0, 0.0, 0.0, 5.0])
    q = np.percentile(n, [25, 50, 75])
    assert np.allclose([got[k][0] for k in (1, 2, 3, 4)], (n - q[1]) / (q[2] - q[0]))
    w = 1 / np.sqrt(3)
    column = np.array([w, w, 0, 0])
    q = np.percentile(column, [25, 50, 75])
    assert np.allclose([got[k][1] for k in (1, 2, 3, 4)], (column - q[1]) / (q[2] - q[0]))
    with pytest.raises(ValueError):
        T.clustering_matrix(df.limit(0), "k", ["n"], ["t"])
