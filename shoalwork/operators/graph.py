"""A typed graph of mails, participants, links and weeks as node and edge tables, and questions over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwork.functions import columns as C
from shoalwork.plans.cut import cut

#: Edge type -> (source node type, target node type). Hosts and paths have one edge for each link, the others one for each pair.
SCHEMA = {
    "has_sender": ("email", "sender"),
    "has_receiver": ("email", "receiver"),
    "in_week": ("email", "week"),
    "has_url": ("email", "url"),
    "has_domain": ("email", "domain"),
    "has_stem": ("email", "stem"),
    "sender_from_domain": ("sender", "email_domain"),
    "receiver_from_domain": ("receiver", "email_domain"),
}
LAST = 20_000  # pairs that one task joins in the end
COLLAPSIBLE = ("email_domain", "sender", "receiver", "url", "domain", "stem")


def mails(raw: DataFrame) -> DataFrame:
    """email_index, sender, receivers, subject, body, urls, ts, week of the mail table; nulls become empty."""
    urls = F.array_distinct(F.filter(F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.trim(C.text(u))), lambda u: u != ""))
    when = C.local_time(F.col("date"))
    return raw.select(
        "email_index", C.sender_key(F.col("sender")).alias("sender"), C.addresses(F.col("receiver")).alias("receivers"),
        C.text(F.col("subject")).alias("subject"), C.text(F.col("body")).alias("body"), urls.alias("urls"),
        C.unix_time(F.col("date")).alias("ts"), F.when(when.isNotNull(), C.week_key(when)).otherwise("").alias("week"),
    )


def parse_events(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows like mails() from raw event documents: plain, inside a list, or under response, one or several.

    The last value of subject, body and date counts; receivers are gathered over to, cc and bcc. Documents that are not
    valid JSON give no row.
    """
    attribute = "array<struct<type:string,value:string,category:string>>"
    event = f"struct<info:string,email_index:bigint,orig_csv_index:bigint,Attribute:{attribute}>"
    text = F.trim(F.col(payload))
    plain = F.from_json(text, f"struct<Event:{event}>").getField("Event")
    listed = F.transform(F.from_json(text, f"array<struct<Event:{event}>>"), lambda x: x.getField("Event"))
    inside = F.from_json(text, f"struct<response:struct<Event:{event}>>").getField("response").getField("Event")
    several = F.from_json(text, f"struct<response:struct<Event:array<{event}>>>").getField("response").getField("Event")
    each = F.from_json(text, f"struct<response:array<struct<Event:{event}>>>").getField("response")
    empty = F.array().cast(f"array<{event}>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(empty)
    found = F.array_distinct(F.filter(F.concat(one(plain), F.coalesce(listed, empty), one(inside), F.coalesce(several, empty), F.coalesce(F.transform(each, lambda x: x.getField("Event")), empty)), lambda e: e.isNotNull() & e.getField("Attribute").isNotNull()))
    events = payloads.where(F.try_parse_json(text).isNotNull()).select(F.explode(found).alias("e")).select("e.*")
    values = lambda *types: F.transform(F.filter("Attribute", lambda a: a.type.isin(*types)), lambda a: C.text(a.value))
    last = lambda t: F.coalesce(F.try_element_at(values(t), F.lit(-1)), F.lit(""))
    receivers = F.array_distinct(F.flatten(F.transform(values("email-dst", "email-cc", "email-bcc"), C.addresses)))
    return events.select(
        "email_index", C.sender_key(last("email-src")).alias("sender"), receivers.alias("receivers"), last("email-subject").alias("subject"),
        last("email-body").alias("body"), F.array_distinct(F.filter(F.transform(values("url"), F.trim), lambda u: u != "")).alias("urls"), C.unix_time(last("email-date")).alias("ts"),
    )


def edges(mail: DataFrame) -> DataFrame:
    """(etype, src, dst, email): all edges by key; src of a mail's edge is its index as text."""
    e = F.col("email_index").cast("string")
    row = lambda kind, src, dst: F.struct(F.lit(kind).alias("etype"), src.alias("src"), dst.alias("dst"))
    per = lambda kind, items: F.transform(items, lambda x: row(kind, e, x))
    single = lambda kind, c: F.when(c != "", F.array(row(kind, e, c))).otherwise(F.array().cast("array<struct<etype:string,src:string,dst:string>>"))
    hosts = F.filter(F.transform("urls", C.link_host), lambda d: d != "")
    own = C.email_domain(F.col("sender"))
    sender_domain = F.when((own != "") & ~C.is_freemail(own), own).otherwise("")
    from_sender = F.when(sender_domain != "", F.array(row("sender_from_domain", F.col("sender"), sender_domain))).otherwise(F.array().cast("array<struct<etype:string,src:string,dst:string>>"))
    reached = F.filter("receivers", lambda r: (C.email_domain(r) != "") & ~C.is_freemail(C.email_domain(r)))
    from_receivers = F.transform(reached, lambda r: row("receiver_from_domain", r, C.email_domain(r)))
    every = F.concat(single("has_sender", F.col("sender")), per("has_receiver", F.col("receivers")), single("in_week", F.col("week")), per("has_url", F.col("urls")), per("has_domain", hosts), per("has_stem", F.transform("urls", C.link_path)), from_sender, from_receivers)
    flat = mail.select("email_index", F.explode(every).alias("x")).select("x.etype", "x.src", "x.dst", "email_index")
    participants = flat.where(F.col("etype").endswith("from_domain")).groupBy("etype", "src", "dst").agg(F.min("email_index").alias("email_index"))
    return flat.where(~F.col("etype").endswith("from_domain")).unionByName(participants)


def endpoints(edge: DataFrame) -> DataFrame:
    """(ntype, key) of both ends of every edge."""
    pick = lambda side: F.element_at(F.create_map(*[x for k, v in SCHEMA.items() for x in (F.lit(k), F.lit(v[side]))]), F.col("etype"))
    return edge.select("etype", F.explode(F.array(F.struct(pick(0).alias("ntype"), F.col("src").alias("key"), F.lit("src").alias("side")), F.struct(pick(1).alias("ntype"), F.col("dst").alias("key"), F.lit("dst").alias("side")))).alias("x")).select("etype", "x.ntype", "x.key", "x.side")


def node_index(edge: DataFrame, buckets: int = 64) -> DataFrame:
    """(ntype, key, idx): keys numbered from 0 within their type by the first mail that has them, then by key.

    Keys are reduced before any window. The order is made of ranges of first mails, so that the largest type is spread
    over tasks: a number is the count before its range plus its rank in it.
    """
    keys = edge.where(~F.col("etype").endswith("from_domain")).select("etype", F.col("dst").alias("key"), "email_index").unionByName(edge.where(F.col("etype").endswith("from_domain")).select("etype", F.col("dst").alias("key"), "email_index"))
    target = F.element_at(F.create_map(*[x for k, v in SCHEMA.items() for x in (F.lit(k), F.lit(v[1]))]), F.col("etype"))
    first = keys.groupBy(target.alias("ntype"), "key").agg(F.min("email_index").alias("first"))
    sliced = first.withColumn("slice", F.floor(F.col("first") / 4096))
    before = sliced.groupBy("ntype", "slice").count().select("ntype", "slice", (F.sum("count").over(Window.partitionBy("ntype").orderBy("slice")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("ntype", "slice").orderBy("first", "key")) - 1
    return sliced.withColumn("rank", rank).join(before, ["ntype", "slice"]).select("ntype", "key", (F.col("rank") + F.col("before")).cast("bigint").alias("idx"))


def degrees(edge: DataFrame) -> DataFrame:
    """(ntype, key, degree) over all edge types, parallel edges counted."""
    return endpoints(edge).groupBy("ntype", "key").agg(F.count(F.lit(1)).alias("degree"))


def document_frequency(edge: DataFrame) -> DataFrame:
    """(ntype, key, docfreq): mails of each entity that mails point to."""
    target = F.element_at(F.create_map(*[x for k, v in SCHEMA.items() for x in (F.lit(k), F.lit(v[1]))]), F.col("etype"))
    return edge.where(~F.col("etype").endswith("from_domain")).groupBy(target.alias("ntype"), F.col("dst").alias("key")).agg(F.countDistinct("email_index").alias("docfreq"))


def connectivity(edge: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Per edge type and side: nodes of degree 0, 1 and at least `least` as shares in percent. nodes: (ntype, key)."""
    per = endpoints(edge).groupBy("etype", "ntype", "side", "key").agg(F.count(F.lit(1)).alias("d"))
    totals = nodes.groupBy("ntype").agg(F.count(F.lit(1)).alias("nodes"))
    seen = per.groupBy("etype", "ntype", "side").agg(F.count(F.lit(1)).alias("some"), F.count_if(F.col("d") == 1).alias("one"), F.count_if(F.col("d") >= least).alias("many"))
    pct = lambda c: F.when(F.col("nodes") > 0, F.round(100.0 * c / F.col("nodes"), 4)).otherwise(0.0)
    return seen.join(F.broadcast(totals), "ntype").select("etype", "side", "ntype", "nodes", pct(F.col("nodes") - F.col("some")).alias("deg0_pct"), pct(F.col("one")).alias("deg1_pct"), pct(F.col("many")).alias("many_pct"))


def _side(side: int):
    """The node type at the source (0) or target (1) of an edge."""
    return F.element_at(F.create_map(*[x for k, v in SCHEMA.items() for x in (F.lit(k), F.lit(v[side]))]), F.col("etype"))


def collapse_single(edge: DataFrame, kinds=COLLAPSIBLE) -> tuple[DataFrame, DataFrame]:
    """(kept edges, collapsed nodes (ntype, key, ptype, parent)): nodes of degree 1 fold into the node that points to them.

    Domains of addresses fold into their sender or receiver first, which may bring these down to degree 1; then senders,
    receivers, links, hosts and paths fold into their mail. Two steps reach the fixpoint: a sender or receiver has a mail
    edge, so it has degree 1 only when none of its domain edges is left, and its removal changes no domain.
    """
    kept, parts = edge, []
    for step in (("email_domain",), ("sender", "receiver", "url", "domain", "stem")):
        single = degrees(kept).where((F.col("degree") == 1) & F.col("ntype").isin(*(k for k in step if k in kinds))).select("ntype", F.col("key").alias("dst"))
        typed = kept.withColumn("ntype", _side(1))
        parts.append(typed.join(single, ["ntype", "dst"], "left_semi").select("ntype", F.col("dst").alias("key"), _side(0).alias("ptype"), F.col("src").alias("parent")))
        kept = typed.join(single, ["ntype", "dst"], "left_anti").select(*edge.columns)
    return kept, parts[0].unionByName(parts[1])


def collapsed_sums(collapsed: DataFrame) -> DataFrame:
    """(email, sender_len, sender_domain_len, receiver_len, receiver_domain_len, url_n, domain_n, stem_len): the summed
    vectors that each mail takes over from the nodes folded into it, those of their own folded domains included."""
    length = F.length("key").cast("double")
    inner = collapsed.where("ntype = 'email_domain'").groupBy(F.col("ptype").alias("ntype"), F.col("parent").alias("key")).agg(F.sum(length).alias("inner"))
    own = collapsed.where("ptype = 'email'").join(inner, ["ntype", "key"], "left")
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("ntype") == kind, value)), F.lit(0.0))
    one = F.lit(1.0)
    return own.groupBy(F.col("parent").alias("email")).agg(
        of("sender", length).alias("sender_len"), of("sender", F.col("inner")).alias("sender_domain_len"), of("receiver", length).alias("receiver_len"),
        of("receiver", F.col("inner")).alias("receiver_domain_len"), of("url", one).alias("url_n"), of("domain", one).alias("domain_n"), of("stem", length).alias("stem_len"),
    )


def merged(nodes: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts): rows as a property graph merges them.

    Nodes (ntype, key, ...) are merged by all their properties, edges (etype, src, dst) become a set and those without
    both ends are dropped. counts: (kind, name, rows) of what was handed over, before merging.
    """
    once = nodes.dropDuplicates()
    keys = once.select("ntype", "key").distinct()
    ends = edge.select("etype", "src", "dst").distinct().withColumn("st", _side(0)).withColumn("dt", _side(1))
    held = ends.join(keys.toDF("st", "src"), ["st", "src"], "left_semi").join(keys.toDF("dt", "dst"), ["dt", "dst"], "left_semi")
    counts = nodes.groupBy(F.col("ntype").alias("name")).count().select(F.lit("node").alias("kind"), "name", F.col("count").alias("rows"))
    return once, held.select("etype", "src", "dst"), counts.unionByName(edge.groupBy(F.col("etype").alias("name")).count().select(F.lit("edge").alias("kind"), "name", F.col("count").alias("rows")))


def indexed_edges(edge: DataFrame, index: DataFrame) -> DataFrame:
    """(etype, src, dst): edges by the dense numbers of their nodes; a mail's number is its own index. index: (ntype, key, idx)."""
    typed = edge.select("etype", F.col("src").alias("sk"), F.col("dst").alias("dk"), _side(0).alias("st"), _side(1).alias("dt"))
    targets = index.select(F.col("ntype").alias("dt"), F.col("key").alias("dk"), F.col("idx").alias("dst"))
    sources = index.select(F.col("ntype").alias("st"), F.col("key").alias("sk"), F.col("idx").alias("si"))
    both = typed.join(targets, ["dt", "dk"]).join(sources, ["st", "sk"], "left")
    return both.select("etype", F.when(F.col("st") == "email", F.col("sk").cast("bigint")).otherwise(F.col("si")).alias("src"), "dst")


def without_types(edge: DataFrame, kinds) -> DataFrame:
    """Edges that touch none of the node types; unknown types change nothing."""
    gone = [k for k, (a, b) in SCHEMA.items() if a in kinds or b in kinds]
    return edge.where(~F.col("etype").isin(*gone)) if gone else edge


def undirected(edge: DataFrame) -> DataFrame:
    """All edges and their reverses, named rev_*."""
    return edge.select("etype", "src", "dst").unionByName(edge.select(F.concat(F.lit("rev_"), "etype").alias("etype"), F.col("dst").alias("src"), F.col("src").alias("dst")))


def _roots(batches):
    """(u, to) of the nodes that are linked with a smaller one, over all pairs of one partition."""
    import numpy as np
    import pandas as pd

    pairs = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"u": [], "v": []})])
    if len(pairs):
        nodes, at = np.unique(np.concatenate([pairs["u"].to_numpy(), pairs["v"].to_numpy()]), return_inverse=True)
        u, v = at[: len(pairs)], at[len(pairs) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        yield pd.DataFrame({"u": nodes, "to": nodes[root]})


def components(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over undirected pairs (a, b); nodes are bigints or texts.

    Randomised contraction: in each round every node joins the one of least hash among itself and its neighbours, and
    pairs are redrawn between those. The hash is another one each round, so that a constant share of the nodes is expected
    to vanish whatever the shape; the number of rounds grows with the logarithm of the size. The last LAST pairs are joined by one
    task. Self pairs make single nodes components. Nulls are no nodes.
    """
    pairs = pairs.select("a", "b").where("a is not null and b is not null")
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    links = cut(pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    kind, label = dict(links.dtypes)["u"], None
    for turn in range(rounds):
        last = links.count() <= LAST
        if last:
            joined = cut(links.coalesce(1).mapInPandas(_roots, f"u {kind}, to {kind}"))
        else:
            order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))
            seen = links.select("u", order("v").alias("x")).unionByName(links.select(F.col("v").alias("u"), order("u").alias("x")))
            joined = cut(seen.groupBy("u").agg(F.min("x").alias("x")).select("u", F.least("x", order("u")).getField("to").alias("to")))
        if label is None:
            label = joined.select(F.col("u").alias("node"), F.col("to").alias("rep"))
        else:
            label = label.join(joined.withColumnRenamed("u", "rep"), "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
        if last:
            break
        left = links.join(joined.withColumnRenamed("to", "p"), "u").select("p", "v")
        both = left.join(joined.select(F.col("u").alias("v"), F.col("to").alias("q")), "v").where("p <> q")
        links = cut(both.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
    label = cut(label)
    smallest = label.groupBy("rep").agg(F.min("node").alias("component"))
    return label.join(smallest, "rep").select("node", "component").unionByName(alone.join(label, "node", "left_anti").select("node", F.col("node").alias("component")))


def top_receiver(edge: DataFrame) -> DataFrame:
    """(key, degree) of the receiver with most mails; ties go to the smaller key."""
    return edge.where("etype = 'has_receiver'").groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "key").limit(1)


def receiver_neighbourhood(edge: DataFrame) -> DataFrame:
    """One row per mail of the top receiver and combination of its optional neighbours: sender with its domain, week, link, host, path."""
    distinct = edge.select("etype", "src", "dst").distinct()
    to = lambda kind, name: distinct.where(F.col("etype") == kind).select(F.col("src").alias("email"), F.col("dst").alias(name))
    hub = top_receiver(edge).select(F.col("key").alias("receiver"))
    mail = to("has_receiver", "receiver").join(F.broadcast(hub), "receiver")
    sent = to("has_sender", "sender").join(distinct.where("etype = 'sender_from_domain'").select(F.col("src").alias("sender"), F.col("dst").alias("sender_domain")), "sender")
    received = distinct.where("etype = 'receiver_from_domain'").select(F.col("src").alias("receiver"), F.col("dst").alias("receiver_domain"))
    out = mail.join(sent, "email", "left").join(received, "receiver", "left")
    for kind, name in (("has_url", "url"), ("has_domain", "domain"), ("has_stem", "stem"), ("in_week", "week")):
        out = out.join(to(kind, name), "email", "left")
    return out


def shared_entities(edge: DataFrame, kind: str) -> DataFrame:
    """(multi, total): entities of an edge type that several mails have, and all of them."""
    per = edge.where(F.col("etype") == kind).groupBy("dst").agg(F.countDistinct("email_index").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("multi"), F.count(F.lit(1)).alias("total"))


def stems_sharing_hosts(edge: DataFrame) -> DataFrame:
    """(multi, sharing): paths that several mails have over all hosts of those mails, and those with one host in several mails."""
    stems = edge.where("etype = 'has_stem'").select("email_index", F.col("dst").alias("stem")).distinct()
    hosts = edge.where("etype = 'has_domain'").select("email_index", F.col("dst").alias("domain")).distinct()
    per = stems.join(hosts, "email_index").groupBy("stem", "domain").agg(F.countDistinct("email_index").alias("n"))
    each = per.groupBy("stem").agg(F.sum("n").alias("total"), F.max("n").alias("most")).where("total > 1")
    return each.agg(F.count(F.lit(1)).alias("multi"), F.count_if(F.col("most") > 1).alias("sharing"))
