"""The text operators against brute force, round trips and planted cases, with nulls, repeats and empty tables."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoalwork.llm import mojibake as M
from shoalwork.llm.containers import fill_containers, plan_best_fit
from shoalwork.llm.hashing import slices
from shoalwork.llm.inherited import MOST_BITS, MOST_EDITS, _in_tables, fingerprints, inherited_lines, judged_lines, near_known, read_marks, sentences, slots, used_slots
from shoalwork.llm.lookalikes import lookalike_pairs, visible_forms
from shoalwork.llm.mailings import _pairs, cluster_mails, described, markov_clusters, neighbours
from shoalwork.llm.nearsets import all_pairs, groups, similar_pairs
from shoalwork.llm.tokens import _cut_long, _encode_parts, cut_points, encode_corpus, encode_spans, load, merge_tree, tokenizer_path

WORDS = "alpha beta gamma delta engine ferry garden harbour invoice journal kettle ledger museum notice office parcel quota report signal ticket".split()


# --- tokens


def encoder():
    tokenizer = load(tokenizer_path())
    return lambda t: tokenizer.encode(t, add_special_tokens=False)


@pytest.mark.parametrize("seed", range(6))
def test_tree_of_parts_is_exact(seed):
    rng, encode = random.Random(seed), encoder()
    alphabets = ["abcdefghij", "ab", "a'", "'s!l", "日本語をするのは", "a1", "12", ".,;'!?-", "é ü", "  a\n", "👩💻é", "x'll've", "́a "]
    for _ in range(120):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 700)))
        leaf = rng.choice([3, 10, 30, 60])
        parts = cut_points(text, leaf)
        assert "".join(text[a:b] for a, b, _ in parts) == text and all(b - a <= leaf for a, b, _ in parts)
        ids, stretch = [], []
        for p in [*parts, None]:
            if stretch and (p is None or not p[2]):
                ids += merge_tree(encode, text, stretch)[0]
                stretch = []
            if p:
                stretch.append((p[0], p[1], encode_spans(encode, text[p[0] : p[1]], p[0])))
        assert ids == encode(text).ids


def test_corpus_ids(spark):
    encode = encoder()
    texts = [None, "", "  \n", "Hello <|endoftext|> world", "x" * 900, "日本語" * 400, "a b " * 300, "dup " * 100, "dup " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in encode_corpus(docs, leaf=200).collect()}
    assert got == {i: encode(t or "").ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in encode_corpus(docs, leaf=200, counts=True).collect()} == {i: len(v) for i, v in got.items()}
    assert encode_corpus(docs.limit(0)).collect() == []


# --- containers


def test_parts_are_encoded_in_small_batches():
    """Parts that stand alone carry only their ids, and a batch of any size is worked on and handed on in slices."""
    texts = [f"{i} " + "alpha beta gamma " * 350 for i in range(1_200)]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(len(texts)))), pa.array(texts)], names=["r", "t"])
    cut = pa.Table.from_batches(_cut_long(6_000)(iter([batch]))).combine_chunks().to_batches()
    found = list(_encode_parts(tokenizer_path())(iter(cut)))
    assert sum(x.num_rows for x in found) == sum(x.num_rows for x in cut) and max(x.nbytes for x in found) < 4 << 20
    assert all(x.column(c).null_count == x.num_rows for x in found for c in ("part", "at", "words"))


def test_plan_equals_plain_best_fit():
    rng = random.Random(2)
    for _ in range(120):
        capacity = rng.choice([5, 10, 64])
        histogram = {rng.randrange(0, capacity + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 30))}
        used = defaultdict(list)
        for n, entries in plan_best_fit(histogram, capacity).items():
            for i, (rank, first, each, offset) in enumerate(entries if n else []):
                end = entries[i + 1][0] if i + 1 < len(entries) else histogram[n]
                for k in range(rank, end):
                    at = offset + (k - rank) % each * n
                    used[first + (k - rank) // each].append((at, at + n))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        bins: list[int] = []
        for n in sorted((n for n in histogram if n), reverse=True):
            for _ in range(histogram[n]):
                fit = [b for b in range(len(bins)) if bins[b] >= n]
                if fit:
                    bins[min(fit, key=bins.__getitem__)] -= n
                else:
                    bins.append(capacity - n)
        assert len(used) == len(bins)


def test_containers(spark):
    sizes = [0, None, 3, 3, 3, 7, 10, 25, 4, 4, 6] + [2] * 50
    docs = spark.createDataFrame(list(enumerate(sizes)) + [(2, 3)], "doc_id long, n_tokens int").withColumn("piece", F.lit("clash"))
    rows = fill_containers(docs, 10).collect()
    assert sum(r.n_tokens for r in rows) == sum(s or 0 for s in sizes) + 3
    assert sorted((r.piece, r.first_token, r.n_tokens) for r in rows if r.doc_id == 7) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    by = defaultdict(list)
    for r in rows:
        if r.n_tokens:
            by[r.container_no].append((r.offset, r.offset + r.n_tokens))
    for spans in by.values():
        spans.sort()
        assert spans[-1][1] <= 10 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert fill_containers(docs.limit(0), 10).collect() == []
    with pytest.raises(ValueError):
        fill_containers(docs, 0)


# --- look-alikes


def test_lookalikes(spark):
    texts = ["Café ОK fine", "Café OK ﬁne", "Ｃafé O​K fine", "Cafe OK fine", "Café  OK fine", None, "", "​", "⁠", "Café ОK fine", "が", "が", "№ 1", "No 1", "👩‍💻", "👩💻"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("f", F.lit("clash"))
    got = sorted(tuple(r) for r in lookalike_pairs(docs).collect())
    assert got == [(0, 1), (0, 2), (1, 2), (1, 9), (2, 9), (10, 11)]
    forms = {r.doc_id: r.form for r in visible_forms(docs).collect()}
    assert forms[0] == forms[1] == forms[2] == "Café OK fine" and forms[5] is None and forms[6] == ""
    assert lookalike_pairs(docs.limit(0)).collect() == []


# --- garbled text


def corpus(rng, n=1500):
    stock = ["Die gültige Überweisung für Müllingen läuft über die Währung", "Notre société préfère la créance réglée à Zoë", "La reunión única de la campaña económica está aquí", "Срочно проверьте важную справку в городе", "Don’t label the “weekly parcel” — it costs 12 €", "Żółta gwarancję leży w świeżą część umowę"]
    return [" ".join(rng.sample(rng.choice(stock).split(), 6)) for _ in range(n)]


def test_chains_are_inverted():
    text = "Grüße für 12 € – “São”"
    for chain in M.CHAINS:
        garbled = M.garble(text, chain)
        if garbled is not None and garbled != text:
            assert M.ungarble(garbled, chain) == text
    assert M.ungarble("SÃO", (("utf-8", "cp1252"),)) is None and M.ungarble("plain", (("utf-8", "cp1252"),)) is None


def test_held_out_accuracy():
    rng = random.Random(5)
    train, test = corpus(rng), corpus(rng, 200)
    model = M.Classifier.train(Counter(w for t in train for w in M.WORD.findall(t)))
    assert not any(M.restore(t, model)[1] for t in test)
    for chain in M.CHAINS:
        cases = [(t, g) for t in test if (g := M.garble(t, chain)) not in (None, t)]
        least = 0.7 if chain == (("cp1251", "mac-roman"),) else 0.98  # there a lone euro sign becomes a word that is known
        assert cases and sum(M.restore(g, model)[0] == t for t, g in cases) >= least * len(cases)


def test_garbled_fields(spark):
    rng = random.Random(6)
    rows = [(i, None, t) for i, t in enumerate(corpus(rng, 800))]
    meant = "Die gültige Überweisung für Müllingen"
    rows += [(1000, M.garble(meant, M.CHAINS[0]), None), (1001, "f�r", "plain"), (1002, "", None), (1003, meant.replace("für", "fÃ¼r"), "x " * 50_000)]
    df = spark.createDataFrame(rows, "email_index long, subject string, body string").withColumn("field", F.lit("clash"))
    from hashlib import md5

    digest = md5(meant.encode()).hexdigest()
    assert sorted(tuple(r) for r in M.garbled_fields(df).collect()) == [(1000, "subject", digest), (1001, "subject", ""), (1003, "subject", digest)]
    assert M.garbled_fields(df.limit(0)).collect() == []


def test_words_outside_the_sample_are_known(spark):
    rng = random.Random(8)
    rows = corpus(rng, 300) + [f"{t} Störung" for t in corpus(rng, 30)]
    df = spark.createDataFrame(list(enumerate(rows)), "email_index long, body string")
    model = M.fit(df, ["body"], sample=5)
    assert model.vocabulary["störung"] == 30 and "Störung" in model.raw


def test_model_of_many_words_stays_small(spark):
    """However long and many the words are, 16 bytes of each come to the driver for each of its forms."""
    import pickle

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=60)) + "ö" for _ in range(4_000)]
    rows = corpus(rng, 300) + [" ".join(words[i : i + 40]) for k in (0, 20) for i in range(k, 4_000, 40)]
    model = M.fit(spark.createDataFrame(list(enumerate(rows)), "email_index long, body string"), ["body"], sample=5)
    assert model.vocabulary[words[50]] == 2 and words[50] in model.raw and words[50] + "x" not in model.raw
    assert len(pickle.dumps((model.vocabulary, model.raw))) < 40 * len(words)


def test_fit_equals_training_in_memory(spark):
    rng = random.Random(10)
    texts = corpus(rng, 200)
    texts += [g for i, t in enumerate(texts[:60]) if (g := M.garble(t, M.CHAINS[i % len(M.CHAINS)])) is not None]
    counts = Counter(w for t in texts for w in M.marked_words(t))
    one, two = M.Classifier.train(counts), M.fit(spark.createDataFrame(list(enumerate(texts)), "email_index long, body string"), ["body"])
    assert one.letters == two.letters and len(one.vocabulary) == len(two.vocabulary) < len({M.bare(w) for w in counts})
    single = {w for w in counts if sum(w in M.marked_words(t) for t in set(texts)) == 1}
    assert all(two.vocabulary[w] == n for w, n in one.vocabulary.items() if not any(M.bare(x) == w for x in single))


# --- inherited lines

MAIL = """Hello Zoë,

The parcel key for your office is 12; use it only there.
78 > 858 in the quota table, so weigh it

From: Wendal to the museum, the road stays closed.

Best regards,
Ivo Tanner
Sales Desk
+1 555 0100

On 2007-09-18 14:59, Ilsa Luna
<ilsa@x.test> wrote:
> The old ledger is here
and wrapped
> badly.

-----Original Message-----
From: Edda Y <info@y.test>
Sent: 22.7.2007 02:43
To: info@z.test
Subject: ferry

Old text without a sign."""


def test_marks():
    lines = MAIL.split("\n")
    mark, _ = read_marks(lines)
    new = [x for x, m in zip(lines, mark) if not m and x.strip()]
    assert new == ["Hello Zoë,", "The parcel key for your office is 12; use it only there.", "78 > 858 in the quota table, so weigh it", "From: Wendal to the museum, the road stays closed."]


def test_inherited_lines(spark):
    notice = "This e-mail is meant for its addressee alone. Any reader other than the named recipient must not rely on its content."
    framed = f"Text of mail {{}}.\n\n{'*' * 20}\n{notice}\n{'*' * 20}"
    rows = [(i, framed.format(i)) for i in range(4)] + [(10, f"Some new words here today.\n\n{notice.upper()}"), (11, MAIL.replace("\n", "\r\n")), (12, None), (13, ""), (14, "Just a sentence, nothing else in it.\n\nAnd another one of the same kind."), (15, "word " * 60_000)]
    df = spark.createDataFrame(rows, "email_index long, body string").withColumn("line", F.lit("clash"))
    got = defaultdict(set)
    for r in inherited_lines(df).collect():
        got[r.email_index].add(r.line_no)
    assert all(got[i] == {3, 4, 5} for i in range(4))
    assert got[10] == {3}  # without a frame: known from the corpus
    assert got[11] == {i + 1 for i, m in enumerate(read_marks(MAIL.split("\n"))[0]) if m}
    assert not got[12] and not got[13] and not got[14] and not got[15]
    assert inherited_lines(df.limit(0)).collect() == []


def test_unmarked_notices_with_other_names(spark):
    notice = "Disclaimer: the content of this message belongs to {} and may not be passed on."
    names = ["Broindline & Co", "Ostanmed", "Yarebank", "Lunemed Ltd", "Pelibank GmbH", "Tanasoft", "Zanumtec", "Calepost", "Dorerg", "Holamart", "Ulobank", "Navenline"]
    plain = "We met {} and the engine was put into the harbour again.\n\nIt ran for a day and nobody was there to see it leave.\n\n"
    marked = [plain.format(n) + notice.format("Morolmbank") for n in ("Ann", "Bob", "Cid")]
    rows = [*marked, *(plain.format(n) + notice.format(n)[12:] for n in names)]
    found = {(r.email_index, r.line_no) for r in inherited_lines(spark.createDataFrame(list(enumerate(rows)), "email_index long, body string")).collect()}
    assert found == {(i, 5) for i in range(len(rows))}


def test_tables_against_brute_force(spark):
    """Recall over all accepted pairs; up to 5 bits nothing is lost."""
    rng = random.Random(5)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, last = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    known = [text(rng.randrange(8, 30)) for _ in range(25)]
    asked = sorted({" ".join(rng.choice(["é", *WORDS]) if rng.random() < 0.06 else w for w in rng.choice(known).split()) for _ in range(150)} | {text(8) for _ in range(30)} | {"x" * 900, ""})
    marks, prints = fingerprints(pa.array(known)), fingerprints(pa.array(asked))
    apart = {t: min(((int(f) ^ int(m)).bit_count() for k, m in zip(known, marks) if edits(t, k) <= MOST_EDITS * max(len(t), len(k))), default=64) for t, f in zip(asked, prints)}
    table = spark.createDataFrame([(0, k) for k in known], "scope long, text string").mapInArrow(_in_tables, "slot bigint, scope bigint, text string, print bigint")
    slot = slots(prints, prints * 0).view("int64").tolist()
    rows = spark.createDataFrame([(0, t, p, s) for t, p, s in zip(asked, prints.view("int64").tolist(), slot)], "scope long, text string, print long, slots array<long>")
    got = {r.text for r in near_known(rows, table).collect()}
    want = {t for t, d in apart.items() if d <= MOST_BITS}
    assert 40 < len(want) < len(asked) and got <= want and {t for t, d in apart.items() if d <= 5} <= got and len(got) >= 0.9 * len(want)
    used = used_slots(table)
    place = [int(r.slot) & (1 << 27) - 1 for r in table.collect()]
    assert all(used[p >> 15][(p & 32767) >> 3] >> (p & 7) & 1 for p in place)


def test_masked_names():
    assert sentences(["Navevtec GmbH accepts no liability,", "12 parts. Der Morolm."]) == ["x x accepts no liability, 0 parts."]
    assert sentences(["THIS MAIL IS MEANT FOR YOU. IT IS NOT FOR OTHERS."]) == ["x mail is meant for you.", "x is not for others."] and sentences([""]) == []


def test_signatures_of_a_sender(spark):
    signed = "We met {} and the engine was put into the harbour again.\n\n-- \nIvo Tanner\nSales Desk\n+1 555 0100"
    bare = "We met Zoe and the engine was put into the harbour again.\n\nIvo Tanner\nSales Desk Europe\nroom behind the stair"
    rows = [(1, signed.format("Ann"), "Ivo <ivo@x.test>"), (5, signed.format("Bob"), "Ivo <ivo@x.test>"), (2, bare.replace(" Europe\nroom behind the stair", "\n+1 555 0101"), "IVO@x.test"), (3, bare, "ivo@x.test"), (4, bare, None)]
    df = spark.createDataFrame(rows, "email_index long, body string, sender string")
    found = {(r.email_index, r.line_no, r.by) for r in judged_lines(df).collect()}
    assert {(1, n, "marks") for n in (3, 4, 5, 6)} <= found and {n for k, n, _ in found if k == 2} == {3, 4, 5} and not {k for k, _, _ in found} & {3, 4}


def test_mails_of_a_signature_are_counted_exactly(spark):
    """Two mails whose keys an estimate of distinct values takes for one make a signature known."""
    both = spark.range(1, 4_000).select("id", F.explode(F.array(F.lit(0), "id")).alias("k"))
    other = both.groupBy("id").agg(F.approx_count_distinct("k").alias("n")).where("n = 1").agg(F.min("id")).first()[0]
    signed = "We met {} and the engine was put into the harbour again.\n\n-- \nIvo Tanner\nSales Desk\n+1 555 0100"
    bare = "We met Zoe and the engine was put into the harbour again.\n\nIvo Tanner\nSales Desk\n+1 555 0101"
    rows = [(0, signed.format("Ann"), "ivo@x.test"), (other, signed.format("Bob"), "ivo@x.test"), (9_000, bare.replace("+1 ", "room "), "ivo@x.test")]
    found = {(r.email_index, r.line_no) for r in inherited_lines(spark.createDataFrame(rows, "email_index long, body string, sender string")).collect()}
    assert other and {n for k, n in found if k == 9_000} == {3, 4, 5}


def test_marks_in_linear_time():
    import time

    garbled = "Ã\x90â\x80\x9dÃ\x90Â¾Ã\x90Â±Ã\x91â\x82¬Ã\x91â\x80¹Ã\x90Â¹ Ã\x90Â´Ã\x90ÂµÃ\x90Â½Ã\x91Å\x92,"
    start = time.process_time()
    read_marks([garbled, "Best regards,", garbled] * 20)
    read_marks(["On 2007-09-18 14:59, Ilsa Luna wrote:", "", "Best regards,", ""] * 5_000)
    assert time.process_time() - start < 3


# --- near-duplicates


def near_corpus(rng, n, least_words=25, most=120):
    texts = []
    while len(texts) < n:
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(least_words, most))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            edited = list(base)
            for _ in range(rng.randrange(0, 8)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\n", "\r\n\t "]).join(edited))
    return texts[:n]


def brute(texts, t, least):
    sets = {}
    for i, x in enumerate(texts):
        w = re.findall(r"[^ \t\r\n]+", x or "")
        s = set(zip(w, w[1:], w[2:]))
        if x is not None and len(s) >= least:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("segments", [4096, 24])
def test_similar_pairs_lose_nothing(spark, segments):
    """With few segments all are crowded and sets meet through deletions."""
    rng = random.Random(segments)
    texts = near_corpus(rng, 160) + [None, "", "too short", "dup " * 3 + " ".join(map(str, range(60)))] * 2
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows + rows[:20] + rows[-1:] + [(None, texts[0])], "k long, t string").withColumn("s", F.lit("clash")).withColumn("size", F.lit(1))
    pairs, members = similar_pairs(df, "k", "t", segments=segments)
    got = [tuple(r) for r in all_pairs(pairs, members, "k").collect()]
    want = brute(texts, 0.7, 20)
    assert len(got) == len(set(got)) and set(got) == want
    rows = {r.k: r for r in groups(pairs, members, "k").collect()}
    assert len(rows) == members.count() and all(rows[a].group_id == rows[b].group_id for a, b in want)
    assert {k for k, r in rows.items() if r.links == 0 and r.group_id == k == r.representative} >= set(rows) - {x for p in want for x in p}


def test_batches_are_sliced_by_bytes():
    texts = ["x" * 300_000, None, "y" * 2_000_000, "", "z"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(15)), pa.array(texts)], names=["k", "t"])
    parts = list(slices([batch, batch.slice(0, 0)]))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(15))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()[1:]) <= 1 << 20 for p in parts)


def test_similar_pairs_empty(spark):
    pairs, members = similar_pairs(spark.createDataFrame([], "k long, t string"), "k", "t")
    assert pairs.collect() == [] and members.collect() == []


# --- mailings


def test_markov_clusters(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.05), (30, 31, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    for block in (1000, 3):  # as one matrix and distributed
        got = {r.node: r.attractor for r in markov_clusters(df, block=block).collect()}
        assert len({got[i] for i in range(5)}) == 1 == len({got[i] for i in range(10, 15)}) and got[0] != got[10] and got[30] == got[31]
    assert markov_clusters(df.limit(0)).collect() == []


def test_all_features_of_a_long_mail_are_paired():
    items = [[{"f": i, "df": 2} for i in range(300)], [{"f": 7, "df": 2}, {"f": 290, "df": 2}], []]
    batch = pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.struct([("f", pa.int64()), ("df", pa.int64())])))], names=["items"])
    found = Counter()
    for part in _pairs(iter([batch])):
        found.update({(a, b): n for a, b, n in zip(*(part.column(i).to_pylist() for i in range(3)))})
    assert found == Counter({(a, b): 1 + ((a, b) == (7, 290)) for a in range(300) for b in range(a + 1, 300)})


def test_mailings(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.sample("engine ferry garden harbour invoice journal kettle ledger museum notice office parcel quota report signal ticket urgent quiet narrow sealed priority portable meeting voucher deposit".split(), 9)).capitalize() + "."
    pools = [[sentence() for _ in range(6)] for _ in range(4)]
    rows, truth = [], {}
    for i in range(120):
        if i % 3 == 0:
            truth[i] = i // 3 % 4
            body = " ".join(rng.sample(pools[truth[i]], 4))
        else:
            body = " ".join(sentence() for _ in range(5))
        rows.append((i, "Dear customer,\n\n" + body, ["http://shop.test/x"] if i % 7 == 0 else None))
    rows += [(500, None, None), (501, "", [None, ""]), (502, " ", ["not a link"])]
    df = spark.createDataFrame(rows, "email_index long, body string, urls array<string>").withColumn("cluster", F.lit("clash"))
    clusters = cluster_mails(df).cache()
    got = {r.email_index: r.cluster for r in clusters.collect()}
    assert set(got) == set(truth) and len(set(got.values())) == 4
    assert all((got[a] == got[b]) == (truth[a] == truth[b]) for a in truth for b in truth)
    want = {(m[i], m[i + 1]) for c in range(4) for m in [[k for k in sorted(truth) if truth[k] == c]] for i in range(len(m) - 1)}
    assert {tuple(r) for r in neighbours(clusters).collect()} == want
    assert sorted((r.size, len(r.typical)) for r in described(clusters).collect()) == [(10, 3)] * 4
    assert cluster_mails(df.limit(0)).collect() == []


def test_neighbours_acrossslices(spark):
    keys = [1, 5, 40_000, 40_001, 200_000]
    df = spark.createDataFrame([(k, 1, 0.5) for k in keys], "email_index long, cluster long, flow double")
    assert sorted(tuple(r) for r in neighbours(df).collect()) == list(zip(keys, keys[1:]))
