"""Text decoded with the wrong character encoding, found and restored (problem 2).

A multinomial classifier over hashed byte bigrams is trained on words of the corpus and on the same words garbled by every
known chain of wrong encodings. For a field it weighs, over the words with characters beyond ASCII, that a chain garbled
all or some of them against that nothing did. The best chain is inverted word by word; only what is strictly decodable
is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwork.plans.cut import cut

BUCKETS = 1 << 13
SAMPLE = 12_000  # fields that the classifier is trained on, at most
MARGIN = 4.0  # nats that speak for a single-byte chain at least
LOST = "�"
WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")

_BEYOND = re.compile(r"[^\x00-\x7f]+")
_LETTERS, _DIGITS, _OTHERS = re.compile("[A-Za-z]+"), re.compile("[0-9]+"), re.compile(r"[\x00-/:-@\[-`{-\x7f]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

Step = tuple[str, str]
#: Chains of (really encoded in, wrongly decoded as), outermost last.
CHAINS: list[tuple[Step, ...]] = [
    *(((("utf-8", to),)) for to in ("cp1252", "latin-1", "cp437", "mac-roman", "cp1251", "cp850", "koi8-r", "cp1250")),
    *(((("utf-8", a), ("utf-8", b))) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")),
    *((((source, to),)) for source, to in (("cp1252", "cp437"), ("cp1252", "mac-roman"), ("cp1252", "cp1251"), ("cp1252", "cp850"), ("mac-roman", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "mac-roman"), ("koi8-r", "mac-roman"), ("cp1251", "cp437"))),
]


def _table(codec: str) -> str:
    """The 256 characters of a single-byte encoding; a byte that it leaves undefined stands for the control of its number."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))


_TABLES = {c: _table(c) for chain in CHAINS for step in chain for c in step if c != "utf-8"}
_BYTES = {c: {char: b for b, char in reversed(list(enumerate(t)))} for c, t in _TABLES.items()}
_MULTI = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")


def garble(text: str, chain: tuple[Step, ...]) -> str | None:
    """The text after it went through the chain, or null if an encoding cannot express it."""
    for source, to in chain:
        if source == "utf-8":
            raw = text.encode()
        else:
            known = _BYTES[source]
            if any(c not in known for c in text):
                return None
            raw = bytes(known[c] for c in text)
        text = "".join(_TABLES[to][b] for b in raw)
    return text


def ungarble(text: str, chain: tuple[Step, ...]) -> str | None:
    """The text before it went through the chain, or null where that is not strictly possible.

    Behind UTF-8 each run of its multi-byte sequences is decoded on its own, so that a garbled part beside an intact one
    is restored; behind a single-byte encoding the whole text must belong to it.
    """
    for source, to in reversed(chain):
        known = _BYTES[to]
        if source == "utf-8":
            codes = [known.get(c, 0) for c in text]
            raw = bytes(b if b >= 0x80 else 0 for b in codes)  # what is not of a sequence stands as 0
            out, last = [], 0
            for m in _MULTI.finditer(raw):
                out += [text[last : m.start()], m.group().decode()]
                last = m.end()
            if not last:
                return None
            text = "".join(out) + text[last:]
        else:
            table = _TABLES[source]
            if any(c not in known for c in text):
                return None
            text = "".join(table[known[c]] for c in text)
    return text


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte bigram, where each word's start) over the words in UTF-8 between spaces."""
    parts = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    first = np.cumsum(np.r_[0, sizes[:-1]])
    pair = raw[:-1] * np.uint32(256) + raw[1:]
    keep = np.ones(len(pair), bool)
    keep[(first[1:] - 1)] = False  # between two words
    bucket = (pair * np.uint32(2654435761) >> np.uint32(32 - 13)).astype(np.int64)
    return bucket[keep], np.cumsum(np.r_[0, sizes[:-1] - 1])


def bare(word: str) -> str:
    """The word in lower case without the signs around it; if all beyond ASCII are signs, those with ASCII letters as one letter and numbers as one digit.

    Signs that outweigh what is between them are letters in another encoding and stay.
    """
    core = _EDGES.sub("", word).lower()
    if len(word) - len(core) > max(2, len(core)) and not core.isascii() and len(beyond_ascii(word)) - len(beyond_ascii(core)) > max(2, len(core)):
        return word.lower()
    return _DIGITS.sub("0", _LETTERS.sub("a", _OTHERS.sub("", word))) if core.isascii() else core


def structured(chain: tuple[Step, ...]) -> bool:
    """Whether the multi-byte form of UTF-8 tells that the chain can be inverted."""
    return all(source == "utf-8" for source, _ in chain)


def marked_words(text: str) -> list[str]:
    """The distinct words with characters beyond ASCII, in order; the same that WORD finds."""
    flat, out, end = text.replace("\t", " ").replace("\r", " ").replace("\n", " "), {}, -1
    for m in _BEYOND.finditer(flat):
        if m.start() > end:
            end = flat.find(" ", m.end())
            end = end if end >= 0 else len(flat)
            out[flat[flat.rfind(" ", 0, m.start()) + 1 : end]] = None
    return list(out)


def beyond_ascii(word: str) -> list[str]:
    return [c for c in word if c > "\x7f"]


def _both_cases(letters: set[str]) -> set[str]:
    return letters | {x for c in letters for x in (c.upper(), c.lower()) if len(x) == 1}


def _blocks(letters: set[str]) -> set[int]:
    """The parts of large scripts that the letters belong to; these scripts are not seen whole."""
    return {ord(c) >> 12 << 4 | b for c in letters if c >= "\u3000" for b in range(16)}


def _usual(often: Counter) -> set[str]:
    """The letters of words that no chain of UTF-8 steps leads to, without the rarest."""
    return _both_cases({c for c, n in often.items() if n >= 5e-4 * often.total()})


def _befores(word: str) -> list[str]:
    """What the word may have been before a chain of UTF-8 steps."""
    return [r for c in CHAINS if structured(c) and (r := ungarble(word, c)) is not None and r != word]


def _garbled(word: str, letters: set[str], blocks: set[int]) -> bool:
    """Whether a chain of UTF-8 steps turns the word into letters of the corpus."""
    return any(all(c in letters or (c >= "\u3000" and ord(c) >> 8 in blocks) for c in beyond_ascii(r)) for r in _befores(word))


def _likelihoods(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(log share of each bigram, log share of the words) of each class, from intact words with their counts."""
    counts, share = np.full((len(CHAINS) + 1, BUCKETS), 0.01), np.full(len(CHAINS) + 1, 0.01)
    for i, chain in enumerate([(), *CHAINS]):
        garbled = [(g, n) for w, n in words.items() if (g := garble(w, chain)) is not None and (not chain or g != w)]
        if garbled:
            bucket, start = _features([g for g, _ in garbled])
            weight = np.sqrt([n for _, n in garbled])
            counts[i] += np.bincount(bucket, np.repeat(weight, np.diff(np.r_[start, len(bucket)])), BUCKETS)
            share[i] += weight.sum()
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32), np.log(share / share[0]).astype(np.float32)


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class Hashed:
    """Counts of words by 64 bits of hash, sorted: 16 bytes a word, however long it is."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def get(self, word: str, default: int = 0) -> int:
        h = np.int64(_hash(word))
        at = self.keys.searchsorted(h)
        return int(self.counts[at]) if at < len(self.keys) and self.keys[at] == h else default

    __getitem__ = get

    def __contains__(self, word: str) -> bool:
        return self.get(word) > 0

    def __len__(self) -> int:
        return len(self.keys)


class Classifier:
    """Multinomial naive Bayes: class 0 is intact text, class i + 1 the chain i. A class' share is that of the words it can garble."""

    def __init__(self, log_p: np.ndarray, log_share: np.ndarray, vocabulary: dict[str, int] | Hashed, raw: set[str] | Hashed, letters: set[str], own: int = 0):
        self.log_p, self.log_share, self.vocabulary, self.raw, self.letters = log_p, log_share, vocabulary, raw, letters
        self.blocks = _blocks(letters)
        self.known: dict[str, np.ndarray] = {}
        self.counts: dict[str, int] = {}
        self.inverse: dict[tuple[int, str], str | None] = {}
        self.own = own  # 1 if the field that is judged is itself among those counted: then a word must occur elsewhere to be known

    @classmethod
    def train(cls, words: Counter, rounds: int = 2) -> Classifier:
        """Fit bigrams, vocabulary and letters to words with their counts. Words that are garbled themselves are left out first: those that UTF-8
        steps turn into letters of the corpus, and those that a single-byte step turns into a much more common word."""
        intact = {w: n for w, n in words.items() if LOST not in w and len(w) <= 200}
        often = Counter()
        for w, n in intact.items():
            if not _befores(w):
                for c in beyond_ascii(w):
                    often[c] += n
        letters = _usual(often)
        blocks = _blocks(letters)
        intact = {w: n for w, n in intact.items() if not _garbled(w, letters, blocks)}
        for turn in range(rounds):
            vocabulary: Counter = Counter()
            for w, n in intact.items():
                vocabulary[bare(w)] += n
            model = cls(*_likelihoods(intact), dict(vocabulary), set(intact), _both_cases({c for w in intact for c in beyond_ascii(w)}))
            names = list(intact)
            if turn == rounds - 1 or not names:
                return model
            for w, r in model.turned(names):
                if vocabulary[bare(r)] >= 3 * vocabulary[bare(w)]:
                    del intact[w]
        return model

    def turned(self, words: list[str]) -> list[tuple[str, str]]:
        """(word, what it was before) for the words that a chain speaks for."""
        if not words:
            return []
        scores = self.scores(words)
        best = scores[:, 1:].argmax(1)
        return [(w, r) for k, w in enumerate(words) if scores[k, best[k] + 1] > scores[k, 0] + 2 and (r := ungarble(w, CHAINS[best[k]])) is not None]

    def count(self, word: str) -> int:
        """How often the bare word occurs in the corpus."""
        n = self.counts.get(word)
        if n is None:
            if len(self.counts) > 500_000:
                self.counts.clear()
            n = self.counts[word] = self.vocabulary.get(bare(word), 0)
        return n

    def before(self, word: str, chain: int) -> str | None:
        """The word before it went through the chain, remembered."""
        key = (chain, word)
        if key not in self.inverse:
            if len(self.inverse) > 500_000:
                self.inverse.clear()
            self.inverse[key] = ungarble(word, CHAINS[chain])
        return self.inverse[key]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word under each class."""
        if not words:
            return np.empty((0, len(CHAINS) + 1), np.float32)
        bucket, start = _features(words)
        return np.add.reduceat(self.log_p[:, bucket], start, axis=1).T + self.log_share

    def table(self, words: list[str]) -> np.ndarray:
        """The same, remembered from word to word."""
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) > 200_000:
                self.known.clear()
                new = words
            self.known.update(zip(new, self.scores(new)))
        return np.stack([self.known[w] for w in words])


def _replacements(words: list[str], gain: np.ndarray, chain: int, model: Classifier) -> tuple[float, dict[str, str]]:
    """(weight of evidence, word -> restored word) for a chain.

    Behind UTF-8 the multi-byte form itself is the evidence, as long as it yields letters of the corpus. Behind a
    single-byte encoding everything is decodable: there a restored word must be more common in the corpus than the word
    as it stands, and unknown ones follow only where most are known.
    """
    primary, more, open_, weight = {}, {}, {}, 0.0
    multi = structured(CHAINS[chain])
    for w, g in zip(words, gain.tolist()):
        if (r := model.before(w, chain)) is None or r == w:
            continue
        before, after = max(0, model.count(w) - model.own), model.count(r)  # elsewhere than here
        familiar = all(c in model.letters or (c >= "\u3000" and ord(c) >> 8 in model.blocks) for c in beyond_ascii(r))
        if multi:
            if w not in model.raw and familiar:
                primary[w] = r
                weight += max(g, 0.5)
        elif g > 0 and (after > 20 * before if before else after > 0):
            primary[w] = r
            weight += g
        elif after > 2 * before:
            more[w] = r
        elif g > 2 and not before and familiar:
            open_[w] = r
    if multi or not primary:
        return weight, primary
    if len(primary) + len(more) >= len(open_):
        more |= open_
    return weight + 0.1 * len(more), more | primary


def restore(text: str | None, model: Classifier) -> tuple[str | None, bool]:
    """(text as it was meant, whether it was garbled). Of a text with lost characters what can be restored is."""
    if not text or text.isascii():
        return text, False
    garbled = LOST in text
    for turn in range(3):
        plain = [w for w in marked_words(text) if LOST not in w]
        counts, own = model.counts, model.own
        if all((n if (n := counts.get(w)) is not None else model.count(w)) > own for w in plain):
            break
        gain = model.table(plain)
        gain = gain[:, 1:] - gain[:, :1]
        score = np.maximum(gain, 0.0).sum(0)
        best: tuple[float, dict[str, str]] = (0.0, {})
        for k in np.argsort(-score):
            if score[k] <= 0 and best[1]:
                break  # nothing speaks for what is left
            multi = structured(CHAINS[k])
            if turn and not multi:
                continue  # what a part of one field went through beside another chain shows in its form
            found = _replacements(plain, gain[:, k], int(k), model)
            if found[1] and found[0] > best[0] and (multi or found[0] >= MARGIN):
                best = found
        if not best[1]:
            break
        garbled, new = True, best[1]
        text = WORD.sub(lambda m: new.get(m.group(), m.group()), text)
    return text, garbled


def _words(last: int | None):
    """(w, n, drawn, a, b): of each word of some fields how many hold it, how many of those have a hash up to `last`, and the least and greatest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[int]] = {}
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in marked_words(text):
                    x = held.get(w)
                    if x is None:
                        held[w] = [1, int(h <= last), h, h]
                    else:
                        x[0] += 1
                        x[1] += h <= last
                        x[2], x[3] = min(x[2], h), max(x[3], h)
            rows = [(w, *x) for w, x in held.items() if len(w) <= 200]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["w", "n", "drawn", "a", "b"])

    return run


def _mapped(words: DataFrame, judge, schema: str) -> DataFrame:
    """What judge makes of each batch of words (w, n, drawn), given as lists: the columns of the schema."""
    kinds = [(c.split()[0], {"string": pa.string(), "bigint": pa.int64()}[c.split()[1]]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judge(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=[n for n, _ in kinds])

    return words.mapInArrow(run, schema)


def _free_letters(words: list[str], counts: list[int], *_) -> list[tuple[str, int]]:
    often = Counter()
    for w, n in zip(words, counts):
        if LOST not in w and not _befores(w):
            for c in beyond_ascii(w):
                often[c] += n
    return list(often.items())


def _hashed(counted: DataFrame) -> Hashed:
    found = counted.toArrow()  # 16 bytes a word
    return Hashed(*(found.column(i).to_numpy() for i in (0, 1)))


def fit(rows: DataFrame, fields: list[str], sample: int = SAMPLE, rounds: int = 2) -> Classifier:
    """The classifier of a corpus: vocabulary and letters from all fields with characters beyond ASCII, bigrams from
    at most `sample` different ones, chosen by the hash of their text. A word counts the fields that hold it; where these are
    copies of one text, that is one.

    The steps are those of Classifier.train, taken by the executors; to the driver come the words of the sample, the
    letters, and of all other words a hash with its count.
    """
    texts = [rows.select(F.col(f).alias("t")).where("octet_length(t) > length(t)") for f in fields]
    both = texts[0]
    for t in texts[1:]:
        both = both.unionByName(t)
    hashed = both.select("t", F.xxhash64("t").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    held = hashed.mapInArrow(_words(last), "w string, n bigint, drawn bigint, a bigint, b bigint").groupBy("w")
    counted = held.agg(F.sum("n").alias("all"), F.sum("drawn").alias("drawn"), F.min("a").alias("a"), F.max("b").alias("b"))
    words = cut(counted.select("w", F.when(F.col("a") == F.col("b"), 1).otherwise(F.col("all")).alias("n"), "drawn"))
    often = _mapped(words, _free_letters, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()  # letters
    letters = _usual(Counter({r["c"]: r["n"] for r in often}))
    blocks = _blocks(letters)
    judge = lambda ws, ns, ds: [(w, n, d, _hash(bare(w)), _hash(w)) for w, n, d in zip(ws, ns, ds) if LOST not in w and not _garbled(w, letters, blocks)]
    intact = cut(_mapped(words, judge, "w string, n bigint, drawn bigint, h bigint, raw bigint"))
    for turn in range(rounds):
        drawn = intact.where("drawn > 0").select("w", "drawn").orderBy("w").collect()  # words of the sample
        log_p, log_share = _likelihoods({r["w"]: r["drawn"] for r in drawn})
        vocabulary = intact.groupBy("h").agg(F.sum("n").alias("v"))
        if turn < rounds - 1:
            model = (log_p, log_share, {}, set(), set())
            turned = _mapped(intact.select("w"), lambda ws: [(w, _hash(bare(w)), _hash(bare(r))) for w, r in Classifier(*model).turned(ws)], "w string, h bigint, before bigint")  # noqa: B023
            more = turned.join(vocabulary, "h").join(vocabulary.select(F.col("h").alias("before"), F.col("v").alias("more")), "before").where("more >= 3 * v")
            intact = cut(intact.join(more.select("w"), "w", "left_anti"))
    used = _mapped(intact.select("w"), lambda ws: [(c,) for c in {c for w in ws for c in beyond_ascii(w)}], "c string").distinct().collect()  # letters
    return Classifier(log_p, log_share, _hashed(vocabulary), _hashed(intact.where("n > 1").select("raw", "n")), _both_cases({r["c"] for r in used}), 1)


def _over(model: tuple, n: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Classifier(*model)
        for batch in batches:
            columns = [batch.column(0)]
            for i in range(1, n + 1):
                found = [restore(t, fitted) for t in batch.column(i).to_pylist()]
                if digest:
                    columns.append(pa.array([None if not g else "" if LOST in t else md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t, g in found], pa.string()))
                else:
                    columns.append(pa.array([t for t, _ in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["k", *(f"f{i}" for i in range(1, n + 1))])

    return run


def restored_texts(rows: DataFrame, key: str, fields: list[str], model: Classifier) -> DataFrame:
    """(key, *fields) with garbled fields restored as far as possible and all others as they are."""
    kind = dict(rows.dtypes)[key]
    source = rows.select(F.col(key).alias("k"), *fields)
    return source.mapInArrow(_over((model.log_p, model.log_share, model.vocabulary, model.raw, model.letters, model.own), len(fields), False), f"k {kind}, {', '.join(f'f{i + 1} string' for i in range(len(fields)))}").toDF(key, *fields)


def garbled_fields(rows: DataFrame, key: str = "email_index", fields: list[str] = ("subject", "body")) -> DataFrame:
    """(key, field, restored_md5): one row per garbled field; the digest is that of the restored text, or empty if characters are lost.

    Null, empty and pure ASCII fields are never garbled. Fields are read whole; repeated rows repeat their result; other
    columns are ignored; an empty table gives an empty result. Lost characters are those that stand as U+FFFD.
    """
    fields = list(fields)
    model = fit(rows, fields)
    kind = dict(rows.dtypes)[key]
    some = F.coalesce(*(F.when(F.octet_length(f) > F.length(f), F.lit(True)) for f in fields), F.lit(False))
    found = rows.where(some).select(F.col(key).alias("k"), *fields).mapInArrow(_over((model.log_p, model.log_share, model.vocabulary, model.raw, model.letters, model.own), len(fields), True), f"k {kind}, {', '.join(f'f{i + 1} string' for i in range(len(fields)))}")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f{i + 1}").alias("m")) for i, f in enumerate(fields)))).alias("x")
    return found.select(F.col("k").alias(key), pairs).select(key, F.col("x.field").alias("field"), F.col("x.m").alias("restored_md5")).where("restored_md5 is not null")
