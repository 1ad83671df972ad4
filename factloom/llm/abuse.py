"""Abusive, hateful or sexual content.

Method: a factorization machine over hashed terms: words, runs of characters within them, and pairs of neighbours, without any list of words. Beside a weight per term it learns a small vector per term, whose inner products
weigh pairs, such as an insult with an address or a group with a verdict, which no sum of single weights can tell from the same words
about code or oneself. Passages are scored, not documents, so that one sentence in a long page is not averaged away; the score of
a document is that of its worst passage. Reviewers label documents: the fit therefore picks, round by round, the passage of
each rejected document that best explains the verdict, and doubts verdicts that no passage explains.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Hashed terms, factors of each, words of a passage (longer ones are taken in overlapping windows) and characters of a run within a word.
BUCKETS, FACTORS, WORDS, GRAM = 1 << 16, 8, 18, 4
#: Rounds in which the passages that explain verdicts are chosen anew, and passes over the passages in each and in the last fit.
ROUNDS, EPOCHS, LAST_EPOCHS = 3, 6, 10
#: Labelled documents and passages that the model is fitted on, at most; every document is scored whole.
LABELLED_DOCUMENTS, LABELLED_PASSAGES = 10_000, 200_000
#: Documents that nobody reviewed, at most, and the weight with which they count as clean.
ASSUMED_DOCUMENTS, ASSUMED_WEIGHT = 3_000, 0.1
THRESHOLD = 0.35
#: Score before the logistic function of a passage of which no term is known: most passages are clean.
PRIOR = -1.0
#: Probability from which a rejected document's worst passage is taken to be the reason.
SUSPECT = 0.12
#: Probability from which a passage of a document taken as clean counts little, or not at all if nobody reviewed it.
DOUBT = 0.2
SEED = 5

# -- text in a plain form ---------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("авекмнорстухіїјѕԁӏɡοαεικνρτυχѵһԛԝАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxiijsdlgoaeiknptuxvhqwABEKMHOPCTYXIJSABEZHIKMNOPTYX")
#: Digits and signs that stand for letters inside words.
_LEET = str.maketrans("013457@$!|", "oieastasil")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻\x00-\x08\x0e-\x1f\x7f]")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|\*\*|__|~~")
_CJK = "぀-ヿ㐀-鿿ｦ-ﾟ"
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![^\W_])")
_MIXED = re.compile(r"(?<![\w`/.@-])(?=[\w@$!|*]*[A-Za-z])(?=[\w@$!|*]*[0134578@$!|*])[A-Za-z0134578@$!|*]{3,}(?![\w/(])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_TICKS = re.compile(r"`[^`\n]{1,200}`")
_SPELLS = re.compile(r"(?:(?<![^\W_])[^\W\d_][ .\-_*·]){2}")
_CODE = re.compile(r"\b[\w.-]*[/\\][\w./\\-]+|\b\w+(?:_\w+)+(?:\(\))?|\b\w+\.(?:py|c|h|cc|cpp|hpp|cxx|go|el|js|md)\b(?::\d+)?|https?://\S+|--\w[\w-]*|\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\b[0-9a-f]{8,}\b")
_NUMBER = re.compile(r"\d+")
_PREFIX = re.compile(r"^\s*(?:\[[^\]\n]{0,40}\]\s*|<[\w.-]{1,30}>\s*|[-*+>#|]+\s+|\d+[.)]\s+)+")
_BREAK = re.compile(rf"(?<=[.!?;:])[\s\"')\]]+|\n+|(?<=[。！？])|(?<=[.!?])(?=[{_CJK}])")
_TOKEN = re.compile(rf"[{_CJK}]+|[^\W_]+|[!?]")


def plain(text: str) -> str:
    """The text without markup, invisible characters and the usual disguises of letters; case kept."""
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "&" in text:
        text = _INVISIBLE.sub("", html.unescape(text))
    if "<" in text or "*" in text or "_" in text or "~" in text:
        text = _TAGS.sub("", text)
    if not text.isascii():
        if re.search("[Ͱ-ԯɡ]", text):
            text = text.translate(_LOOKALIKE)
        text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not ("̀" <= c <= "ͯ")))
    return text


@lru_cache(maxsize=200_000)
def _word(w: str) -> str:
    """A word between blanks in lower case: code as codeid, numbered or padded letters as letters."""
    w = _CODE.sub(" codeid ", w)
    w = _MIXED.sub(lambda m: m.group().rstrip("!|").translate(_LEET), w)
    return _LONG.sub(r"\1", w).lower()


def unmask(passage: str) -> str:
    """A passage in lower case, with code as one word and spelled out, padded or numbered letters as letters."""
    if "`" in passage:
        passage = _TICKS.sub(" codeid ", passage)
    if _SPELLS.search(passage):
        passage = _SPELLED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), passage)
    return " ".join(map(_word, passage.split()))


def parts(text: str) -> list[str]:
    """The sentences and lines of a text as written, without their list marks."""
    out = []
    for part in _BREAK.split(plain(text)):
        part = _PREFIX.sub("", part).strip() if part else ""
        if part:
            out.append(part)
    return out


def passages(text: str) -> list[str]:
    """The sentences and lines of a text, unmasked."""
    return [unmask(p) for p in parts(text)]


# -- terms ------------------------------------------------------------------------------------------------------------


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS


def _terms_of(w: str) -> list[int]:
    """The buckets of a token: itself and runs of characters in it, so that forms of one word share terms."""
    terms = ["w:" + w]
    if re.match(f"[{_CJK}]", w):
        terms += [f"c{k}:" + w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    elif len(w) >= GRAM:
        shown = f"<{w}>"
        terms += ["g:" + shown[i : i + GRAM] for i in range(len(shown) - GRAM + 1)]
    return list(map(_bucket, dict.fromkeys(terms)))


class Vocabulary:
    """The tokens that a process has met, by number, with their hash and the buckets of their terms; begun anew when it grows large."""

    def __init__(self):
        self.words: dict[str, tuple[int, ...]] = {}
        self.numbers: dict[str, int] = {}
        self.own: list[int] = []
        self.terms: list[list[int]] = []

    def of(self, word: str) -> tuple[int, ...]:
        """The numbers of the tokens in an unmasked word."""
        got = self.words.get(word)
        if got is None:
            got = self.words[word] = tuple(self._number(_NUMBER.sub("0", t)) for t in _TOKEN.findall(word))
        return got

    def _number(self, token: str) -> int:
        k = self.numbers.get(token)
        if k is None:
            k = self.numbers[token] = len(self.own)
            self.own.append(zlib.crc32(token.encode("utf-8", "replace")))
            self.terms.append(_terms_of(token))
        return k


class Windows:
    """Unmasked passages as runs of token numbers, cut into overlapping windows of WORDS tokens.

    Window k belongs to passage owner[k] and holds the tokens first[k] .. first[k] + length[k] - 1 of flat. pair[i] is the bucket of tokens i and i + 1.
    """

    def __init__(self, found: list[str], vocabulary: Vocabulary):
        tokens = [[t for w in p.split() for t in vocabulary.of(w)] for p in found]
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(n.sum()))
        step = WORDS // 2
        k = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
        self.owner = np.repeat(np.arange(len(n)), k)
        number = np.arange(len(self.owner)) - np.repeat(np.cumsum(k) - k, k)
        self.first = np.repeat(np.cumsum(n) - n, k) + number * step
        self.length = np.minimum(WORDS, n[self.owner] - number * step)
        own = np.array(vocabulary.own, np.uint64)[self.flat] if len(self.flat) else np.zeros(0, np.uint64)
        mixed = own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pair = (mixed >> np.uint64(17)) % np.uint64(BUCKETS)
        self.vocabulary = vocabulary

    def terms(self) -> Terms:
        """All terms of each window: those of its tokens, then its pairs of neighbours."""
        size = np.fromiter(map(len, self.vocabulary.terms), np.int64, len(self.vocabulary.terms))
        every = np.fromiter((b for t in self.vocabulary.terms for b in t), np.int64, int(size.sum()))
        which, where = _ranges(self.first, self.length)
        token = self.flat[where]
        inner, place = _ranges((np.cumsum(size) - size)[token], size[token])
        pairs, at = _ranges(self.first, self.length - 1)
        window = np.concatenate([which[inner], pairs])
        ids = np.concatenate([every[place], self.pair[at].astype(np.int64)])[np.argsort(window, kind="stable")]
        return Terms(ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(window, minlength=len(self.owner)))]), self.owner)


class Terms(NamedTuple):
    """The buckets of window k are ids[at[k] : at[k + 1]]; it belongs to passage owner[k]. No window is empty."""

    ids: np.ndarray
    at: np.ndarray
    owner: np.ndarray

    def take(self, k: np.ndarray) -> Terms:
        n = self.at[k + 1] - self.at[k]
        at = np.concatenate([[0], np.cumsum(n)])
        return Terms(self.ids[np.arange(at[-1]) + np.repeat(self.at[k] - at[:-1], n)], at, self.owner[k])


def windows(passage: str) -> list[list[int]]:
    """The terms of each window of one unmasked passage."""
    x = Windows([passage], Vocabulary()).terms()
    return [x.ids[a:b].tolist() for a, b in zip(x.at, x.at[1:])]


def _ranges(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the positions first[k] .. first[k] + length[k] - 1: (k, position) of all."""
    k = np.repeat(np.arange(len(first)), length)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(length) - length, length) + first[k]


# -- the machine ------------------------------------------------------------------------------------------------------


class FactorizationMachine:
    """Bias, a weight and FACTORS numbers per bucket; fitted by AdaGrad on the logistic loss. Every term of a window has the value 1/sqrt(number of terms)."""

    def __init__(self, seed: int = SEED, b: float = 0.0):
        rng = np.random.default_rng(seed)
        self.b = b
        self.w = np.zeros(BUCKETS, np.float32)
        self.v = rng.normal(0, 0.02, (BUCKETS, FACTORS)).astype(np.float32)

    @staticmethod
    def pad(rows: list[list[int]]) -> Terms:
        """Windows given as lists of buckets."""
        return Terms(np.array([i for r in rows for i in r], np.int32), np.cumsum([0, *map(len, rows)]), np.arange(len(rows)))

    def _parts(self, x: Terms) -> tuple[np.ndarray, ...]:
        """Scores before the logistic function, the squared value of a term, the factors of all terms and their sums per window."""
        square = (1 / np.diff(x.at)).astype(np.float32)
        e = self.v[x.ids]
        total = np.add.reduceat(e, x.at[:-1])
        pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((e**2).sum(1), x.at[:-1]))
        return self.b + np.add.reduceat(self.w[x.ids], x.at[:-1]) * np.sqrt(square) + pairs * square, square, e, total

    def margin(self, x: Terms) -> np.ndarray:
        return self._parts(x)[0] if len(x.owner) else np.zeros(0)

    def predict(self, x: Terms) -> np.ndarray:
        # in parts, as margin() holds FACTORS numbers for every term
        k = np.arange(len(x.owner))
        found = [self.margin(x.take(k[at : at + 8192])) for at in range(0, len(k), 8192)]
        return _logistic(np.concatenate(found) if found else np.zeros(0))

    def fit(self, x: Terms, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.15, decay: float = 2e-5) -> None:
        rng = np.random.default_rng(SEED)
        gw, gv, gb = np.full(BUCKETS, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(x.owner))
            for at in range(0, len(order), 512):
                i = order[at : at + 512]
                xi = x.take(i)
                m, square, e, total = self._parts(xi)
                g = ((_logistic(m) - y[i]) * weight[i]).astype(np.float32)
                row = np.repeat(np.arange(len(i)), np.diff(xi.at))
                by = np.argsort(xi.ids, kind="stable")
                ids, first = np.unique(xi.ids[by], return_index=True)
                dw = np.add.reduceat((g * np.sqrt(square))[row[by]], first) + decay * self.w[ids]
                dv = np.add.reduceat(((total[row] - e) * (g * square)[row][:, None])[by], first) + decay * self.v[ids]
                gw[ids] += dw**2
                gv[ids] += dv**2
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
                gb += float(g.sum()) ** 2
                self.b -= rate * float(g.sum()) / np.sqrt(gb)


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


class Scorer:
    """A fitted machine over passages: what a token's terms add up to is computed once, so that a window costs two sums."""

    def __init__(self, model: FactorizationMachine):
        self.model = model
        self.vocabulary = Vocabulary()
        self.sums = np.zeros((0, FACTORS + 3))
        v = model.v.astype(np.float64)
        self.of_bucket = np.column_stack([np.ones(BUCKETS), model.w, (v**2).sum(1), v])

    def __call__(self, found: list[str]) -> np.ndarray:
        """The probability of each unmasked passage's worst window; 0 for passages without tokens."""
        if len(self.vocabulary.own) > 300_000:
            self.vocabulary, self.sums = Vocabulary(), self.sums[:0]
        x = Windows(found, self.vocabulary)
        if new := self.vocabulary.terms[len(self.sums) :]:
            size = np.fromiter(map(len, new), np.int64, len(new))
            terms = np.fromiter((b for t in new for b in t), np.int64, int(size.sum()))
            self.sums = np.concatenate([self.sums, np.add.reduceat(self.of_bucket[terms], np.cumsum(size) - size)])
        best = np.zeros(len(found))
        if len(x.owner):
            total = self._between(self.sums[x.flat], x.first, x.length) + self._between(self.of_bucket[x.pair], x.first, x.length - 1)
            n, w, square, v = total[:, 0], total[:, 1], total[:, 2], total[:, 3:]
            np.maximum.at(best, x.owner, _logistic(self.model.b + w / np.sqrt(n) + 0.5 * ((v**2).sum(1) - square) / n))
        return best

    @staticmethod
    def _between(rows: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0)])
        return upto[first + length] - upto[first]


def fit(x: Terms, n: int, document: np.ndarray, offensive: np.ndarray, seed_y: np.ndarray, assumed: np.ndarray | None = None, rounds: int = ROUNDS) -> FactorizationMachine:
    """A machine from ``n`` windows, the document of each and each document's verdict (0 .. 1), followed by windows of known kind.

    ``assumed`` marks documents that nobody reviewed: most are clean, so they count as such, with little weight and not where they look abusive.

    Which passage explains a rejected document is judged by a machine fitted on the other half of the documents, so that a wrong
    verdict can't confirm itself.
    """
    m = len(seed_y)
    y = np.concatenate([np.zeros(n), seed_y]).astype(np.float32)
    weight = np.concatenate([np.ones(n), np.full(m, 2.0)]).astype(np.float32)
    all_rows, seed_rows = np.arange(n), np.arange(n, n + m)
    model = FactorizationMachine()
    model.fit(x.take(seed_rows), y[n:], weight[n:], 25)
    if not n:
        return model
    of_bad, half = (offensive > 0.5)[document], document % 2
    trust = np.ones(n) if assumed is None else np.where(assumed[document], ASSUMED_WEIGHT, 1.0)
    p = model.predict(x.take(all_rows))
    # at first all passages of a rejected document share its verdict, those more that the seeds suspect
    y[:n] = np.where(of_bad, 0.3 + 0.7 * p, 0.0)
    weight[:n] = trust * np.where(p > np.where(trust == 1, 0.5, DOUBT), np.where(of_bad, 1.0, 0.5 * (trust == 1)), 1.0)
    for _ in range(rounds):
        for k in (0, 1):
            part = np.concatenate([np.flatnonzero(half != k), seed_rows])
            model = FactorizationMachine()
            model.fit(x.take(part), y[part], weight[part], EPOCHS)
            p[half == k] = model.predict(x.take(np.flatnonzero(half == k)))
        best = np.zeros(len(offensive))
        np.maximum.at(best, document, p)
        found = best[document] > SUSPECT
        reason = of_bad & found & ((p >= best[document] - 1e-6) | (p > 0.5))
        y[:n] = reason
        weight[:n] = trust * np.where(reason, 3.0, np.where(of_bad, np.where(found, 1.0, 0.3), np.where(p > DOUBT, 0.2 * (trust == 1), 1.0)))
        weight[n:] = 1.0
    model = FactorizationMachine(b=PRIOR)
    model.fit(x, y, weight, LAST_EPOCHS)
    return model


# -- tables -----------------------------------------------------------------------------------------------------------


def _passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, verdicts, guesses, texts = (batch.column(i).to_pylist() for i in range(4))
        rows = [(i, y, a, p) for i, y, a, t in zip(ids, verdicts, guesses, texts) for p in dict.fromkeys(passages(t))]
        columns = zip(*rows) if rows else [()] * 4
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.bool_(), pa.string()))], names=["doc_id", "verdict", "assumed", "passage"])


def learn(documents: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """A machine fitted on a bounded sample of the reviewed documents and a smaller one of the others, taken as clean with little weight.

    Of a document with several verdicts their mean counts; a tie says nothing. Labels other than clean and offensive are left out.
    """
    from factloom.llm.seeds import SEEDS

    kind = F.lower(F.trim("label"))
    verdicts = labels.where(kind.isin("clean", "offensive")).groupBy("doc_id").agg(F.avg((kind == "offensive").cast("double")).alias("verdict")).where(F.col("verdict") != 0.5)
    sample = verdicts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_DOCUMENTS).withColumn("assumed", F.lit(False))
    others = documents.where(F.col("text").isNotNull()).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    others = others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ASSUMED_DOCUMENTS).select("doc_id", F.lit(0.0).alias("verdict"), F.lit(True).alias("assumed"))
    sample = sample.unionByName(others)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(sample, "doc_id")
    found: pd.DataFrame = (
        texts.select(F.col("doc_id").cast("long").alias("doc_id"), "verdict", "assumed", "text")
        .mapInArrow(_passages_of, "doc_id long, verdict double, assumed boolean, passage string")
        .orderBy(F.xxhash64("doc_id", "passage"), "doc_id", "passage")
        .limit(LABELLED_PASSAGES)
        .toPandas()
    )
    codes, docs = pd.factorize(found["doc_id"])
    verdict, assumed = np.zeros(len(docs)), np.zeros(len(docs), bool)
    assumed[codes] = found["assumed"].to_numpy(bool) if len(found) else []
    verdict[codes] = found["verdict"].to_numpy(float) if len(found) else []
    seeds = [(p, y) for text, y in SEEDS for p in passages(text)]
    x = Windows([*found["passage"], *(p for p, _ in seeds)], Vocabulary()).terms()
    n = int((x.owner < len(found)).sum())
    return fit(x, n, codes[x.owner[:n]], verdict, np.array([y for _, y in seeds], float)[x.owner[n:] - len(found)], assumed)


def _scored(batches: Iterator[pa.RecordBatch], packed) -> Iterator[pa.RecordBatch]:
    model = FactorizationMachine.__new__(FactorizationMachine)
    model.b, model.w, model.v = packed.value
    score, known = Scorer(model), {}
    for batch in batches:
        ids, sources, texts = (batch.column(i).to_pylist() for i in range(3))
        split = [parts(t) if t else [] for t in texts]
        if len(known) > 200_000:
            known.clear()
        new = list({p: None for ps in split for p in ps if p not in known})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update(zip(part, score([unmask(p) for p in part]).tolist()))
        scores = [max((known[p] for p in ps), default=0.0) for ps in split]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every row: the probability that its worst passage is abusive, hateful or sexual.

    Null, empty and blank texts score 0. Whole texts are scored, in all languages alike; lang is not looked at. The model that is
    broadcast has a fixed size (BUCKETS x (FACTORS + 1) numbers, 2.4 MB).
    """
    model = learn(documents, labels)
    packed = documents.sparkSession.sparkContext.broadcast((model.b, model.w, model.v))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.mapInArrow(lambda b: _scored(b, packed), "doc_id long, source string, score double")


def offensive(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id): documents with a passage above THRESHOLD, each once."""
    return scores(documents, labels).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_documents, n_offensive, share, mean_score) per source; a null source is one of its own."""
    return (
        scores(documents, labels)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum((F.col("score") >= THRESHOLD).cast("long")).alias("n_offensive"), F.avg("score").alias("mean_score"))
        .withColumn("share", F.col("n_offensive") / F.col("n_documents"))
    )
