"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Method: a pair occurrence index. The distinct words of a batch lie end to end as one linked list of
symbols; every mergeable pair of neighbours is mapped to all its positions in the batch. Ranks that have
positions are applied in ascending order, each to all its positions at once, and only the lists of
the neighbouring pairs are updated. A word is merged once per task, however often it occurs.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The folder of the public vocabularies; a parameter, as the files are not part of this package.
TOKENIZERS = os.environ.get("FACTLOOM_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the published pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids one task remembers; beyond it the memory is emptied.
REMEMBERED = 300_000
#: Characters of text merged together; only the working set, not the result, depends on it.
BATCH_CHARS = 4_000_000
#: A word beyond this many bytes is not remembered.
LONG_WORD = 200


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class PairIndexEncoder:
    """Byte-level BPE of many words at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.merged: dict[tuple[int, int], int | None] = {}
        self.known: dict[str, list[int]] = {}

    def rank(self, a: int, b: int) -> int | None:
        """The id that the neighbours a and b merge to, if any; it is also the rank of the merge."""
        key = (a, b)
        try:
            return self.merged[key]
        except KeyError:
            if len(self.merged) > 1_000_000:
                self.merged.clear()
            r = self.merged[key] = self.ranks.get(self.token[a] + self.token[b])
            return r

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        sym: list[int] = []
        nxt: list[int] = []
        starts: list[int] = []
        byte = self.byte
        direct: dict[int, int] = {}
        for k, w in enumerate(words):
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                direct[k] = whole
                starts.append(-1)
                continue
            at = len(sym)
            starts.append(at)
            sym.extend([byte[c] for c in raw])
            nxt.extend(range(at + 1, at + len(raw)))
            nxt.append(-1)
        n = len(sym)
        prv = [-1] * n
        for i, j in enumerate(nxt):
            if j >= 0:
                prv[j] = i
        rank, occurs = self.rank, {}
        for i, j in enumerate(nxt):
            if j >= 0 and (r := rank(sym[i], sym[j])) is not None:
                if r in occurs:
                    occurs[r].append(i)
                else:
                    occurs[r] = [i]
        active, token = list(occurs), self.token
        heapq.heapify(active)
        late: set[int] = set()
        while active:
            r = heapq.heappop(active)
            places = occurs.pop(r)
            places.sort()
            want = token[r]
            for i in places:
                j = nxt[i]
                # a pair that an overlapping merge has changed no longer spells the token
                if j < 0 or sym[i] < 0 or token[sym[i]] + token[sym[j]] != want:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i] = r, -1, k
                if k >= 0:
                    prv[k] = i
                    if (q := rank(r, sym[k])) is not None:
                        if q <= r:
                            late.add(i)
                        if q in occurs:
                            occurs[q].append(i)
                        else:
                            occurs[q] = [i]
                            heapq.heappush(active, q)
                h = prv[i]
                if h >= 0 and (q := rank(sym[h], r)) is not None:
                    if q <= r:
                        late.add(i)
                    if q in occurs:
                        occurs[q].append(h)
                    else:
                        occurs[q] = [h]
                        heapq.heappush(active, q)
        out: list[list[int]] = []
        for k, at in enumerate(starts):
            if at < 0:
                out.append([direct[k]])
                continue
            ids, i, redo = [], at, False
            while i >= 0:
                ids.append(sym[i])
                redo = redo or i in late
                i = nxt[i]
            if late and (redo or any(at <= x < at + len(words[k].encode("utf-8", "surrogatepass")) for x in late)):
                ids = self.one_word(words[k])
            out.append(ids)
        return out

    def one_word(self, word: str) -> list[int]:
        """A word by itself, least rank first, leftmost first. For vocabularies whose merges can yield a lower rank."""
        ids = [self.byte[c] for c in word.encode("utf-8", "surrogatepass")]
        while len(ids) > 1:
            best = min(((r, i) for i in range(len(ids) - 1) if (r := self.rank(ids[i], ids[i + 1])) is not None), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        split = [self.find(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w: None for ws in split for w in ws if w not in known})
        once: dict[str, list[int]] = {}
        for w, ids in zip(new, self.merge_words(new)):
            (known if len(w) <= LONG_WORD else once)[w] = ids
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w] if w in known else once[w]
            out.append(ids)
        return out


def vocabulary(spark: SparkSession, name: str, folder: str = TOKENIZERS):
    """A rank file as a broadcast of its bytes: a fixed file of under 1 MB, so that executors need not have it."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(batches: Iterator[pa.RecordBatch], ranks, count_only: bool) -> Iterator[pa.RecordBatch]:
    encoder = PairIndexEncoder(read_ranks(ranks.value))

    def done(ids, texts):
        lists = encoder.encode(texts)
        if count_only:
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(x) for x in lists], pa.int64())], names=["doc_id", "n_tokens"])
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 0
            if size >= BATCH_CHARS:
                yield done(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield done(ids, texts)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of each document's text, without special tokens.

    A null or empty text has an empty list. Every row is encoded, repeated rows as often as they
    occur; strings that look like special tokens are ordinary text. No shuffle: each partition is encoded where it is
    read.
    """
    ranks = vocabulary(documents.sparkSession, name, folder)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _encoded(b, ranks, False), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of every row; 0 for null and empty texts."""
    ranks = vocabulary(documents.sparkSession, name, folder)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _encoded(b, ranks, True), "doc_id long, n_tokens long")
