"""Filling containers of fixed capacity with documents.

Method: swap-based local search. Each shard is packed best-fit by falling size; then the emptiest
bins are worked on: documents are moved into gaps, exchanged one for one or two for one between underfull
bins whenever that raises the sum of the squared fills, until bins run empty and a round gains too little. What stays underfull in
all shards is pooled and packed again, until one shard holds all of it or a pass no longer helps. Shards are equal parts of the rows, so no task grows with the input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm.encode import TOKENIZERS, token_counts
from factloom.session import Scratch

#: Items that one task packs together.
SHARD_ITEMS = 20_000
#: A bin filled to this share is not worked on again.
FULL_SHARE = 0.98
#: Local search goes on while a round raises the sum of squared fills by more than this share.
LEAST_GAIN = 1e-4
#: Passes over the pooled underfull bins go on while each leaves less than this share of the rows before it underfull, or until one shard holds all.
LEAST_DROP = 0.9


class Bins:
    """Bins of one capacity: items are (size, number) pairs."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []
        self.free: list[int] = []
        self.order: list[tuple[int, int]] = []  # (free, bin), ascending

    def _set(self, b: int, free: int) -> None:
        self.order.pop(bisect_left(self.order, (self.free[b], b)))
        self.free[b] = free
        insort(self.order, (free, b))

    def place(self, item: tuple[int, int], other_than: int = -1) -> bool:
        """Into the open bin with the least sufficient gap."""
        i = bisect_left(self.order, (item[0], -1))
        while i < len(self.order):
            free, b = self.order[i]
            if b != other_than and self.items[b]:
                self.items[b].append(item)
                self._set(b, free - item[0])
                return True
            i += 1
        return False

    def add(self, item: tuple[int, int]) -> None:
        self.items.append([item])
        self.free.append(self.capacity - item[0])
        insort(self.order, (self.free[-1], len(self.items) - 1))

    def fill(self, items: list[tuple[int, int]]) -> None:
        for item in sorted(items, reverse=True):
            if not self.place(item):
                self.add(item)

    def improve(self, full: int) -> None:
        """Raise the sum of squared fills by moves, 1:1 and 2:1 exchanges between underfull bins, until a round gains too little."""
        squares = self._squares()
        while True:
            low = [b for free, b in reversed(self.order) if free > full and self.items[b]]
            if len(low) < 2 or not any([self._work(b, full) for b in low]):
                return
            before, squares = squares, self._squares()
            if squares - before <= LEAST_GAIN * before:
                return

    def _squares(self) -> int:
        return sum((self.capacity - free) ** 2 for free in self.free)

    def _work(self, b: int, full: int) -> bool:
        """Move what bin b holds into fuller bins, directly or by exchanges that close their gaps."""
        changed = False
        for item in sorted(self.items[b], reverse=True):
            if item not in self.items[b]:
                continue
            if self.place(item, b):
                self.items[b].remove(item)
                self._set(b, self.free[b] + item[0])
                changed = True
        if self.items[b]:
            changed = self._exchange(b, full) or changed
        return changed

    def _exchange(self, b: int, full: int) -> bool:
        changed = False
        lo = bisect_left(self.order, (full + 1, -1))
        others = [x for free, x in self.order[lo:] if x != b and self.items[x] and self.free[x] <= self.free[b]]
        for x in others:
            gap = self.free[x]
            best = None  # (gain, what leaves b, what leaves x)
            mine = sorted(self.items[b])
            sizes = [s for s, _ in mine]
            for theirs in self.items[x]:
                # one for one: a larger document of ours for theirs, closing as much of the gap as possible
                i = bisect_left(sizes, theirs[0] + gap + 1) - 1
                if i >= 0 and (gain := sizes[i] - theirs[0]) > 0 and (best is None or gain > best[0]):
                    best = (gain, [mine[i]], [theirs])
                # two of ours for one of theirs: two pointers from both ends
                p, q, most = 0, len(mine) - 1, theirs[0] + gap
                while p < q:
                    two = sizes[p] + sizes[q]
                    if two > most:
                        q -= 1
                        continue
                    if (gain := two - theirs[0]) > 0 and (best is None or gain > best[0]):
                        best = (gain, [mine[p], mine[q]], [theirs])
                    p += 1
            if best:
                gain, out, back = best
                for it in out:
                    self.items[b].remove(it)
                    self.items[x].append(it)
                for it in back:
                    self.items[x].remove(it)
                    self.items[b].append(it)
                self._set(x, gap - gain)
                self._set(b, self.free[b] + gain)
                changed = True
                if not self.items[b]:
                    break
        return changed


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``; no size exceeds the capacity."""
    bins = Bins(capacity)
    empty = [k for k, s in enumerate(sizes) if s <= 0]
    bins.fill([(s, k) for k, s in enumerate(sizes) if s > 0])
    bins.improve(int(capacity * (1 - FULL_SHARE)))
    out = [[k for _, k in b] for b in bins.items if b]
    if empty:  # documents without tokens take no room
        if not out:
            out.append([])
        out[0] += empty
    return out


_SCHEMA = "budget_id int, capacity_tokens long, doc_id long, piece int, n_tokens long, container_id string, fill long"


def _pack_shard(batches: Iterator[pd.DataFrame], stage: str) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not parts:
        return
    all_rows = pd.concat(parts, ignore_index=True)
    shard = TaskContext.get().partitionId()
    for (budget, capacity), rows in all_rows.groupby(["budget_id", "capacity_tokens"], sort=True):
        rows = rows.reset_index(drop=True)
        sizes = rows["n_tokens"].tolist()
        found = pack(sizes, int(capacity))
        where, fill = [""] * len(sizes), [0] * len(sizes)
        for k, b in enumerate(found):
            total = sum(sizes[i] for i in b)
            for i in b:
                where[i], fill[i] = f"{budget}-{stage}{shard}-{k}", total
        yield rows.assign(container_id=where, fill=fill)


def pack_documents(documents: DataFrame, budgets: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(budget_id, container_id, doc_id, piece, n_tokens) for every document and each budget.

    The tokens in the rows of one container never exceed the budget's capacity. A document larger than the capacity is
    split into pieces 0, 1, ... of which all but the last fill a container each; no other is split. Documents of 0
    tokens (null and empty texts) take a place without room. Each row of the table is an item, so repeated rows are packed
    as often as they occur. Budgets with a null or non-positive capacity get no containers. Exact repeats of a budget count
    once. The number of budgets is that of the table of capacities; each multiplies the rows by explosion of one array, not by a join.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    kinds = budgets.where((F.col("capacity_tokens") > 0) & F.col("budget_id").isNotNull()).select(F.col("budget_id").cast("int"), F.col("capacity_tokens").cast("long")).distinct()
    kinds = [(r[0], r[1]) for r in kinds.orderBy(*kinds.columns).collect()]
    counts = scratch.save(token_counts(documents, name, folder))
    if not kinds:
        return spark.createDataFrame([], "budget_id int, container_id string, doc_id long, piece int, n_tokens long")
    each = F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("long").alias("capacity_tokens")) for b, c in kinds])
    wide = counts.withColumn("k", F.explode(each)).select("doc_id", "n_tokens", "k.budget_id", "k.capacity_tokens")
    whole = F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("int")
    rest = F.col("n_tokens") - whole * F.col("capacity_tokens")
    full = (
        wide.where(F.col("n_tokens") >= F.col("capacity_tokens"))
        .select("*", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
        .select("budget_id", F.concat_ws("-", "budget_id", F.lit("d"), "doc_id", F.col("piece"), F.monotonically_increasing_id()).alias("container_id"), "doc_id", "piece", F.col("capacity_tokens").alias("n_tokens"))
    )
    loose = wide.where((F.col("n_tokens") == 0) | (rest > 0)).select("budget_id", "capacity_tokens", "doc_id", whole.alias("piece"), rest.alias("n_tokens"))
    n = counts.count()
    shards = max(1, -(-n // shard_items))
    low, done, before, k = scratch.save(loose.repartition(shards).mapInPandas(lambda b: _pack_shard(b, "a0-"), _SCHEMA)), [], None, 0
    under = F.col("fill") < F.col("capacity_tokens") * FULL_SHARE
    while True:
        m = low.where(under).count()
        done.append(low.where(~under))
        if not m or before is not None and (shards == 1 or m >= LEAST_DROP * before):
            done.append(low.where(under))
            break
        before, k, shards = m, k + 1, max(1, -(-m // (shard_items * len(kinds))))
        again = low.where(under).select("budget_id", "capacity_tokens", "doc_id", "piece", "n_tokens").repartition(shards)
        low = scratch.save(again.mapInPandas(lambda b, k=k: _pack_shard(b, f"a{k}-"), _SCHEMA))
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    return full.unionByName(packed.select(*full.columns))


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, n_containers, n_tokens, least, fill): containers used, the least number that could hold the tokens, and the share filled."""
    per = packed.groupBy("budget_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    caps = budgets.groupBy("budget_id").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    return per.join(caps, "budget_id").select(
        "budget_id", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill")
    )
