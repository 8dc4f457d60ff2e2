"""Sharding: minimax contiguous partition of groups of equal texts.

Groups (equal texts) are atomic and ordered by their 64-bit hash.  The driver
binary-searches the smallest feasible shard capacity, checking greedily, over a
summary of that order: sums of sizes by hash range.  The summary has a fixed
number of ranges; only ranges in which a cut could fall are summed again more
finely, until every cut is between two known groups.  The cuts are hash values,
so a row finds its shard from its own hash: nothing is joined back.

A group larger than 1/64 of a fair share (fewer than 64 * shards exist) is
placed beforehand, largest first, on the emptiest shard; the greedy check
counts it as load that the shard starts with.  A group that is larger than a
fair share gets a shard of its own.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stage, unit_interval

SHARDS = 24
#: A group of more than a fair share over this is placed on its own.
LARGE_SHARE = 64
#: Ranges in one summary, and so rows sent to the driver at a time.
SUMMARY_RANGES = 1 << 13
ROW_OVERHEAD = 8
#: Rows of a shard are numbered in cells of about this many rows.
CELL_ROWS = 100_000
_LOW, _HIGH = -(1 << 63), 1 << 63


@dataclass
class _Range:
    """Groups with `first` <= hash <= `last`, of `size` in all; `one` if it is
    known that they are a single group."""

    first: int
    last: int
    size: int

    @property
    def one(self) -> bool:
        return self.first == self.last


def _summary(groups: DataFrame, spans: list[tuple[int, int]], ranges: int) -> list[_Range]:
    """Sums over equal hash ranges of each span [low, high)."""
    each = max(2, ranges // len(spans))
    cell = F.lit(None).cast("long")
    for k, (low, high) in enumerate(spans):
        width = -(-(high - low) // each)
        inside = (F.col("h") >= F.lit(low)) & (F.col("h") <= F.lit(high - 1))
        part = F.expr(f"(cast(h as decimal(20,0)) - cast('{low}' as decimal(20,0))) div cast('{width}' as decimal(20,0))")
        cell = F.when(inside, F.lit(k * each) + part).otherwise(cell)
    rows = (
        groups.withColumn("cell", cell)
        .where("cell is not null")
        .groupBy("cell")
        .agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("size"))
        .collect()
    )
    return sorted((_Range(r["first"], r["last"], r["size"]) for r in rows), key=lambda r: r.first)


def _fill(ranges: list[_Range], ends: list[int], load: list[int], capacity: int, hopeful: bool) -> list[tuple[int, int]]:
    """Greedy check: after each shard, how much is placed, and the index of the
    range at which it stopped.  Within a range that isn't resolved, nothing of
    it (or, if hopeful, any part of it) can be taken."""
    at, stops = 0, []
    for k in load:
        want = at + max(0, capacity - k)
        i = bisect.bisect_right(ends, want)
        whole = ends[i - 1] if i else 0
        at = max(at, want if hopeful and i < len(ranges) and not ranges[i].one else whole)
        stops.append((at, i))
    return stops


def _least(ranges: list[_Range], ends: list[int], load: list[int], hopeful: bool) -> int:
    total = ends[-1]
    low, high = 0, total + max(load)
    while low < high:
        mid = (low + high) // 2
        if _fill(ranges, ends, load, mid, hopeful)[-1][0] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, load: list[int], summary_ranges: int = SUMMARY_RANGES) -> list[int]:
    """For each shard but the last, the hash below which groups belong to it or
    an earlier one.  groups: h long, size long (a group may have several rows).
    load: what each shard holds already."""
    ranges = _summary(groups, [(_LOW, _HIGH)], summary_ranges)
    while True:
        if not ranges:
            return [_HIGH] * (len(load) - 1)
        ends, total = [], 0
        for r in ranges:
            total += r.size
            ends.append(total)
        best, worst = _least(ranges, ends, load, True), _least(ranges, ends, load, False)
        low, high = _fill(ranges, ends, load, best, False), _fill(ranges, ends, load, worst, True)
        open_ = {i for (_, a), (_, b) in zip(low, high) for i in range(a, min(b, len(ranges) - 1) + 1) if not ranges[i].one}
        if not open_:
            stops = _fill(ranges, ends, load, worst, False)
            return [ranges[i].first if i < len(ranges) else _HIGH for _, i in stops[:-1]]
        picked = sorted(open_)
        spans = [(ranges[i].first, ranges[i].last + 1) for i in picked]
        finer: list[_Range] = []
        for k in range(0, len(spans), 64):  # a bounded number of conditions in a plan
            finer += _summary(groups, spans[k : k + 64], summary_ranges)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in open_] + finer, key=lambda r: r.first)


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    A null text has no bytes (size 8, CRC 0) and forms a group with other null
    texts, apart from empty ones.  Rows that repeat are kept, with a slot each.
    An empty table gives an empty result.  Other columns fall away.
    """
    d = only(docs, doc_id="long", text="string")
    rows = stage(
        d.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.xxhash64("text").alias("h"),
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    large = (
        rows.groupBy("h").agg(F.sum("size").alias("size"))
        .where(F.col("size") > F.lit(max(1, total // (shards * LARGE_SHARE))))
        .collect()
    )  # fewer than shards * LARGE_SHARE rows, as their sum is at most the total
    load, own = [0] * shards, {}
    for r in sorted(large, key=lambda r: (-r["size"], r["h"])):
        k = min(range(shards), key=lambda i: (load[i], i))
        load[k] += r["size"]
        own[r["h"]] = k
    small = rows.where(~F.col("h").isin(list(own))) if own else rows
    cuts = minimax_cuts(small.select("h", "size"), load)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.lit(0) if c >= _HIGH else F.when(F.col("h") >= F.lit(c), 1).otherwise(0))
    for k in sorted(set(own.values())):
        shard = F.when(F.col("h").isin([h for h, s in own.items() if s == k]), F.lit(k)).otherwise(shard)
    cells = max(64, -(-n // (shards * CELL_ROWS)))
    # order inside a shard: by a hash of the row, which spreads large groups
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("order", F.xxhash64("doc_id", "h"))
    placed = placed.withColumn("cell", unit_interval(F.col("order"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "cell",
        F.expr("coalesce(sum(n) over (partition by shard order by cell rows between unbounded preceding and 1 preceding), 0)").alias("before"),
    )
    inside = F.expr("row_number() over (partition by shard, cell order by order, doc_id, text_crc32)")
    return (
        placed.withColumn("inside", inside)
        .join(before, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))
    )
