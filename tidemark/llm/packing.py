"""Filling fixed-capacity containers: bulk-synchronous best fit over runs of equal size.

Items and gaps are kept in order of size as runs: so many items of one size, so many containers with one gap.
A round takes the largest size that is left, sweeps over the gaps for their successors (the smallest gap that
holds an item, then the next), and resolves conflicts by rank: the item of rank r takes the r-th place of the
sweep.  Gaps are updated, and the next round begins; what finds no gap opens new containers.  This is best fit
decreasing, carried out for all items of a size at once.

There are at most ``capacity`` sizes and as many gaps whatever the number of items, so the runs are swept in one
place, the driver, while ranking the items within their size and looking up their containers is distributed.
Above ``MAX_CAPACITY`` the runs would no longer be a small table, and ``pack`` refuses.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import prefix_sums
from tidemark.runtime import Scratch

CAPACITY = 2_048
MAX_CAPACITY = 1 << 20
_BUCKETS = 256


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (size, rank_from, bin_from, per_bin) in that order, and the number of containers opened.

    The item of that size and rank r, rank_from <= r < the next row's, goes to container
    ``bin_from + (r - rank_from) // per_bin``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first container, how many)
    order: list[int] = []  # the gaps there are, ascending
    opened, rows = 0, []

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            # the sweep goes on from the successor of the size; what a gap keeps lies below it
            at = bisect.bisect_left(order, size)
            if at == len(order):
                break
            gap = order.pop(at)
            per = gap // size
            for first, n in gaps.pop(gap):
                full = min(n, left // per)
                if full:
                    rows.append((size, rank, first, per))
                    rank, left = rank + full * per, left - full * per
                    free(gap - per * size, first, full)
                if full < n and left and left < per:
                    rows.append((size, rank, first + full, left))
                    free(gap - left * size, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                free(gap, first + full, n - full)
        if left:
            per = capacity // size
            full = left // per
            if full:
                rows.append((size, rank, opened, per))
                free(capacity - per * size, opened, full)
                rank, left, opened = rank + full * per, left - full * per, opened + full
            if left:
                rows.append((size, rank, opened, left))
                free(capacity - left * size, opened, 1)
                opened += 1
    return np.array(sorted(rows), np.int64).reshape(-1, 4), opened


def _look_up(plan: np.ndarray):
    size, rank_from, bin_from, per = plan.T if len(plan) else np.empty((4, 0), np.int64)
    order = np.lexsort((rank_from, size))
    size, rank_from, bin_from, per = size[order], rank_from[order], bin_from[order], per[order]
    first = np.searchsorted(size, np.arange(size.max(initial=0) + 2))

    def run(batches):
        for b in batches:
            s, r = b["_size"].to_numpy(), b["_rank"].to_numpy()
            # the last row of the size that begins at or before the rank, by bisection within the size's rows
            lo, hi = first[s].copy(), first[s + 1].copy()
            while (hi - lo > 1).any():
                mid = (lo + hi) // 2
                right = (hi - lo > 1) & (rank_from[mid] <= r)
                lo, hi = np.where(right, mid, lo), np.where((hi - lo > 1) & ~right, mid, hi)
            yield pd.DataFrame({"_id": b["_id"], "piece": b["piece"], "start": b["start"], "n_tokens": s, "bin_id": bin_from[lo] + (r - rank_from[lo]) // per[lo]})

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, id_: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``id_``, piece, start, n_tokens, bin_id: where every item, or every piece of one, goes.

    An item above the capacity is cut into full pieces, each a container of its own, and a rest that is packed
    like any other item; no other item is cut.  Pieces are numbered from 0, ``start`` is the offset of a piece.
    Items of size 0 or null need no room: piece 0, n_tokens 0, bin_id null.  Negative sizes count as 0.  Ids
    may be null or repeat; every row is packed.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}")
    spark = items.sparkSession
    scratch = Scratch(spark, "pack")
    sized = items.select(F.col(id_).alias("_id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_n"))
    id_type = dict(sized.dtypes)["_id"]
    whole, _ = scratch.put(sized, "items")
    pieces = F.floor(F.col("_n") / capacity)
    ordinary = whole.filter("_n > 0").withColumn("piece", F.when(F.col("_n") == capacity, F.lit(0)).otherwise(pieces).cast("int"))
    ordinary = ordinary.withColumn("_size", F.when(F.col("_n") == capacity, F.col("_n")).otherwise(F.col("_n") % capacity)).withColumn("start", F.col("piece") * F.lit(capacity).cast("bigint")).filter("_size > 0")
    counts = {r["_size"]: r["count"] for r in ordinary.groupBy("_size").count().collect()}  # at most ``capacity`` rows
    plan, opened = plan_runs(counts, capacity)
    bucket = F.pmod(F.xxhash64("_id", "_n"), F.lit(_BUCKETS)).cast("int")
    ranked = prefix_sums(ordinary, ["_size"], ["_id", "_n"], F.lit(1).cast("bigint"), bucket, "_rank")
    rest = ranked.select("_id", "piece", "start", "_size", "_rank").mapInPandas(_look_up(plan), f"_id {id_type}, piece int, start bigint, n_tokens bigint, bin_id bigint")
    cut = whole.filter(F.col("_n") > capacity).withColumn("_one", F.lit(0))
    cut = prefix_sums(cut, ["_one"], ["_id", "_n"], pieces.cast("bigint"), bucket, "_before")
    full = cut.select("_id", "_before", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("piece"))
    full = full.select("_id", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.lit(opened) + F.col("_before") + F.col("piece")).alias("bin_id"))
    none = whole.filter("_n = 0").select("_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("bigint").alias("bin_id"))
    return rest.unionByName(full).unionByName(none).withColumnRenamed("_id", id_)
