"""A few keys holding most records: per-key results by exact offset chunking.

Rows of busy keys are range-partitioned by key and order and written with their place in the partition.  Keys are
counted per input partition, the counts are prefix-summed into offsets, and every row of a key gets its exact
number: the offset of its partition plus its place there.  Numbers are cut into chunks of equal size, chunks are
processed independently, and their states are merged in order of chunk.  No task holds more than ``chunk_rows`` of
a key's rows, or of a range of about as many, however busy a key is.

Only keys above ``chunk_rows`` need numbers; all rows of a rarer key are chunk 0.  At most ``rows / chunk_rows``
keys can be above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import Scratch

#: A key is busy from a 1,024th of all rows on, but within these bounds.
BUSY_SHARE, MIN_CHUNK, MAX_CHUNK = 1_024, 1_000, 1_000_000
#: Busy keys, and counts of keys a partition, up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 10_000
#: Chunks of a key that are merged in one step; more are merged in groups first.
MERGE_STATES = 4_096


def chunk_size(n_rows: int) -> int:
    return min(MAX_CHUNK, max(MIN_CHUNK, n_rows // BUSY_SHARE))


def offset_chunks(rows: DataFrame, key: list[str], order: list[str], *, chunk_rows: int | None = None) -> DataFrame:
    """``rows`` with ``_n`` (number within the key from 0 in ``order``, null for keys of one chunk) and ``_chunk``.

    Rows equal in all of ``order`` are numbered in either order.  Rows with a null in the key are left out.
    ``chunk_rows`` is a 1,024th of the rows where it is not given.

    Only rows of busy keys are moved for numbering; the others stay where they were read.
    """
    scratch = Scratch(rows.sparkSession, "chunks")
    p = rows.dropna(subset=key)
    if chunk_rows is None:
        chunk_rows = chunk_size(p.select(*key).count())
    heavy, n_heavy = scratch.put(p.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > chunk_rows), "heavy")
    n_busy = heavy.agg(F.sum("_c")).first()[0]
    if not n_heavy:
        return p.withColumn("_n", F.lit(None).cast("bigint")).withColumn("_chunk", F.lit(0).cast("bigint"))
    heavy = heavy.select(*key)
    few = F.broadcast(heavy) if n_heavy <= BROADCAST_KEYS else heavy
    quiet = p.join(few, key, "left_anti").withColumn("_n", F.lit(None).cast("bigint"))
    line = [F.col(c).asc_nulls_first() for c in order]
    # rows that are equal throughout are told apart, so that they too may be cut
    busy = p.join(few, key, "left_semi").withColumn("_tie", F.monotonically_increasing_id())
    # ranges are found over a digest of the key, as what is sampled for them goes to the driver
    digest = F.xxhash64(*key)
    spread = busy.repartitionByRange(-(-n_busy // chunk_rows), digest, *line, "_tie").sortWithinPartitions(digest, *key, *line, "_tie").drop("_tie")
    spread = spread.withColumn("_in", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    spread, _ = scratch.put(spread, "busy")
    inside, n_inside = scratch.put(spread.groupBy(*key, "_in").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first")), "inside")
    offsets = inside.withColumn("_offset", F.sum("_c").over(Window.partitionBy(*key).orderBy("_in")) - F.col("_c") - F.col("_first")).drop("_c", "_first")
    numbered = spread.join(F.broadcast(offsets) if n_inside <= BROADCAST_KEYS else offsets, [*key, "_in"]).withColumn("_n", F.col("_offset") + F.col("_at")).drop("_in", "_at", "_offset")
    return quiet.unionByName(numbered.select(*quiet.columns)).withColumn("_chunk", F.coalesce(F.floor(F.col("_n") / chunk_rows), F.lit(0)))


def degree_stats(ends: DataFrame, *, chunk_rows: int | None = None) -> DataFrame:
    """Per (side, node_id): n_edges, mean_confidence, min_confidence, max_confidence, n_chunks.

    ``ends``: side, node_id, edge_id, confidence.  Null confidences count as edges but not in the mean; a node
    whose confidences are all null has a null mean.  Rows with a null node_id are left out.  Repeated rows
    count as often as they stand.
    """
    e = ends.select("side", "node_id", F.xxhash64("edge_id").alias("edge"), "confidence")
    c = offset_chunks(e, ["side", "node_id"], ["edge", "confidence"], chunk_rows=chunk_rows)
    states = c.groupBy("side", "node_id", "_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count("confidence").alias("nc"), F.sum("confidence").alias("s"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi")
    )
    return states.groupBy("side", "node_id").agg(
        F.sum("n").alias("n_edges"),
        F.try_divide(F.sum("s"), F.sum("nc")).alias("mean_confidence"),
        F.min("lo").alias("min_confidence"),
        F.max("hi").alias("max_confidence"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


def _merge(states: Column) -> Column:
    """States of neighbouring chunks, in order, as one state: a run may go on over any number of borders."""
    same = lambda a, b: a["last"]["v"].eqNullSafe(b["first"]["v"])

    def step(a: Column, b: Column) -> Column:
        joined = F.when(same(a, b), a["last"]["len"] + b["first"]["len"]).otherwise(F.lit(0).cast("bigint"))
        one = a["one"] & b["one"] & same(a, b)
        first = F.when(a["one"] & same(a, b), F.struct(a["first"]["v"].alias("v"), joined.alias("len"))).otherwise(a["first"])
        last = F.when(b["one"] & same(a, b), F.struct(b["last"]["v"].alias("v"), joined.alias("len"))).otherwise(b["last"])
        return F.struct(
            a["chunk"].alias("chunk"), (a["n"] + b["n"]).alias("n"), one.alias("one"), first.alias("first"), last.alias("last"),
            F.greatest(a["best"], b["best"], joined).alias("best"), a["head"].alias("head"), b["tail"].alias("tail"),
        )

    return F.aggregate(F.slice(states, 2, F.size(states)), states[0], step)


def run_stats(rows: DataFrame, key: list[str], order: list[str], value: str, *, chunk_rows: int | None = None) -> DataFrame:
    """``key``, n_rows, longest_run, head, tail: how long ``value`` stays the same along ``order``, and both ends.

    ``head`` and ``tail`` are the first of ``order`` of the first and last row, as text.  Nulls come first in
    order; a null value is a value like others.  Rows that agree in ``order`` should agree in ``value``.
    Rows with a null in the key are left out; repeated rows count as often as they stand.

    Every chunk is reduced by itself to its first and last run and its longest one; states are then merged in
    order of chunk, in groups where a key has more than ``MERGE_STATES``.
    """
    r = rows.select(*key, *order, F.col(value).cast("string").alias("_value"))
    c = offset_chunks(r, key, [*order, "_value"], chunk_rows=chunk_rows)
    by = [*key, "_chunk"]
    line = Window.partitionBy(*by).orderBy("_n", *[F.col(o).asc_nulls_first() for o in order], F.col("_value").asc_nulls_first())
    place = c.withColumn("_place", F.row_number().over(line)).withColumn("_new", (F.col("_place") == 1) | ~F.lag("_value").over(line).eqNullSafe(F.col("_value")))
    numbered = place.withColumn("_run", F.sum(F.col("_new").cast("bigint")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*by, "_run").agg(F.count(F.lit(1)).alias("len"), F.first("_value").alias("v"), F.min(F.struct("_place", F.col(order[0]).cast("string").alias("o"))).alias("from"), F.max(F.struct("_place", F.col(order[0]).cast("string").alias("o"))).alias("to"))
    run = F.struct("v", "len")
    states = runs.groupBy(*by).agg(
        F.sum("len").alias("n"), (F.count(F.lit(1)) == 1).alias("one"), F.min_by(run, "_run").alias("first"), F.max_by(run, "_run").alias("last"), F.max("len").alias("best"), F.min_by("from.o", "_run").alias("head"), F.max_by("to.o", "_run").alias("tail")
    )
    whole = F.struct(F.col("_chunk").alias("chunk"), "n", "one", "first", "last", "best", "head", "tail").alias("s")
    for group in ([*key, F.floor(F.col("_chunk") / MERGE_STATES).alias("_group")], key):
        merged = states.groupBy(*group).agg(_merge(F.array_sort(F.collect_list(whole))).alias("s"))
        states = merged.select(*key, F.col("s.chunk").alias("_chunk"), *[F.col(f"s.{c}").alias(c) for c in ("n", "one", "first", "last", "best", "head", "tail")])
    return states.select(*key, F.col("n").alias("n_rows"), F.col("best").alias("longest_run"), "head", "tail")


def prefix_sums(rows: DataFrame, key: list[str], order: list[str], value: Column, bucket: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the earlier rows of the same key.

    Earlier is by (bucket, order); ``bucket`` must not decrease along the wished order.  Sums per bucket are
    prefix-summed, rows are summed within their bucket only, so a key is spread over as many tasks as it has
    buckets.
    """
    v = rows.withColumn("_v", value).withColumn("_b", bucket)
    sums = v.groupBy(*key, "_b").agg(F.sum("_v").alias("_t"))
    base = sums.withColumn("_base", F.sum("_t").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_t")).drop("_t")
    inner = F.sum("_v").over(Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    return v.withColumn("_inner", inner).join(base, [*key, "_b"]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_v", "_b", "_inner", "_base")


def _in_order(rows: DataFrame, key: list[str], order: list[Column], chunk_rows: int | None) -> tuple[DataFrame, list[str], Window]:
    """``rows`` with chunk columns, the columns of a chunk, and its window; a key with nulls is a key like others."""
    asked = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", F.struct(*key).alias("_key"), *[o.alias(n) for n, o in zip(asked, order, strict=True)])
    c = offset_chunks(keyed, ["_key"], asked, chunk_rows=chunk_rows)
    return c, asked, Window.partitionBy("_key", "_chunk").orderBy("_n", *[F.col(a).asc_nulls_first() for a in asked])


def numbered(rows: DataFrame, key: list[str], order: list[Column], out: str, *, chunk_rows: int | None = None) -> DataFrame:
    """``rows`` with ``out``, the number from 1 within the key along ``order`` (ascending, nulls first).

    Descending orders take negated columns.  Busy keys are numbered by chunks, so no task holds one whole.
    """
    c, asked, line = _in_order(rows, key, order, chunk_rows)
    return c.withColumn(out, F.coalesce(F.col("_n") + 1, F.row_number().over(line).cast("bigint"))).drop("_key", "_n", "_chunk", *asked)


def running_sum(rows: DataFrame, key: list[str], order: list[Column], value: Column, out: str, *, chunk_rows: int | None = None) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the rows of the key up to and with this one along ``order``.

    Chunks are summed by themselves; the sums of the chunks before are added.  Rows that tie throughout are
    summed one after the other in either order.
    """
    c, asked, line = _in_order(rows.withColumn("_v", value), key, order, chunk_rows)
    inner = c.withColumn("_s", F.sum("_v").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    sums = c.groupBy("_key", "_chunk").agg(F.sum("_v").alias("_t"))
    base = sums.withColumn("_base", F.sum("_t").over(Window.partitionBy("_key").orderBy("_chunk")) - F.col("_t")).filter("_chunk > 0").select("_key", "_chunk", "_base")
    joined = inner.join(base, ["_key", "_chunk"], "left")
    return joined.withColumn(out, F.col("_s") + F.coalesce("_base", F.lit(0))).drop("_key", "_n", "_chunk", "_v", "_s", "_base", *asked)


def following(rows: DataFrame, key: list[str], order: list[Column], value: str, out: str, *, chunk_rows: int | None = None) -> DataFrame:
    """``rows`` with ``out``, the ``value`` of the next row of the key along ``order``, null at the end.

    The last row of a chunk gets the first value of the next one.
    """
    c, asked, line = _in_order(rows, key, order, chunk_rows)
    at = F.struct("_n", *asked)
    heads = c.groupBy("_key", "_chunk").agg(F.min_by(F.struct(F.col(value).alias("v")), at).alias("_head")).filter("_chunk > 0").select("_key", (F.col("_chunk") - 1).alias("_chunk"), "_head")
    within = c.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(line))
    joined = within.join(heads, ["_key", "_chunk"], "left")
    return joined.withColumn(out, F.coalesce("_next", "_head")["v"]).drop("_key", "_n", "_chunk", "_next", "_head", *asked)
