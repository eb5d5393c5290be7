"""Attributes as known at event time: a bi-temporal as-of join.

A version of an entity holds from ``valid_at`` and is on record from ``known_at``.  An event at time t may use a
version only if both are at or before t; of several the latest ``valid_at`` wins, then the latest ``known_at``,
then the smallest id.

Both limits are the same instant t, so a version becomes usable at ``greatest(valid_at, known_at)`` and stays so.
The answer at t is therefore the running best over versions in order of that instant, and finding it is one
binary search.  Events and versions are co-grouped by entity, many entities to a group, and the search runs
vectorised over the whole group.

An entity with more rows than ``chunk_rows`` is cut along its time line into chunks of about that size; each
chunk starts with the best version of the chunks before it, so the chunks are independent and their union is
exact.  Nothing is dropped or sampled, and no group grows with the busiest entity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import Scratch, shuffle_partitions

#: Rows of one entity that stay in one chunk.
CHUNK_ROWS = 50_000
#: Rows aimed at in one co-group.
GROUP_ROWS = 200_000
#: Grain at which the time line of a busy entity may be cut.
SLOT_US = 60_000_000

_MISSING = -(2**62)


def running_best(entity: np.ndarray, at: np.ndarray, valid: np.ndarray, known: np.ndarray, ids: np.ndarray):
    """Versions in order of (entity, at), and for each the position of the best one of its entity up to it."""
    n = len(entity)
    by_worth = np.lexsort((ids, -known, -valid))
    worth = np.empty(n, np.int64)
    worth[by_worth] = np.arange(n)  # 0 is the best
    order = np.lexsort((at, entity))
    # a later entity starts below all earlier ones, so one accumulate serves every entity
    shift = entity[order].astype(np.int64) * (n + 1)
    best = np.minimum.accumulate(worth[order] - shift) + shift
    return order, by_worth[best]


def lookup(entity: np.ndarray, at: np.ndarray, v_entity: np.ndarray, v_at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each event the last place in ``order`` whose version is of its entity and usable by then, or -1."""
    if not len(order):
        return np.full(len(entity), -1, np.int64)
    times = np.unique(v_at)
    span = len(times) + 1
    v_key = v_entity[order].astype(np.int64) * span + np.searchsorted(times, v_at[order], "right")
    e_key = entity.astype(np.int64) * span + np.searchsorted(times, at, "right")
    place = np.searchsorted(v_key, e_key, "right") - 1
    found = place >= 0
    found[found] = v_entity[order[place[found]]] == entity[found]
    return np.where(found, place, -1)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of both columns as numbers of one numbering."""
    whole = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in (*a.chunks, *b.chunks))])
    codes = whole.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(a)], codes[len(a) :]


def _search_group(events: pa.Table, versions: pa.Table) -> pa.Table:
    e, v = _codes(events["_part"], versions["_part"])
    v_at, valid, known = (versions[c].to_numpy() for c in ("_usable", "_valid", "_known"))
    ids = np.asarray(versions["_version"].to_pylist(), dtype=object)
    if not len(v):
        return pa.table({"_event": events["_event"].slice(0, 0), "_version": versions["_version"]})
    order, best = running_best(v, v_at, valid, known, ids)
    place = lookup(e, events["_at"].to_numpy(), v, v_at, order)
    hit = np.flatnonzero(place >= 0)
    return pa.table({"_event": events["_event"].take(pa.array(hit)), "_version": versions["_version"].take(pa.array(best[place[hit]]))})


def _chunks(e: DataFrame, v: DataFrame, chunk_rows: int, slot_us: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Events and versions with ``_part``, the entity or, of a busy entity, a chunk of its time line."""
    both = e.select("_entity").withColumn("n", F.lit(1)).unionByName(v.select("_entity").withColumn("n", F.lit(1)))
    hot, n_hot = scratch.put(both.groupBy("_entity").agg(F.sum("n").alias("n")).filter(F.col("n") > chunk_rows).select("_entity"), "hot")
    if not n_hot:
        return e.withColumn("_part", F.col("_entity")), v.withColumn("_part", F.col("_entity"))
    slot = lambda c: F.floor(F.col(c) / slot_us)
    counted = (
        e.select("_entity", slot("_at").alias("_slot"), F.lit(1).alias("ne"))
        .unionByName(v.select("_entity", slot("_usable").alias("_slot"), F.lit(0).alias("ne")))
        .join(hot, "_entity")
        .groupBy("_entity", "_slot")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("ne").alias("ne"))
    )
    line = Window.partitionBy("_entity").orderBy("_slot")
    mapped, _ = scratch.put(
        counted.withColumn("_chunk", F.floor((F.sum("n").over(line) - F.col("n")) / chunk_rows))
        # one slot may alone exceed a chunk: its events are spread, its versions repeated
        .withColumn("_spread", F.ceil(F.max("ne").over(Window.partitionBy("_entity", "_chunk")) / chunk_rows))
        .withColumn("_spread", F.greatest("_spread", F.lit(1)))
        .select("_entity", "_slot", "_chunk", "_spread"),
        "chunks",
    )
    part = lambda chunk, sub: F.concat_ws("\x01", F.col("_entity"), chunk.cast("string"), sub.cast("string"))
    plain = F.col("_chunk").isNull()
    e = (
        e.withColumn("_slot", slot("_at"))
        .join(mapped, ["_entity", "_slot"], "left")
        .withColumn("_part", F.when(plain, F.col("_entity")).otherwise(part(F.col("_chunk"), F.pmod(F.xxhash64("_event"), F.col("_spread")))))
        .drop("_slot", "_chunk", "_spread")
    )
    placed = v.withColumn("_slot", slot("_usable")).join(mapped, ["_entity", "_slot"], "left")
    worth = F.struct((-F.col("_valid")).alias("v"), (-F.col("_known")).alias("k"), F.col("_version").alias("id"))
    chunks = mapped.groupBy("_entity", "_chunk").agg(F.max("_spread").alias("_spread"))
    before = Window.partitionBy("_entity").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunks.join(placed.filter(~plain).groupBy("_entity", "_chunk").agg(F.min(worth).alias("own")), ["_entity", "_chunk"], "left")
        .withColumn("best", F.min("own").over(before))
        .filter("best is not null")
        .select("_entity", F.lit(_MISSING).cast("bigint").alias("_usable"), (-F.col("best.v")).alias("_valid"), (-F.col("best.k")).alias("_known"), F.col("best.id").alias("_version"), "_chunk", "_spread")
    )
    subs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_spread") - 1))
    inside = placed.filter(~plain).drop("_spread").join(chunks, ["_entity", "_chunk"]).drop("_slot")
    spread = inside.unionByName(carried).withColumn("_sub", subs).withColumn("_part", part(F.col("_chunk"), F.col("_sub"))).drop("_chunk", "_spread", "_sub")
    v = placed.filter(plain).drop("_slot", "_chunk", "_spread").withColumn("_part", F.col("_entity")).unionByName(spread)
    return e, v


def bitemporal_asof(events: DataFrame, versions: DataFrame, *, chunk_rows: int = CHUNK_ROWS, group_rows: int = GROUP_ROWS, slot_us: int = SLOT_US) -> DataFrame:
    """(event_id, version_id): the version of its entity that was valid and on record at the time of each event.

    ``events``: event_id string, entity string, at bigint (microseconds).  ``versions``: version_id string,
    entity string, valid_at and known_at bigint.  Other columns are ignored, whatever their names.

    An event without a usable version gives no row.  Rows with a null id, entity or time never match and give
    no row.  Repeated versions count once.  An event_id that stands on several rows gives one row for each of
    them.  Empty tables give an empty result.
    """
    spark = events.sparkSession
    scratch = Scratch(spark, "asof")
    e = events.select(F.col("event_id").cast("string").alias("_event"), F.col("entity").cast("string").alias("_entity"), F.col("at").cast("bigint").alias("_at")).dropna()
    v = versions.select(F.col("version_id").cast("string").alias("_version"), F.col("entity").cast("string").alias("_entity"), F.col("valid_at").cast("bigint").alias("_valid"), F.col("known_at").cast("bigint").alias("_known")).dropna()
    # of the versions that become usable at one instant only the best can ever be chosen
    v = (
        v.groupBy("_entity", F.greatest("_valid", "_known").alias("_usable"))
        .agg(F.min(F.struct((-F.col("_valid")).alias("v"), (-F.col("_known")).alias("k"), F.col("_version").alias("id"))).alias("b"))
        .select("_entity", "_usable", (-F.col("b.v")).alias("_valid"), (-F.col("b.k")).alias("_known"), F.col("b.id").alias("_version"))
    )
    e, n_e = scratch.put(e, "events")
    v, n_v = scratch.put(v, "versions")
    e, v = _chunks(e, v, chunk_rows, slot_us, scratch)
    groups = max(2 * shuffle_partitions(spark), -(-(n_e + n_v) // group_rows))
    bucket = F.pmod(F.xxhash64("_part"), F.lit(groups)).cast("int").alias("_bucket")
    e = e.select("_part", "_at", "_event", bucket)
    v = v.select("_part", "_usable", "_valid", "_known", "_version", bucket)
    found = e.groupBy("_bucket").cogroup(v.groupBy("_bucket")).applyInArrow(_search_group, "_event string, _version string")
    return found.select(F.col("_event").alias("event_id"), F.col("_version").alias("version_id"))
