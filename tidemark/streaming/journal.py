"""The event journal on Structured Streaming: idempotent append, expiry, late corrections, retries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import delivery, late
from tidemark.runtime import Scratch, exists


#: Folders by hash of the identifier in which ``append_once`` keeps its rows; a batch reads those it touches.
BUCKETS = 32


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """What is stored at a path; empty only where nothing was ever written, any other failure is raised."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_once(spark: SparkSession, path: str, *, key: str, arrived: str, tie: str):
    """A sink for ``foreachBatch``: one row of each identifier ever, whatever batch it comes in.

    The stored identifiers are anti-joined, so the horizon is unbounded; they are kept by hash, and a batch
    reads the identifiers of its own buckets only.  A batch that is tried again after a failure replaces its own
    rows, so it is stored once.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        named = batch.withColumn("epoch", F.lit(epoch).cast("bigint")).withColumn("bucket", F.coalesce(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"), F.lit(-1)))
        seen = [r[0] for r in named.select("bucket").distinct().collect()]  # at most BUCKETS + 1 numbers
        stored = _table(spark, f"{path}/rows", named.schema).filter(F.col("bucket").isin(seen) & (F.col("epoch") != epoch))
        fresh = delivery.first_copies(named, key=key, arrived=arrived, tie=tie, stored=stored)
        fresh.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").mode("overwrite").parquet(f"{path}/rows")

    return sink


def journal_stream(source: DataFrame, path: str, *, key: str, arrived: str, tie: str) -> StreamingQuery:
    """Starts an idempotent append of everything available; the caller awaits it."""
    spark = source.sparkSession
    return source.writeStream.foreachBatch(append_once(spark, path, key=key, arrived=arrived, tie=tie)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, time: str, key: str, width: str = "1 day", lateness: str = "72 hours") -> DataFrame:
    """Counts by event-time window and key with a watermark; state older than ``lateness`` is dropped by Spark."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


_STATE = "key string, slot bigint, before bigint, amount bigint, on_time bigint, epoch bigint, period_start bigint"


def _newest(state: DataFrame, before: int | None = None) -> DataFrame:
    """The newest version of every slot; of those before an epoch."""
    s = state if before is None else state.filter(F.col("epoch") < before)
    return s.groupBy("key", "period_start", "slot").agg(F.max_by(F.struct("before", "amount", "on_time"), "epoch").alias("r")).select("key", "period_start", "slot", "r.*")


def late_stream(spark: SparkSession, path: str, *, period_us: int, slot_us: int, close_after_us: int = 0, cutoff_us: int | None = None):
    """A sink for ``foreachBatch`` that keeps checkpoints of running totals and replays what late rows touch.

    Batches carry key, occurred, arrived (microseconds); rows that arrive more than ``cutoff_us`` after they
    occurred are left out, and those that arrive before their period closes also count in the total at close.
    Rows with a null are left out.

    Only the slots that change are written, as new versions in the folder of their period; a batch reads the
    folders of the periods it touches.  A batch tried again reads the versions before it and replaces its own.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        period, slot = F.floor(F.col("occurred") / period_us) * period_us, F.floor(F.col("occurred") / slot_us) * slot_us
        rows = batch.dropna(subset=["key", "occurred", "arrived"])
        if cutoff_us is not None:
            rows = rows.filter(F.col("arrived") - F.col("occurred") <= cutoff_us)
        in_time = F.count(F.when(F.col("arrived") < period + period_us + close_after_us, 1))
        new = rows.groupBy("key", period.alias("period_start"), slot.alias("slot")).agg(F.count(F.lit(1)).alias("amount"), in_time.alias("on_time"))
        scratch = Scratch(spark, "late")
        new, n = scratch.put(new, "new")
        if not n:
            return
        touched = new.select("key", "period_start").distinct()
        old = _newest(_table(spark, f"{path}/state", _STATE).join(touched, ["key", "period_start"], "left_semi"), epoch)
        old, _ = scratch.put(old, "old")
        replayed = late.replay(old.select("key", "period_start", "slot", "before"), old.select("key", "period_start", "slot", "amount"), new)
        on_time = old.select("key", "period_start", "slot", "on_time").unionByName(new.select("key", "period_start", "slot", "on_time")).groupBy("key", "period_start", "slot").agg(F.sum("on_time").alias("on_time"))
        out = replayed.join(on_time, ["key", "period_start", "slot"]).withColumn("epoch", F.lit(epoch).cast("bigint"))
        out.select("key", "slot", "before", "amount", "on_time", "epoch", "period_start").write.option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "period_start").mode("overwrite").parquet(f"{path}/state")
        scratch.close()

    return sink


def stream_totals(spark: SparkSession, path: str) -> DataFrame:
    """key, period_start, total_at_close, total of what ``late_stream`` wrote."""
    return _newest(_table(spark, f"{path}/state", _STATE)).groupBy("key", "period_start").agg(F.sum("on_time").alias("total_at_close"), F.sum("amount").alias("total"))


def outbox_states(attempts: DataFrame, *, max_tries: int = 3) -> DataFrame:
    """job, state, tries of a stream of attempts (job, ok): pending, done, or dead after ``max_tries`` failures."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        tries, done = state.get if state.exists else (0, False)
        for f in frames:
            done = done or bool(f["ok"].any())
            tries += int((~f["ok"].astype(bool)).sum())
        state.update((tries, done))
        yield pd.DataFrame({"job": [key[0]], "state": ["done" if done else "dead" if tries >= max_tries else "pending"], "tries": [tries]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return attempts.groupBy("job").applyInPandasWithState(step, "job string, state string, tries bigint", "tries bigint, done boolean", "update", GroupStateTimeout.NoTimeout)


def projection_status(progress: list[dict]) -> dict:
    """generation, lag and whether the last step failed, from the progress of a streaming query."""
    ok = [p for p in progress if p.get("numInputRows", 0) >= 0]
    return {"generation": len(ok), "rows": sum(p.get("numInputRows", 0) for p in ok), "last": json.loads(json.dumps(ok[-1], default=str)) if ok else None}
