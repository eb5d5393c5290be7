"""Late and out-of-order events: per-period totals corrected as late records arrive, up to a cut-off.

The state of a key and period is kept as checkpoints: the running total at the start of every slot of the
period, in event-time order.  When the period closes, its total is published.  A record that arrives after that
but within the cut-off restores the checkpoint before its slot, the slots from there on are replayed in order
together with the late records, and the published total is replaced.  Only periods that a late record touches
are replayed, and of those only the suffix.

Records are folded into slots before anything is moved, so a busy key costs no more than a quiet one: at most
``period / slot`` rows a key and period are ever in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, HOUR_US


def first_delivery(records: DataFrame, key: Column, arrived: Column, tie: Column, keep: dict[str, Column]) -> DataFrame:
    """One row per key with the columns ``keep`` of the delivery that arrived first; combined before the shuffle."""
    first = F.min_by(F.struct(*[c.alias(n) for n, c in keep.items()]), F.struct(arrived.isNull(), arrived, tie))
    return records.groupBy(key.alias("_key")).agg(first.alias("_first")).select("_key", "_first.*")


def arrival_class(occurred: Column, arrived: Column, *, period_us: int, close_after_us: int, cutoff_us: int) -> Column:
    """'on_time' before the period closes, 'late' from then until the cut-off, 'dropped' beyond it."""
    closes = F.floor(occurred / period_us) * period_us + period_us + close_after_us
    return F.when(arrived - occurred > cutoff_us, "dropped").when(arrived < closes, "on_time").otherwise("late")


def corrected_totals(records: DataFrame, *, period_us: int = DAY_US, close_after_us: int = 6 * HOUR_US, cutoff_us: int = 72 * HOUR_US, slot_us: int = HOUR_US) -> DataFrame:
    """One row per key and period: key, period_start, total_at_close, total_final, n_late, replayed_from.

    ``records``: key string, occurred bigint, arrived bigint (microseconds) and, if present, amount; other
    columns are ignored.  The totals are of ``amount``, or of 1 for each record where there is none.
    ``replayed_from`` is the start of the slot from which a changed period was replayed, null where no record
    was late.  Records with a null key or time are left out, null amounts count as 0, periods of which all
    records were dropped give no row.  Records that bear a time ahead of their arrival are on time.
    """
    amount = F.coalesce(F.col("amount"), F.lit(0)) if "amount" in records.columns else F.lit(1).cast("bigint")
    r = records.select(F.col("key").alias("_key"), F.col("occurred").alias("_occurred"), F.col("arrived").alias("_arrived"), amount.alias("_amount")).dropna()
    r = r.withColumn("_class", arrival_class(F.col("_occurred"), F.col("_arrived"), period_us=period_us, close_after_us=close_after_us, cutoff_us=cutoff_us)).filter("_class <> 'dropped'")
    start = F.floor(F.col("_occurred") / period_us) * period_us
    slots = (
        r.groupBy("_key", start.alias("_start"), (F.floor(F.col("_occurred") / slot_us) * slot_us).alias("_slot"))
        .agg(
            F.sum(F.when(F.col("_class") == "on_time", F.col("_amount"))).alias("_on"),
            F.sum(F.when(F.col("_class") == "late", F.col("_amount"))).alias("_late"),
            F.count(F.when(F.col("_class") == "late", 1)).alias("_n_late"),
        )
        .fillna(0, ["_on", "_late"])
    )
    period = Window.partitionBy("_key", "_start")
    line = period.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # checkpoints: the running total before each slot, as it stood when the period closed
    state = slots.withColumn("_checkpoint", F.coalesce(F.sum("_on").over(line), F.lit(0))).withColumn("_from", F.min(F.when(F.col("_n_late") > 0, F.col("_slot"))).over(period))
    suffix = F.col("_slot") >= F.col("_from")
    restored = F.max(F.when(F.col("_slot") == F.col("_from"), F.col("_checkpoint")))
    replayed = F.sum(F.when(suffix, F.col("_on") + F.col("_late")))
    return state.groupBy("_key", "_start").agg(
        F.sum("_on").alias("total_at_close"),
        F.coalesce(restored + replayed, F.sum("_on")).alias("total_final"),
        F.sum("_n_late").alias("n_late"),
        F.max("_from").alias("replayed_from"),
    ).select(F.col("_key").alias("key"), F.col("_start").alias("period_start"), "total_at_close", "total_final", "n_late", "replayed_from")


def replay(checkpoints: DataFrame, log: DataFrame, late: DataFrame) -> DataFrame:
    """One step of the same for a stored state: the slots whose checkpoint changes, with the new value.

    ``checkpoints``: key, period_start, slot, before (total before the slot); ``log`` and ``late``: key,
    period_start, slot, amount (already folded).  Gives key, period_start, slot, before, amount of every slot
    from the earliest late one of its key and period on; the caller replaces those rows.
    """
    touched = late.groupBy("key", "period_start").agg(F.min("slot").alias("_from"))
    start = (
        checkpoints.join(touched, ["key", "period_start"])
        .filter(F.col("slot") <= F.col("_from"))
        .groupBy("key", "period_start")
        .agg(F.max_by(F.struct("slot", "before"), "slot").alias("_kept"))
    )
    both = log.select("key", "period_start", "slot", "amount").unionByName(late.select("key", "period_start", "slot", "amount"))
    suffix = (
        both.join(touched, ["key", "period_start"])
        .join(start, ["key", "period_start"], "left")
        # without a checkpoint at or before the first late slot the replay starts from nothing
        .filter(F.col("slot") >= F.coalesce(F.col("_kept.slot"), F.col("_from")))
        .groupBy("key", "period_start", "slot")
        .agg(F.sum("amount").alias("amount"), F.first(F.coalesce(F.col("_kept.before"), F.lit(0))).alias("_base"))
    )
    line = Window.partitionBy("key", "period_start").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return suffix.select("key", "period_start", "slot", (F.col("_base") + F.coalesce(F.sum("amount").over(line), F.lit(0))).alias("before"), "amount")
