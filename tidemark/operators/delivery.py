"""Messages delivered more than once: keep exactly one copy of each.

Copies are ranked by arrival with a deterministic tie-break and the first is kept.  Ranking runs in two steps:
within (identifier, salt), then among the firsts of each identifier's salts.  A single identifier that makes up
a third of all rows is thus ranked by ``salts`` tasks, and the second step sees at most ``salts`` rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import blank

SALTS = 64


def ranked_copies(messages: DataFrame, *, key: Column, arrived: Column, tie: Column, salts: int = SALTS) -> DataFrame:
    """(tie, keep) of every row with a non-blank identifier: ``keep`` is true on exactly one row of each.

    Rows with a null or blank identifier are not duplicates of anything and are not in the result.  A null
    arrival is later than any other; rows that agree in arrival and tie-break are interchangeable and one of
    them is kept.
    """
    m = messages.select(key.cast("string").alias("_key"), arrived.alias("_arrived"), tie.alias("_tie")).filter(~blank(F.col("_key")))
    order = [F.col("_arrived").asc_nulls_last(), F.col("_tie").asc_nulls_last()]
    m = m.withColumn("_salt", F.pmod(F.xxhash64("_tie", "_arrived"), F.lit(salts)).cast("int"))
    m = m.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_salt").orderBy(*order)))
    firsts = m.filter("_rank = 1").withColumn("_keep", F.row_number().over(Window.partitionBy("_key").orderBy(*order)) == 1)
    rest = m.filter("_rank > 1").withColumn("_keep", F.lit(False))
    return firsts.unionByName(rest).select(F.col("_tie").alias("tie"), F.col("_keep").alias("keep"))


def first_copies(messages: DataFrame, *, key: str, arrived: str, tie: str, stored: DataFrame | None = None) -> DataFrame:
    """The rows of a batch to store: one of each identifier, none that ``stored`` already holds.

    Whole rows, all columns.  Rows with a blank identifier cannot be recognised again and are all kept.
    ``stored`` needs the column ``key`` only.
    """
    named = messages.filter(~blank(F.col(key)))
    if stored is not None:
        named = named.join(stored.select(F.col(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*messages.columns)
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in messages.columns]), F.struct(F.col(arrived).isNull(), F.col(arrived), F.col(tie)))
    one = named.groupBy(F.col(key).alias("_by")).agg(best.alias("_row")).select("_row.*")
    return one.unionByName(messages.filter(blank(F.col(key))))
