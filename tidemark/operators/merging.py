"""Upserts by rule, deltas, three-way merges and multiset parity over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: how far a method is trusted, best first
METHOD_RANK = ("static", "explicit", "identifier", "path", "semantic", "inferred")
CONFIDENCE_FLOOR = 0.4


def method_rank(method: Column) -> Column:
    rank = F.lit(len(METHOD_RANK))
    for i, m in enumerate(METHOD_RANK):
        rank = F.when(method == m, i).otherwise(rank)
    return rank


def merit() -> Column:
    """What the better of two edges has less of: not extracted, confidence, rank of method."""
    return F.struct((~F.col("provenance").eqNullSafe("EXTRACTED")).alias("p"), (-F.coalesce("confidence", F.lit(-1.0))).alias("c"), method_rank(F.col("method")).alias("m"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, rel): extracted before inferred, then confidence, method and least id.

    rel is compared without outer blanks and letter case.  Of rows that tie in all but id the evidence is
    joined, a key's value coming from the least id that has it.  Folded by partial minima, so a triple derived
    often costs no more; evidence moves only where there is a tie.
    """
    triple = ["src", "dst", "rel"]
    e = edges.filter("src is not null and dst is not null and rel is not null").withColumn("rel", F.lower(F.trim("rel"))).withColumn("_m", merit())
    tied = e.groupBy(*triple, "_m").agg(F.min_by(F.struct("id", "method", "provenance", "confidence", "evidence"), "id").alias("w"), F.count(F.lit(1)).alias("_n"), F.count("evidence").alias("_e"))
    best = tied.groupBy(*triple).agg(F.min_by(F.struct("w", "_m", "_n", "_e"), "_m").alias("b"), F.sum("_n").alias("n_derived")).select(*triple, "b.*", "n_derived")
    shared = best.filter("_n > 1 and _e > 0").select(*triple, "_m")
    parts = e.join(shared, [*triple, "_m"], "left_semi").select(*triple, "id", F.explode("evidence").alias("k", "v"))
    joined = parts.groupBy(*triple, "k").agg(F.min_by("v", F.struct("id", "v")).alias("v")).groupBy(*triple).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("_joined"))
    return best.join(joined, triple, "left").select(*triple, "w.id", "w.method", "w.provenance", "w.confidence", F.coalesce("_joined", "w.evidence").alias("evidence"), "n_derived")


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delta(before: DataFrame, after: DataFrame, *, key: str = "id", digest: str = "hash") -> DataFrame:
    """key, change: 'added', 'removed' or 'changed' between two states, by the digest of each key's least row."""
    a = before.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("a"), F.lit(1).alias("ia"))
    b = after.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("b"), F.lit(1).alias("ib"))
    j = a.join(b, key, "full")
    change = F.when(F.col("ia").isNull(), "added").when(F.col("ib").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(key, change.alias("change")).filter("change is not null")


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, *, key: str = "id", digest: str = "hash", better: str | None = None) -> DataFrame:
    """key, digest, outcome of a three-way merge.

    One side's change wins over an unchanged other; a modification wins over a deletion; two different changes
    keep ours with outcome 'conflict'.  Of edges, for which ``better`` names a column with their ``merit``, two
    different changes go by the rule of ``upsert_edges``: the side with less of it, ours in a tie, with outcome
    'resolved'.  Deleted keys give no row.  Of rows that repeat a key the least digest counts.
    """

    def side(df: DataFrame, n: str) -> DataFrame:
        row = F.struct(F.col(digest).alias(n), F.col(better).alias("m" + n)) if better else F.struct(F.col(digest).alias(n))
        return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("r")).select(key, "r.*", F.lit(True).alias("h" + n))

    j = side(base, "b").join(side(ours, "o"), key, "full").join(side(theirs, "t"), key, "full")
    hb, ho, ht = (F.coalesce(F.col(c), F.lit(False)) for c in ("hb", "ho", "ht"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    clash = F.lit("resolved" if better else "conflict")
    outcome = (
        F.when(~hb & ho & ht, F.when(same("o", "t"), "added").otherwise(clash))
        .when(~hb, "added")
        .when(~ho & ~ht, "deleted")
        .when(~ho, F.when(same("b", "t"), "deleted").otherwise("kept-theirs"))
        .when(~ht, F.when(same("b", "o"), "deleted").otherwise("kept-ours"))
        .when(same("o", "t"), F.when(same("b", "o"), "same").otherwise("both"))
        .when(same("b", "o"), "theirs")
        .when(same("b", "t"), "ours")
        .otherwise(clash)
    )
    take_theirs = outcome.isin("theirs", "kept-theirs")
    if better:
        take_theirs = take_theirs | ((outcome == "resolved") & (F.col("mt") < F.col("mo")))
    value = F.when(take_theirs, F.col("t")).when(ho, F.col("o")).otherwise(F.col("t"))
    return j.select(key, value.alias(digest), outcome.alias("outcome")).filter("outcome <> 'deleted'")


def composite(base: DataFrame, extra: DataFrame, base_edges: DataFrame, extra_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of two graphs laid over each other: the base wins by id, extra edges must have both ends."""
    nodes = base.unionByName(extra.join(base.select("id").distinct(), "id", "left_anti"), allowMissingColumns=True)
    ids = nodes.select("id").distinct()
    fit = extra_edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    fit = fit.join(base_edges.select("id").distinct(), "id", "left_anti")
    return nodes, base_edges.unionByName(fit, allowMissingColumns=True)


def parity(left: DataFrame, right: DataFrame, signature: list[str]) -> DataFrame:
    """Signature columns and matched, only_left, only_right: how often each signature is matched as a multiset."""
    both = left.select(*signature, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*signature, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = both.groupBy(*signature).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return n.select(*signature, F.least("l", "r").alias("matched"), F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("only_left"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("only_right"))


def entry_merge(entries: DataFrame) -> DataFrame:
    """One row per assertion id: the union of its supporters, sorted, and its latest ``known_at``."""
    return entries.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("supported_by")))).alias("supported_by"), F.max("known_at").alias("known_at"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
