"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles.

Subtree sizes are computed upward: in each round the nodes without open children report their size to their
parents and leave.  A prefix sum over the children of each parent then gives every child its place in the
preorder range of the parent, and ranges are handed down in reverse order of the rounds.  The result is a
nested set: b lies below a exactly if they share a root and ``a.lo < b.lo <= a.hi``.

Nodes that never run out of open children are on a cycle; nodes whose parent got no range hang off one.

A round costs one aggregation and one join over the nodes that are still open, whose number falls quickly.
Once no more than ``rest_rows`` are open the remaining levels, however deep, are done in one task of that
bounded size; until then they stay distributed.  A busy parent is never gathered: its children's sizes are
partially summed, and their places come from prefix sums over 256 buckets.  Paths are never built in one task:
those of the last open nodes come from pointer doubling, the others from their parents', round by round.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import prefix_sums
from tidemark.runtime import Scratch

#: Open nodes that one task may finish.
REST_ROWS = 50_000
CYCLE = "cycle"

_UP = "_k binary, _p binary, _id string, _size bigint, _kids bigint"


def _finish_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """The upward rounds over the last open nodes; ``_round`` is -1 where a node never closes."""
    n = len(pdf)
    at = {k: i for i, k in enumerate(pdf["_k"])}
    parent = np.array([-1 if p is None else at.get(p, -1) for p in pdf["_p"]], np.int64)
    size, kids, done = pdf["_size"].to_numpy(np.int64).copy(), pdf["_kids"].to_numpy(np.int64).copy(), np.full(n, -1, np.int64)
    stack = list(np.flatnonzero(kids == 0))
    while stack:
        i = stack.pop()
        done[i] = 0
        if (p := parent[i]) >= 0:
            size[p] += size[i]
            kids[p] -= 1
            if kids[p] == 0:
                stack.append(p)
    return pdf.assign(_size=size, _round=done)


def _finish_down(pdf: pd.DataFrame) -> pd.DataFrame:
    """Root, depth and place of the last open nodes, all of them at once."""
    n = len(pdf)
    at = {k: i for i, k in enumerate(pdf["_k"])}
    parent = [-1 if p is None else at.get(p, -2) for p in pdf["_p"]]
    ids, off = pdf["_id"].tolist(), pdf["_off"].to_numpy(np.int64)
    root: list = [None] * n
    depth, lo = np.zeros(n, np.int64), np.zeros(n, np.int64)
    known = np.zeros(n, bool)
    for start in range(n):
        chain, i = [], start
        while i >= 0 and not known[i]:
            chain.append(i)
            known[i] = True
            i = parent[i]
        for j in reversed(chain):
            p = parent[j]
            if p == -1:
                root[j] = ids[j]
            elif p >= 0 and root[p] is not None:
                root[j], depth[j], lo[j] = root[p], depth[p] + 1, lo[p] + 1 + off[j]
    return pd.DataFrame({"_k": pdf["_k"], "_p": pdf["_p"], "_id": ids, "_size": pdf["_size"], "_root": root, "_depth": depth, "_lo": lo})


def _paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` (_k, _p, _id, ...) of whole upper parts of trees with ``_path`` from the root, by pointer doubling.

    A node holds the part of its path from below the node it points to.  A round puts that node's part before it
    and takes over its pointer, so a path of n nodes is complete after log2 n rounds, and no task holds more than
    its own rows.
    """
    known = nodes.filter("_root is not null")
    part, n = scratch.put(known.select("_k", F.col("_p").alias("_to"), F.array("_id").alias("_path")), "path-0")
    for i in count(1):
        if not part.filter("_to is not null").limit(1).count():
            break
        above = part.select(F.col("_k").alias("_to"), F.col("_to").alias("_next"), F.col("_path").alias("_above"))
        stepped = part.join(above, "_to", "left").select("_k", F.col("_next").alias("_to"), F.when(F.col("_above").isNull(), F.col("_path")).otherwise(F.concat("_above", "_path")).alias("_path"))
        part, _ = scratch.put(stepped, f"path-{i}")
        if i > 1:
            scratch.drop(f"path-{i - 1}")
    return nodes.join(part.select("_k", "_path"), "_k", "left")


def hierarchy(links: DataFrame, *, with_path: bool = False, rest_rows: int = REST_ROWS) -> DataFrame:
    """One row per end of a link: node_id, parent_id_known, root_id, depth, lo, hi, n_descendants, path.

    ``links``: child string, parent string; other columns are ignored.  ``root_id`` is the end of the chain of
    parents and ``depth`` the number of links to it.  A node whose chain never ends has root_id 'cycle', depth
    -1 and null lo, hi, n_descendants and path.  ``path`` runs from the root to the node and is null unless
    ``with_path``.

    Repeated links count once.  A link with a null end is none.  A child with several distinct parents keeps
    the smallest.  A link to itself is a cycle.  An empty table gives an empty result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    key: callable = lambda c: F.unhex(F.md5(c))  # noqa: E731  16 bytes in place of a long text
    link = links.select(F.col("child").alias("_c"), F.col("parent").alias("_d")).dropna().groupBy("_c").agg(F.min("_d").alias("_d"))
    kids = link.groupBy(F.col("_d").alias("_e")).agg(F.count(F.lit(1)).alias("_kids"))
    nodes = link.join(kids, F.col("_c") == F.col("_e"), "full").select(F.coalesce("_c", "_e").alias("_id"), F.col("_d").alias("_parent"), F.coalesce("_kids", F.lit(0)).alias("_kids"))
    open_, n_open = scratch.put(nodes.select(key(F.col("_id")).alias("_k"), key(F.col("_parent")).alias("_p"), "_id", F.lit(1).cast("bigint").alias("_size"), "_kids"), "up-0")

    rounds: list[DataFrame] = []
    n = n_open
    while n > rest_rows:
        closing, staying = open_.filter("_kids = 0"), open_.filter("_kids > 0")
        told = closing.filter("_p is not null").groupBy(F.col("_p").alias("_q")).agg(F.sum("_size").alias("_s"), F.count(F.lit(1)).alias("_n"))
        after = staying.join(told, F.col("_k") == F.col("_q"), "left").select(
            "_k", "_p", "_id", (F.col("_size") + F.coalesce("_s", F.lit(0))).alias("_size"), (F.col("_kids") - F.coalesce("_n", F.lit(0))).alias("_kids")
        )
        left, n_left = scratch.put(after, f"up-{len(rounds) + 1}")
        if n_left == n:  # nothing closed: only cycles are open
            break
        rounds.append(closing)
        open_, n = left, n_left
    rest, _ = scratch.put(
        open_.groupBy().applyInPandas(_finish_up, _UP + ", _round bigint") if n <= rest_rows else open_.withColumn("_round", F.lit(-1).cast("bigint")),
        "rest",
    )
    unclosed = rest.filter("_round < 0")

    cols = ["_k", "_p", "_id", "_size"]
    closed = rest.filter("_round >= 0").select(*cols, F.lit(len(rounds)).alias("_round"))
    for i, r in enumerate(rounds):
        closed = closed.unionByName(r.select(*cols, F.lit(i).alias("_round")))
    # digests are even, so their first byte is a bucket that keeps their order
    bucket = F.conv(F.hex(F.substring("_k", 1, 1)), 16, 10).cast("int")
    tops = closed.filter("_p is null").withColumn("_off", F.lit(0).cast("bigint"))
    places = prefix_sums(closed.filter("_p is not null"), ["_p"], ["_k"], F.col("_size"), bucket, "_off")
    placed, _ = scratch.put(tops.unionByName(places), "placed")

    out = "_k binary, _p binary, _id string, _size bigint, _root string, _depth bigint, _lo bigint"
    at_rest = placed.filter(F.col("_round") == len(rounds)).drop("_round")
    if n <= rest_rows:
        last, _ = scratch.put(at_rest.groupBy().applyInPandas(_finish_down, out), "down-rest")
        solved = _paths(last, scratch) if with_path else last.withColumn("_path", F.lit(None).cast("array<string>"))
    else:
        solved, _ = scratch.put(_tops(at_rest.filter("_p is null"), with_path), "down-rest")
    for i in range(len(rounds) - 1, -1, -1):
        these = placed.filter(F.col("_round") == i).drop("_round")
        above = solved.filter("_root is not null").select(F.col("_k").alias("_q"), "_root", "_depth", "_lo", "_path")
        below = these.filter("_p is not null").join(above, F.col("_p") == F.col("_q"), "left").select(
            *cols, "_root", (F.col("_depth") + 1).alias("_depth"), (F.col("_lo") + 1 + F.col("_off")).alias("_lo"),
            (F.concat("_path", F.array("_id")) if with_path else F.lit(None).cast("array<string>")).alias("_path"),
        )
        level = _tops(these.filter("_p is null"), with_path).unionByName(below)
        solved = solved.unionByName(scratch.put(level, f"down-{i}")[0])
    none = F.lit(None)
    solved = solved.unionByName(unclosed.select(*cols, none.cast("string").alias("_root"), none.cast("bigint").alias("_depth"), none.cast("bigint").alias("_lo"), none.cast("array<string>").alias("_path")))
    ok = F.col("_root").isNotNull()
    return solved.select(
        F.col("_id").alias("node_id"),
        F.coalesce("_root", F.lit(CYCLE)).alias("root_id"),
        F.when(ok, F.col("_depth")).otherwise(-1).cast("int").alias("depth"),
        F.when(ok, F.col("_lo")).alias("lo"),
        F.when(ok, F.col("_lo") + F.col("_size") - 1).alias("hi"),
        F.when(ok, F.col("_size") - 1).alias("n_descendants"),
        F.when(ok, F.col("_path")).alias("path"),
    )


def _tops(roots: DataFrame, with_path: bool) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    path = F.array("_id") if with_path else F.lit(None).cast("array<string>")
    return roots.select("_k", "_p", "_id", "_size", F.col("_id").alias("_root"), zero.alias("_depth"), zero.alias("_lo"), path.alias("_path"))


def descendants(nested: DataFrame, of: DataFrame, *, width: int = 64) -> DataFrame:
    """(node_id, descendant_id, distance) for every descendant of the nodes in ``of`` (column node_id).

    A range join on the nested set, blocked by root and by block of the preorder: each asked range is cut into
    the blocks it meets, each node lies in one.  A range covers its blocks but for two whole, so no more than
    ``2 width`` rows a node are looked at in vain.  Nodes on cycles have none.
    """
    block: callable = lambda c: F.floor(F.col(c) / width)
    asked = (
        nested.join(of.select("node_id").distinct(), "node_id", "left_semi")
        .filter("lo is not null and hi > lo")
        .select(F.col("node_id").alias("_a"), "root_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("depth").alias("_d"), F.explode(F.sequence(block("lo"), block("hi"))).alias("_block"))
    )
    inside = nested.filter("lo is not null").select(F.col("node_id").alias("descendant_id"), "root_id", "lo", "depth", block("lo").alias("_block"))
    return asked.join(inside, ["root_id", "_block"]).filter("lo > _lo and lo <= _hi").select(F.col("_a").alias("node_id"), "descendant_id", (F.col("depth") - F.col("_d")).alias("distance"))


def member_links(edges: DataFrame, rel: str = "member-of", child: str = "src", parent: str = "dst") -> DataFrame:
    """child, parent of the links of one relation; ``rel`` is compared without outer blanks and letter case."""
    return edges.filter(norm_rel(F.col("rel")) == rel).select(F.col(child).alias("child"), F.col(parent).alias("parent"))


def norm_rel(rel: Column) -> Column:
    return F.lower(F.trim(rel))
