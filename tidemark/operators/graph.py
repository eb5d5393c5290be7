"""Traversal, ranking and clustering over node and edge tables.

Edges are (src, dst, rel, ...).  Loops hold one table a level in the shared folder and stop at an empty
frontier; each level costs one join of the frontier with the edges, and what was reached before is removed by an
anti join on the node.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import Scratch

# fixed values: relations that carry architecture, kinds of noise and of weight
ARCHITECTURAL = ("calls", "imports", "inherits", "implements", "exposes", "injects", "renders", "produces")
STRUCTURAL = ("calls", "imports", "inherits", "implements")
DETAIL_KINDS = ("assignment", "case-branch", "condition", "cursor", "raise", "exception-handler")
KIND_BASE = {"file": 2.0, "class": 3.0, "interface": 3.0, "route": 3.0, "table": 3.0}
SYMBOL_TYPES = ("class", "method", "function", "interface", "enum", "type", "getter", "setter", "property")
NOISE_FACTOR = 0.1


def tidy_edges(edges: DataFrame) -> DataFrame:
    """src, dst, rel without repeats; rel without outer blanks and letter case, rows with a null end left out."""
    return edges.select("src", "dst", F.lower(F.trim("rel")).alias("rel")).dropna().distinct()


def neighbours(edges: DataFrame, of: DataFrame, direction: str = "both") -> DataFrame:
    """node_id, neighbour, rel, direction of every edge that touches a node of ``of`` (column node_id)."""
    asked = of.select("node_id").distinct()
    e = tidy_edges(edges)
    out = e.join(asked, e["src"] == asked["node_id"]).select("node_id", F.col("dst").alias("neighbour"), "rel", F.lit("out").alias("direction"))
    into = e.join(asked, e["dst"] == asked["node_id"]).select("node_id", F.col("src").alias("neighbour"), "rel", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def degree(edges: DataFrame) -> DataFrame:
    """node_id, n_out, n_in, degree; partially summed, so hubs cost no more than others."""
    e = tidy_edges(edges)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    g = ends.groupBy("node_id").agg(F.sum("o").alias("n_out"), F.sum(1 - F.col("o")).alias("n_in"))
    return g.select("node_id", "n_out", "n_in", (F.col("n_out") + F.col("n_in")).alias("degree"))


def derived_kind(kind: Column, node_type: Column) -> Column:
    """The kind of a node; of a symbol the first of ``SYMBOL_TYPES`` its type contains, else 'symbol'."""
    out, t = F.lit("symbol"), F.lower(F.coalesce(node_type, F.lit("")))
    for k in reversed(SYMBOL_TYPES):
        out = F.when(F.contains(t, F.lit(k)), k).otherwise(out)
    return F.when(kind == "symbol", out).otherwise(kind)


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, importance: a base by derived kind plus incoming architectural edges, which count a tenth at detail kinds."""
    kind = derived_kind(F.col("kind"), F.col("node_type"))
    base = F.lit(0.0)
    for k, v in KIND_BASE.items():
        base = F.when(kind == k, v).otherwise(base)
    into = tidy_edges(edges).filter(F.col("rel").isin(*ARCHITECTURAL)).groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    n = nodes.groupBy(F.col("id").alias("node_id")).agg(F.min("kind").alias("kind"), F.min("node_type").alias("node_type")).join(into, "node_id", "left")
    score = base + F.coalesce("n", F.lit(0)) * F.when(kind.isin(*DETAIL_KINDS), NOISE_FACTOR).otherwise(1.0)
    return n.select("node_id", F.round(score, 6).alias("importance")).filter("importance > 0")


def risk(distance: Column) -> Column:
    return F.when(distance == 1, "high").when(distance == 2, "medium").otherwise("low")


def reach(edges: DataFrame, seeds: DataFrame, *, direction: str = "out", depth: int = 2, via: bool = False) -> DataFrame:
    """node_id, distance (and via, the least predecessor) of every node within ``depth`` links of a seed.

    ``seeds``: node_id; they have distance 0 and are part of the result.  ``direction`` is 'out', 'in' or
    'both'.  A node is given once, at its least distance.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    e = tidy_edges(edges).select("src", "dst").distinct()
    if direction != "out":
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        e = back if direction == "in" else e.unionByName(back).distinct()
    start = seeds.select("node_id").dropna().distinct().select("node_id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via"))
    frontier, n = scratch.put(start, "level-0")
    reached = frontier
    for level in range(1, depth + 1):
        if not n:
            break
        step = frontier.select(F.col("node_id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("via"))
        new = step.join(reached.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(level).alias("distance"), "via")
        frontier, n = scratch.put(new, f"level-{level}")
        reached = reached.unionByName(frontier)
    return reached if via else reached.drop("via")


def shortest_paths(edges: DataFrame, source: DataFrame, targets: DataFrame, *, max_hops: int = 6, direction: str = "out") -> DataFrame:
    """node_id, hops, path from the source to each target reached; ties go to the least predecessor.

    ``source``: one node_id.  Paths are read back level by level, each target's one predecessor at a time.
    """
    r = reach(edges, source, direction=direction, depth=max_hops, via=True)
    r, _ = Scratch(edges.sparkSession, "paths").put(r, "reached")
    out = r.join(targets.select("node_id").distinct(), "node_id", "left_semi").select("node_id", F.col("distance").alias("hops"), F.array("node_id").alias("path"), F.col("via").alias("_at"))
    for _ in range(max_hops):
        up = r.select(F.col("node_id").alias("_at"), F.col("via").alias("_up"))
        out = out.join(up, "_at", "left").select("node_id", "hops", F.when(F.col("_at").isNull(), F.col("path")).otherwise(F.concat(F.array("_at"), F.col("path"))).alias("path"), F.col("_up").alias("_at"))
    return out.select("node_id", "hops", "path")


def components(edges: DataFrame) -> DataFrame:
    """node_id, component: the least node id of its undirected component.

    Labels go to the least of the neighbours' and are then shortened by pointer jumping, so the rounds grow with
    the logarithm of the diameter; they go on until nothing changes.  Hubs are folded by partial minima.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = tidy_edges(edges).select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both, _ = scratch.put(both, "edges")
    label, _ = scratch.put(both.groupBy(F.col("src").alias("node_id")).agg(F.least(F.min("dst"), F.min("src")).alias("label")), "label-0")
    for i in count(1):
        near = both.join(label.select(F.col("node_id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("label").alias("near"))
        hop = label.join(near, "node_id", "left").select("node_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = label.select(F.col("node_id").alias("label"), F.col("label").alias("far"))
        new = hop.join(far, "label", "left").select("node_id", F.least("label", "far").alias("label"), F.col("old"))
        stepped, _ = scratch.put(new, f"label-{i}")
        label = stepped.drop("old")
        if not stepped.filter("label <> old").limit(1).count():
            break
        if i > 1:
            scratch.drop(f"label-{i - 1}")
    return label.withColumnRenamed("label", "component")


def structural_weights(edges: DataFrame) -> DataFrame:
    """a < b, w: how many structural relations join two nodes, whatever their direction; loops left out."""
    e = tidy_edges(edges).filter(F.col("rel").isin(*STRUCTURAL) & (F.col("src") != F.col("dst")))
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("w"))


def label_communities(weights: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """node_id, community by synchronous label propagation over weighted pairs (a, b, w).

    Each round every node of one half, chosen by hash and round, takes the heaviest label around it, its own if
    that is among them, else the least.  It ends after two rounds without a move, and with an error where labels
    still move after ``max_rounds``.  A distributed stand-in for the sequential modularity kernel; its labels differ.
    """
    scratch = Scratch(weights.sparkSession, "communities")
    both, _ = scratch.put(weights.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(weights.select(F.col("b").alias("x"), F.col("a").alias("y"), "w")), "edges")
    label, _ = scratch.put(both.select(F.col("x").alias("node_id")).distinct().withColumn("community", F.col("node_id")), "label-0")
    still = 0
    for i in range(1, max_rounds + 1):
        own = label.select(F.col("node_id").alias("x"), F.col("community").alias("mine"))
        votes = both.join(label.withColumnRenamed("node_id", "y"), "y").groupBy("x", "community").agg(F.sum("w").alias("w")).join(own, "x")
        best = votes.groupBy(F.col("x").alias("node_id")).agg(F.min(F.struct((-F.col("w")).alias("w"), (F.col("community") != F.col("mine")).alias("other"), "community")).alias("b"))
        moves = F.pmod(F.xxhash64("node_id", F.lit(i)), F.lit(2)) == 0
        stepped, _ = scratch.put(label.join(best, "node_id", "left").select("node_id", F.when(moves & F.col("b").isNotNull(), F.col("b.community")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")), f"label-{i}")
        label = stepped.drop("old")
        still = 0 if stepped.filter("community <> old").limit(1).count() else still + 1
        if still == 2:
            return label
        if i > 1:
            scratch.drop(f"label-{i - 1}")
    if label.limit(1).count():
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    return label


def louvain(pairs: list[tuple[int, int, float]], n: int, passes: int = 10) -> list[int]:
    """Communities of nodes 0..n-1 of a small weighted graph by greedy modularity, in order of node.

    A node goes to the neighbouring community of the greatest gain, ties to the least; communities are then
    merged into nodes and the pass repeats until nothing moves.  Labels count from 0 in order of first node.
    """
    adj: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    loops = [0.0] * n
    for a, b, w in pairs:
        if a == b:
            loops[a] += w
        else:
            adj[a][b] += w
            adj[b][a] += w
    owner = list(range(n))
    for _ in range(passes):
        size = len(adj)
        deg = [sum(adj[i].values()) + 2 * loops[i] for i in range(size)]
        total = sum(deg)
        if not total:
            break
        com, weight = list(range(size)), deg[:]
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in range(size):
                here = com[i]
                weight[here] -= deg[i]
                links: dict[int, float] = defaultdict(float)
                for j, w in adj[i].items():
                    links[com[j]] += w
                best, gain = here, links[here] - weight[here] * deg[i] / total
                for c in sorted(links):
                    g = links[c] - weight[c] * deg[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += deg[i]
                if best != here:
                    com[i], moved, moved_any = best, True, True
        names = {c: k for k, c in enumerate(dict.fromkeys(com))}
        owner = [names[com[o]] for o in owner]
        if not moved_any:
            break
        nxt: list[dict[int, float]] = [defaultdict(float) for _ in names]
        nloops = [0.0] * len(names)
        for i in range(size):
            a = names[com[i]]
            nloops[a] += loops[i]
            for j, w in adj[i].items():
                b = names[com[j]]
                if a == b:
                    nloops[a] += w / 2
                else:
                    nxt[a][b] += w
        adj, loops = nxt, nloops
    return owner


def community_kernel(weights: DataFrame, group: str, *, max_edges: int = 200_000) -> DataFrame:
    """group, node_id, community of the weighted pairs of each group; groups above ``max_edges`` are refused.

    The kernel is sequential, so a group must fit a task; larger ones go through ``label_communities``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_edges:
            raise ValueError(f"group {pdf[group].iloc[0]!r} has {len(pdf)} edges")
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {x: i for i, x in enumerate(names)}
        com = louvain([(at[a], at[b], float(w)) for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"], strict=True)], len(names))
        return pd.DataFrame({group: pdf[group].iloc[0], "node_id": names, "community": com})

    kind = dict(weights.dtypes)[group]
    return weights.select(group, "a", "b", "w").groupBy(group).applyInPandas(run, f"{group} {kind}, node_id string, community int")


def communities_by_group(weights: DataFrame, group: str, *, max_edges: int = 200_000) -> DataFrame:
    """group, node_id, community of every group: by the modularity kernel, larger groups by label propagation.

    A community bears the name of its least node.  Communities of a single node do not occur, as every node has a
    neighbour, unless modularity parts it; those are left out.
    """
    size = weights.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    scratch = Scratch(weights.sparkSession, "by-group")
    size, _ = scratch.put(size, "sizes")
    small = community_kernel(weights.join(size.filter(F.col("_n") <= max_edges).select(group), group, "left_semi"), group, max_edges=max_edges)
    found = small.select(group, "node_id", F.col("community").cast("string").alias("_c"))
    big = size.filter(F.col("_n") > max_edges)
    if big.limit(1).count():
        rest = weights.join(big.select(group), group, "left_semi")
        # nodes of one group have edges within it alone, so all groups may spread their labels at once
        labels = label_communities(rest.select("a", "b", "w"))
        owner = rest.select(F.explode(F.array("a", "b")).alias("node_id"), group).distinct()
        found = found.unionByName(labels.join(owner, "node_id").select(group, "node_id", F.col("community").alias("_c")))
    found, _ = scratch.put(found, "found")
    names = found.groupBy(group, "_c").agg(F.min("node_id").alias("community"), F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m")
    return found.join(names, [group, "_c"]).select(group, "node_id", "community")


def expand_from_seeds(edges: DataFrame, seeds: DataFrame, *, hops: int = 2, max_nodes: int = 200, decay: float = 0.5) -> DataFrame:
    """node_id, distance, rank: bounded expansions, rank = seed score times ``decay`` per hop.

    ``seeds``: node_id, score.  Each seed expands on its own to at most ``max_nodes`` nodes, itself among them, so
    no seed is cut for another's sake.  Where the bound cuts a level, the least ids stay.  A node keeps its least
    distance from any seed, and of that the best rank.

    A seed takes at most its room, ``max_nodes`` less what it has seen, so a neighbour that it takes stands behind
    fewer than ``max_nodes`` other neighbours of the same node: those seen, and those that it takes as well.  Each
    node therefore offers its ``max_nodes`` least neighbours, and nothing is lost.
    """
    scratch = Scratch(edges.sparkSession, "expand")
    e = edges.filter("rel is not null").select("src", "dst").dropna()
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # dense ranks bear repeats, so hubs are cut before the shuffle, and the distinct needs none of its own
    e = e.withColumn("_at", F.dense_rank().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("_at") <= max_nodes).select("src", "dst").distinct()
    level = seeds.groupBy("node_id").agg(F.max("score").alias("rank")).select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("distance"), "rank")
    frontier, n = scratch.put(level, "hop-0")
    seen = frontier
    for h in range(1, hops + 1):
        if not n:
            break
        room = seen.groupBy("seed").agg((max_nodes - F.count(F.lit(1))).alias("_room")).filter("_room > 0")
        near = frontier.select("seed", F.col("node_id").alias("src"), "rank").join(room, "seed")
        step = e.join(near, "src").groupBy("seed", F.col("dst").alias("node_id")).agg((F.max("rank") * decay).alias("rank"), F.first("_room").alias("_room"))
        step = step.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        step = top_ranked(step, ["seed"], [F.col("node_id")], max_nodes, "_at").filter("_at <= _room")
        frontier, n = scratch.put(step.select("seed", "node_id", F.lit(h).alias("distance"), "rank"), f"hop-{h}")
        seen = seen.unionByName(frontier)
    best = seen.groupBy("node_id").agg(F.max(F.struct((-F.col("distance")).alias("d"), "rank")).alias("b"))
    return best.select("node_id", (-F.col("b.d")).alias("distance"), F.col("b.rank").alias("rank"))


def surprising(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """The k edges that most cross areas: 2 if their ends lie in different top folders, 1 more if in different clusters."""
    place = nodes.groupBy("id").agg(F.min("file").alias("file"), F.min("cluster_id").alias("cluster"))
    area = F.split_part("file", F.lit("/"), F.lit(1))
    a = place.select(F.col("id").alias("src"), area.alias("sa"), F.col("cluster").alias("sc"))
    b = place.select(F.col("id").alias("dst"), area.alias("da"), F.col("cluster").alias("dc"))
    conf = edges.select("src", "dst", F.lower(F.trim("rel")).alias("rel"), "confidence").groupBy("src", "dst", "rel").agg(F.max("confidence").alias("confidence"))
    s = conf.filter(F.col("rel").isin(*ARCHITECTURAL)).join(a, "src").join(b, "dst")
    score = F.when(F.col("sa") != F.col("da"), 2).otherwise(0) + F.when(F.col("sc").isNotNull() & F.col("dc").isNotNull() & (F.col("sc") != F.col("dc")), 1).otherwise(0)
    s = s.select("src", "dst", "rel", "confidence", score.alias("score")).filter("score > 0")
    return s.orderBy(F.col("score").desc(), F.col("confidence").desc_nulls_last(), "src", "dst", "rel").limit(k)


def dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): edges with both ends among the nodes, and the others."""
    ids = nodes.select("id").filter("id is not null").distinct()
    kept = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    lost_src = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
    lost_dst = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return kept, lost_src.unionByName(lost_dst)


def route_key(method: Column, path: Column) -> Column:
    """Method and path with every parameter as ``{}``; query string and last slash gone."""
    p = F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), r"/+$", "")
    return F.concat_ws(" ", F.upper(method), F.regexp_replace(p, r"\{[^}/]*\}|:[A-Za-z_][A-Za-z0-9_]*", "{}"))


def route_bridge(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, key) of routes of different roots that agree in method and path.

    The link is stated once a route: to the least id of each other root with its key.  Routes of a key are
    first folded to one a root, so a key shared by many routes gives no square of pairs.
    """
    r = nodes.filter("kind = 'route' and route_path is not null").select("id", "root", route_key(F.coalesce("http_method", F.lit("ANY")), F.col("route_path")).alias("key")).distinct()
    heads = r.groupBy("key", "root").agg(F.min("id").alias("head"))
    return r.select(F.col("id").alias("a"), F.col("root").alias("ra"), "key").join(heads.select(F.col("head").alias("b"), F.col("root").alias("rb"), "key"), "key").filter("ra <> rb").select("a", "b", "key")


def _route_classes(nodes: DataFrame) -> DataFrame:
    """id, root, method, key, parts (segments, a parameter as ``{}``) of every route."""
    method = F.upper(F.coalesce(F.col("http_method"), F.lit("ANY")))
    path = F.regexp_replace(F.col("route_path"), r"\?.*$", "")
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.startswith(":") | (s.startswith("{") & s.endswith("}")), "{}").otherwise(s))
    return nodes.filter("kind = 'route' and route_path is not null").select("id", "root", method.alias("method"), route_key(method, F.col("route_path")).alias("key"), F.array_join(parts, "/").alias("parts")).distinct()


def route_matches(routes: DataFrame) -> DataFrame:
    """Pairs (c, to) of distinct route classes: a caller of class ``c`` (method, key, parts) is served by class ``to``.

    Served are equal keys, and routes of the same method or ANY whose parameters stand for any segment of the
    caller.  Callers are masked by the places of parameters that occur, so all of it is joined on equality.
    """
    name = F.struct("method", "key", "parts")
    c = routes.select("method", "key", "parts", name.alias("c")).distinct()
    segments = F.split("parts", "/")
    held = F.transform(segments, lambda s: s == "{}")
    served = c.select(F.col("c").alias("to"), F.col("method").alias("m"), F.col("parts").alias("p"))
    masks = c.select(held.alias("mask")).distinct().withColumn("n", F.size("mask"))
    calls = c.withColumn("n", F.size(segments)).join(masks, "n")
    calls = calls.select("c", F.explode(F.array_distinct(F.array(F.col("method"), F.lit("ANY")))).alias("m"), F.array_join(F.zip_with(segments, F.col("mask"), lambda s, x: F.when(x, "{}").otherwise(s)), "/").alias("p"))
    same = c.select("c", "key").join(c.select(F.col("c").alias("to"), "key"), "key").select("c", "to")
    return calls.join(served, ["m", "p"]).select("c", "to").unionByName(same).distinct()


def federated_reach(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, depth: int = 3) -> DataFrame:
    """node_id, distance within ``depth`` links of a seed, where a route also leads to every matching route of other roots.

    Such a hop goes from a route to its (class, root) and from there to all members of the matching classes of
    other roots, and counts as one; there are no pairs of routes.
    """
    scratch = Scratch(edges.sparkSession, "federated")
    e = tidy_edges(edges).select("src", "dst").distinct()
    classes, _ = scratch.put(_route_classes(nodes), "routes")
    members = classes.select("id", "root", F.struct("method", "key", "parts").alias("c"))
    owners = members.select(F.col("root").alias("to_root"), F.col("c").alias("to")).distinct()
    served, _ = scratch.put(route_matches(classes).join(owners, "to"), "served")
    frontier, n = scratch.put(seeds.select("node_id").dropna().distinct().withColumn("distance", F.lit(0)), "level-0")
    reached = frontier
    for level in range(1, depth + 1):
        if not n:
            break
        at = frontier.select(F.col("node_id").alias("src"))
        within = at.join(e, "src").select(F.col("dst").alias("node_id"))
        origin = at.join(members, F.col("src") == F.col("id")).select("c", "root").distinct()
        target = origin.join(served, "c").filter("root <> to_root").select("to", "to_root").distinct()
        across = target.join(members.select("id", F.col("root").alias("to_root"), F.col("c").alias("to")), ["to", "to_root"]).select(F.col("id").alias("node_id"))
        new = within.unionByName(across).distinct().join(reached.select("node_id"), "node_id", "left_anti").withColumn("distance", F.lit(level))
        frontier, n = scratch.put(new, f"level-{level}")
        reached = reached.unionByName(frontier)
    return reached


def top_ranked(df: DataFrame, partition: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(name) <= k)
