"""Queries of the graph operators over the whole node and edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.sources import table


def _ne(spark, d):
    return table(spark, d, "nodes"), table(spark, d, "edges")


def _routes(nodes):
    return nodes.filter("kind = 'route'").select(F.col("id").alias("node_id"))


def impact_down(spark, d):
    n, e = _ne(spark, d)
    r = graph.reach(e, _routes(n), direction="out", depth=2)
    return r.filter("distance > 0").select("node_id", "distance", graph.risk(F.col("distance")).alias("risk"))


def impact_up(spark, d):
    n, e = _ne(spark, d)
    r = graph.reach(e, n.filter("kind = 'cursor'").select(F.col("id").alias("node_id")), direction="in", depth=3)
    return r.filter("distance > 0").select("node_id", "distance", graph.risk(F.col("distance")).alias("risk"))


def shortest_path_len(spark, d):
    n, e = _ne(spark, d)
    start = graph.degree(e).orderBy(F.col("n_out").desc(), "node_id").limit(1).select("node_id")
    return graph.reach(e, start, direction="out", depth=6).filter("distance > 0").select("node_id", F.col("distance").alias("hops"))


def shortest_paths(spark, d):
    n, e = _ne(spark, d)
    start = graph.degree(e).orderBy(F.col("n_out").desc(), "node_id").limit(1).select("node_id")
    return graph.shortest_paths(e, start, _routes(n)).select("node_id", "hops", F.array_join("path", " > ").alias("path"))


def neighbors(spark, d):
    n, e = _ne(spark, d)
    return graph.neighbours(e, _routes(n))


def degree(spark, d):
    return graph.degree(table(spark, d, "edges"))


def importance(spark, d):
    return graph.importance(*_ne(spark, d))


def cluster_importance(spark, d):
    n, e = _ne(spark, d)
    members = n.filter("cluster_id is not null").select(F.col("id").alias("node_id"), "cluster_id").distinct()
    return graph.importance(n, e).join(members, "node_id").groupBy("cluster_id").agg(F.round(F.sum("importance"), 4).alias("importance"), F.count(F.lit(1)).alias("n_members"))


def components(spark, d):
    return graph.components(table(spark, d, "edges"))


def structural_weights(spark, d):
    return graph.structural_weights(table(spark, d, "edges"))


def communities(spark, d):
    return graph.label_communities(graph.structural_weights(table(spark, d, "edges")))


def surprising_edges(spark, d):
    return graph.surprising(*_ne(spark, d))


def prune_dangling(spark, d):
    kept, dropped = graph.dangling(*_ne(spark, d))
    both = kept.select("rel", F.lit(1).alias("k")).unionByName(dropped.select("rel", F.lit(0).alias("k")))
    return both.groupBy(F.lower(F.trim("rel")).alias("rel")).agg(F.sum("k").alias("n_kept"), F.sum(1 - F.col("k")).alias("n_dropped"))


def federated_bridge(spark, d):
    return graph.route_bridge(table(spark, d, "nodes"))


def federated_impact(spark, d):
    n, e = _ne(spark, d)
    seeds = n.filter("kind = 'route' and root = 'ledger-hub'").select(F.col("id").alias("node_id"))
    r = graph.federated_reach(n, e, seeds, depth=3)
    roots = n.groupBy(F.col("id").alias("node_id")).agg(F.min("root").alias("root"))
    return r.filter("distance > 0").join(roots, "node_id", "left").select("node_id", "distance", "root")


def seed_expansion(spark, d):
    n, e = _ne(spark, d)
    seeds = n.filter("kind = 'file' and lang = 'go'").select(F.col("id").alias("node_id"), F.lit(1.0).alias("score")).distinct()
    return graph.expand_from_seeds(e, seeds)


QUERIES = {f.__name__: f for f in (impact_down, impact_up, shortest_path_len, shortest_paths, neighbors, degree, importance, cluster_importance, components, structural_weights, communities, surprising_edges, prune_dangling, federated_bridge, federated_impact, seed_expansion)}

_E = "select distinct src, dst, lower(trim(rel)) as rel from edges where src is not null and dst is not null and rel is not null"
_ARCH = ", ".join(f"'{r}'" for r in graph.ARCHITECTURAL)
_DETAIL = ", ".join(f"'{r}'" for r in graph.DETAIL_KINDS)
_RISK = "case when distance = 1 then 'high' when distance = 2 then 'medium' else 'low' end as risk"
_DEG = f"""select node_id, count(*) filter (o = 1) as n_out, count(*) filter (o = 0) as n_in, count(*) as degree
  from (select src as node_id, 1 as o from ({_E}) union all select dst, 0 from ({_E})) group by node_id"""
_KIND = "case when n.kind = 'symbol' then case " + " ".join(f"when contains(lower(coalesce(n.node_type, '')), '{t}') then '{t}'" for t in graph.SYMBOL_TYPES) + " else 'symbol' end else n.kind end"
_IMP = f"""select * from (select node_id, cast(round(case when k in ('class', 'interface', 'route', 'table') then 3.0 when k = 'file' then 2.0 else 0.0 end
    + coalesce(c, 0) * case when k in ({_DETAIL}) then 0.1 else 1.0 end, 6) as double) as importance
  from (select n.id as node_id, {_KIND} as k, i.c from (select id, min(kind) kind, min(node_type) node_type from nodes group by id) n
  left join (select dst, count(*) c from ({_E}) where rel in ({_ARCH}) group by dst) i on i.dst = n.id)) where importance > 0"""


def _reach(seeds: str, a: str, b: str, depth: int, edges: str = _E) -> str:
    return f"""with recursive e as (select distinct {a} as f, {b} as t from ({edges})), s as ({seeds}),
  r as (select node_id, 0 as distance from s union select e.t, r.distance + 1 from r join e on e.f = r.node_id where r.distance < {depth})
  select node_id, min(distance) as distance from r group by node_id having min(distance) > 0"""


_KEY = r"""upper(coalesce(http_method, 'ANY')) || ' ' || regexp_replace(regexp_replace(regexp_replace(route_path, '\?.*$', ''), '/+$', ''), '\{[^}/]*\}|:[A-Za-z_][A-Za-z0-9_]*', '{}', 'g')"""
_BRIDGE = f"""with r as (select distinct id, root, {_KEY} as key from nodes where kind = 'route' and route_path is not null),
  h as (select key, root, min(id) as head from r group by all)
  select r.id as a, h.head as b, r.key from r join h on r.key = h.key and r.root <> h.root"""
_TOP_OUT = f"select node_id from ({_DEG}) order by n_out desc, node_id limit 1"

SQL = {
    "impact_down": f"select node_id, distance, {_RISK} from ({_reach("select distinct id as node_id from nodes where kind = 'route'", 'src', 'dst', 2)})",
    "impact_up": f"select node_id, distance, {_RISK} from ({_reach("select distinct id as node_id from nodes where kind = 'cursor'", 'dst', 'src', 3)})",
    "shortest_path_len": f"select node_id, distance as hops from ({_reach(_TOP_OUT, 'src', 'dst', 6)})",
    "neighbors": f"""with r as (select distinct id from nodes where kind = 'route'), e as ({_E})
  select src as node_id, dst as neighbour, rel, 'out' as direction from e where src in (select id from r)
  union all select dst, src, rel, 'in' from e where dst in (select id from r)""",
    "degree": _DEG,
    "importance": _IMP,
    "cluster_importance": f"""select cluster_id, round(sum(importance), 4) as importance, count(*) as n_members
  from ({_IMP}) i join (select distinct id, cluster_id from nodes where cluster_id is not null) m on m.id = i.node_id group by cluster_id""",
    "structural_weights": f"select least(src, dst) as a, greatest(src, dst) as b, count(*) as w from ({_E}) where rel in ('calls', 'imports', 'inherits', 'implements') and src <> dst group by all",
    "surprising_edges": f"""with p as (select id, split_part(min(file), '/', 1) area, min(cluster_id) cluster from nodes group by id),
  c as (select src, dst, lower(trim(rel)) rel, max(confidence) confidence from edges group by all),
  s as (select src, dst, rel, confidence, (case when a.area <> b.area then 2 else 0 end) + (case when a.cluster <> b.cluster then 1 else 0 end) as score
        from c join p a on a.id = src join p b on b.id = dst where rel in ({_ARCH}))
  select * from s where score > 0 order by score desc, confidence desc nulls last, src, dst, rel limit 20""",
    "prune_dangling": """with i as (select distinct id from nodes)
  select lower(trim(rel)) as rel, count(*) filter (k) as n_kept, count(*) filter (not k) as n_dropped
  from (select rel, src in (select id from i) and dst in (select id from i) as k from edges) group by 1""",
    "federated_bridge": _BRIDGE,
    "federated_impact": f"""with f as ({_reach("select distinct id as node_id from nodes where kind = 'route' and root = 'ledger-hub'", 'src', 'dst', 3, _E + " union select a, b, 'bridge' from (" + _BRIDGE + ")")})
  select f.node_id, f.distance, r.root from f left join (select id, min(root) root from nodes group by id) r on r.id = f.node_id""",
}


def components_sql(links: str) -> str:
    """node_id and the least name of its component, over links (src, dst)."""
    return f"""with recursive k as (select distinct src, dst from ({links}) where src is not null and dst is not null), e as materialized (select src as a, dst as b from k union select dst, src from k),
  cc(node_id, component) using key (node_id) as (select a, least(a, min(b)) from e group by a
    union select e.a, min(u.component) from cc u join e on e.b = u.node_id join recurring.cc as cur on cur.node_id = e.a where u.component < cur.component group by e.a)
  select node_id, component from cc"""


SQL["components"] = components_sql(_E)
_FROM_TOP = _reach(_TOP_OUT, "src", "dst", 6).replace(" having min(distance) > 0", "")
SQL["shortest_paths"] = f"""with recursive d as materialized ({_FROM_TOP}), l as materialized (select distinct src, dst from ({_E})),
  v as (select b.node_id, min(l.src) as via from d b join l on l.dst = b.node_id join d a on a.node_id = l.src and a.distance = b.distance - 1 group by b.node_id),
  p as (select node_id, node_id as path from d where distance = 0 union all select v.node_id, p.path || ' > ' || v.node_id from p join v on v.via = p.node_id)
  select p.node_id, d.distance as hops, p.path from p join d using (node_id) where p.node_id in (select id from nodes where kind = 'route')"""
SQL["seed_expansion"] = """with e as (select src as a, dst as b from edges where src is not null and dst is not null and rel is not null union select dst, src from edges where src is not null and dst is not null and rel is not null),
  s as (select distinct id as seed from nodes where kind = 'file' and lang = 'go'),
  h1 as (select seed, b, row_number() over (partition by seed order by b) as k from (select distinct seed, b from s join e on e.a = s.seed where b <> seed)),
  l1 as (select seed, b from h1 where k <= 199), c as (select seed, 199 - count(*) as room from l1 group by seed),
  h2 as (select seed, b, row_number() over (partition by seed order by b) as k from (select distinct l1.seed, e.b from l1 join e on e.a = l1.b where e.b <> l1.seed) x where not exists (select 1 from l1 y where y.seed = x.seed and y.b = x.b)),
  r as (select seed as node_id, 0 as d from s union all select b, 1 from l1 union all select h2.b, 2 from h2 join c using (seed) where h2.k <= c.room)
  select node_id, min(d) as distance, cast(pow(0.5, min(d)) as double) as rank from r group by node_id"""
