"""Queries of the general training-data operators over the whole test tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import blank, iso_micros
from tidemark.operators import asof, delivery, hierarchy, late, skew
from tidemark.runtime import Scratch
from tidemark.sources import table


def subject_messages(spark: SparkSession, d: str) -> DataFrame:
    """event_id, entity, at: the first delivery of every message that names a subject and a readable time."""
    e = table(spark, d, "intelligence_events")
    named = e.filter(~blank(F.col("idempotency_key"))).select(
        "idempotency_key", "line_no", "recorded_at", iso_micros(F.col("occurred_at")).alias("at"), F.try_variant_get(F.try_parse_json("payload"), "$.subject", "string").alias("entity")
    )
    first = late.first_delivery(named.filter("at is not null and entity is not null"), F.col("idempotency_key"), F.col("recorded_at"), F.col("line_no"), {"at": F.col("at"), "entity": F.col("entity")})
    return first.select(F.col("_key").alias("event_id"), "entity", "at")


def part_of_versions(spark: SparkSession, d: str) -> DataFrame:
    """version_id, entity, valid_at, known_at of the part-of assertions.

    A time absent from the JSON comes from the supporting sources.  A row whose JSON does not parse, or whose
    stated time cannot be read, does not count.
    """
    a = table(spark, d, "memory_graph_assertions").filter("predicate = 'part-of'").select("id", "subject_ref", F.try_parse_json("assertion_json").alias("j")).filter("j is not null")
    get = lambda p, t="string": F.try_variant_get("j", p, t)
    a = a.select("id", "subject_ref", get("$.validAt").alias("v"), get("$.knownAt").alias("k"), get("$.supportedBy", "array<string>").alias("by"))
    full = a.filter("v is not null and k is not null").select("id", "subject_ref", iso_micros(F.col("v")).alias("valid_at"), iso_micros(F.col("k")).alias("known_at"))
    # rows of one id agree but where they are dirty; of those that differ the smallest counts
    gaps = a.filter("v is null or k is null").groupBy("id").agg(F.min(F.struct("subject_ref", "v", "k", "by")).alias("r")).select("id", "r.*")
    sources = table(spark, d, "capture_sources").filter("id is not null").groupBy(F.col("id").alias("source")).agg(F.min(F.unix_micros("valid_at")).alias("sv"), F.max(F.unix_micros("known_at")).alias("sk"))
    asked = gaps.select("id", "subject_ref", "v", "k", F.posexplode("by").alias("pos", "source"))
    filled = (
        asked.join(sources, "source")
        .groupBy("id", "subject_ref", "v", "k")
        .agg(F.max(F.when(F.col("pos") == 0, F.col("sv"))).alias("sv"), F.max("sk").alias("sk"))
        .select("id", "subject_ref", F.when(F.col("v").isNull(), F.col("sv")).otherwise(iso_micros(F.col("v"))).alias("valid_at"), F.when(F.col("k").isNull(), F.col("sk")).otherwise(iso_micros(F.col("k"))).alias("known_at"))
    )
    return full.unionByName(filled).select(F.col("id").alias("version_id"), F.col("subject_ref").alias("entity"), "valid_at", "known_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = asof.bitemporal_asof(subject_messages(spark, d), part_of_versions(spark, d))
    return found.select(F.col("event_id").alias("idempotency_key"), F.col("version_id").alias("assertion_id"))


def project_records(spark: SparkSession, d: str) -> DataFrame:
    """key (project), occurred, arrived of every message, counted once, by its earliest arrival."""
    e = table(spark, d, "intelligence_events").select("line_no", "idempotency_key", "recorded_at", "occurred_at", F.col("identity.project_id").alias("project"))
    e = e.filter(~blank(F.col("idempotency_key")) & F.col("recorded_at").isNotNull())
    one = late.first_delivery(e, F.col("idempotency_key"), F.col("recorded_at"), F.col("line_no"), {"key": F.col("project"), "occurred": iso_micros(F.col("occurred_at")), "arrived": F.unix_micros("recorded_at")})
    return one.filter("key is not null and occurred is not null")


def _day(us: str):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = late.corrected_totals(project_records(spark, d))
    return t.filter("total_final <> total_at_close").select(F.col("key").alias("project_id"), _day("period_start").alias("event_day"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    t = late.corrected_totals(project_records(spark, d))
    return t.select(F.col("key").alias("project_id"), _day("period_start").alias("event_day"), F.col("total_at_close").cast("bigint").alias("total_at_close"), F.col("total_final").cast("bigint").alias("total_final"), F.col("n_late").cast("bigint").alias("n_late"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(hierarchy.member_links(table(spark, d, "edges")))
    return h.select("node_id", "root_id", "depth")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(hierarchy.member_links(table(spark, d, "edges")), with_path=True)
    return h.select("node_id", "root_id", "depth", F.coalesce("n_descendants", F.lit(-1)).alias("n_descendants"), F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Of every node above others: how many lie below it, how many directly, and how deep the deepest."""
    h, _ = Scratch(spark, "nested").put(hierarchy.hierarchy(hierarchy.member_links(table(spark, d, "edges"))).select("node_id", "root_id", "depth", "lo", "hi"), "nested")
    below = hierarchy.descendants(h, h.select("node_id"))
    return below.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_descendants"), F.count(F.when(F.col("distance") == 1, 1)).alias("n_children"), F.max("distance").alias("height"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "intelligence_events")
    r = delivery.ranked_copies(e, key=F.col("idempotency_key"), arrived=F.col("recorded_at"), tie=F.col("line_no"))
    return r.filter(~F.col("keep")).select(F.col("tie").alias("line_no"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "intelligence_events").select("line_no", "idempotency_key", "recorded_at", "kind")
    return delivery.first_copies(e, key="idempotency_key", arrived="recorded_at", tie="line_no").select("line_no", "idempotency_key", "kind")


def p6_batch(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the later half of the journal that are stored, what the earlier half holds being stored already."""
    e = table(spark, d, "intelligence_events").select("line_no", "idempotency_key", "recorded_at")
    at = F.unix_micros("recorded_at")
    mid = e.agg(F.floor((F.min(at) + F.max(at)) / 2).alias("mid"))
    e = e.crossJoin(F.broadcast(mid)).withColumn("old", F.coalesce(at < F.col("mid"), F.lit(False))).drop("mid")  # one number
    fresh = delivery.first_copies(e.filter("not old"), key="idempotency_key", arrived="recorded_at", tie="line_no", stored=e.filter("old"))
    return fresh.select("line_no", "idempotency_key")


def edge_ends(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    ends = F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("node_id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("node_id"))))
    return e.select(ends.alias("e"), F.col("id").alias("edge_id"), "confidence").select("e.side", "e.node_id", "edge_id", "confidence")


def p7_stats(spark: SparkSession, d: str) -> DataFrame:
    s = skew.degree_stats(edge_ends(spark, d))
    return s.select("side", "node_id", "n_edges", F.round("mean_confidence", 6).alias("mean_confidence"), "min_confidence", "max_confidence")


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    """Per end and in order of edge: the longest run of one provenance, and the first and last edge."""
    e = table(spark, d, "edges")
    ends = F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("node_id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("node_id"))))
    rows = e.select(ends.alias("e"), F.col("id").alias("edge_id"), "provenance").select("e.side", "e.node_id", "edge_id", "provenance")
    return skew.run_stats(rows, ["side", "node_id"], ["edge_id"], "provenance").select("side", "node_id", F.col("n_rows").alias("n_edges"), "longest_run", F.col("head").alias("first_edge"), F.col("tail").alias("last_edge"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    s = skew.degree_stats(edge_ends(spark, d))
    total = table(spark, d, "edges").agg(F.count(F.lit(1)).alias("total"))
    # one row of one number: the only cross join here
    return s.crossJoin(F.broadcast(total)).filter(F.col("n_edges") * 100 >= F.col("total")).select("side", "node_id")


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_totals": p2_totals, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants,
    "p6_found": p6_found, "p6_kept": p6_kept, "p6_batch": p6_batch, "p7_found": p7_found, "p7_stats": p7_stats, "p7_runs": p7_runs,
}

_READ = "try_cast(case when regexp_matches({0}, '(Z|[+-]\\d\\d:\\d\\d)$') then {0} else {0} || 'Z' end as timestamptz)"
_MESSAGES = f"""
  select idempotency_key k, identity.project_id project, json_extract_string(payload, '$.subject') subject,
         {_READ.format('occurred_at')} occurred, recorded_at arrived, line_no,
         row_number() over (partition by idempotency_key order by recorded_at, line_no) n
  from intelligence_events where trim(coalesce(idempotency_key, '')) <> ''"""
_TOTALS = f"""
  with m as ({_MESSAGES}), r as (
    select project, occurred, arrived, cast(date_trunc('day', occurred at time zone 'UTC') as date) as day
    from m where n = 1 and project is not null and occurred is not null and arrived is not null),
  c as (select *, arrived at time zone 'UTC' < cast(day as timestamp) + interval 30 hour as in_time from r where arrived <= occurred + interval 72 hour)
  select project as project_id, strftime(day, '%Y-%m-%d') as event_day, count(*) filter (in_time) as total_at_close,
         count(*) as total_final, count(*) filter (not in_time) as n_late
  from c group by project, day"""

SQL = {
    "p1_found": f"""
  with m as ({_MESSAGES}),
  a as (select id, subject_ref, json_extract_string(assertion_json, '$.validAt') v, json_extract_string(assertion_json, '$.knownAt') k,
               cast(json_extract(assertion_json, '$.supportedBy') as varchar[]) s
        from memory_graph_assertions where predicate = 'part-of' and json_valid(assertion_json)),
  g as (select a.id, a.subject_ref, a.v, a.k, min(case when c.id = a.s[1] then c.valid_at end) sv, max(c.known_at) sk
        from a left join capture_sources c on list_contains(a.s, c.id) group by all),
  t as (select id, subject_ref, case when v is null then sv else {_READ.format('v')} end valid_at,
               case when k is null then sk else {_READ.format('k')} end known_at from g),
  j as (select m.k idempotency_key, t.id assertion_id, row_number() over (partition by m.k order by valid_at desc, known_at desc, t.id) n
        from m join t on t.subject_ref = m.subject and t.valid_at <= m.occurred and t.known_at <= m.occurred
        where m.n = 1 and m.subject is not null and m.occurred is not null)
  select idempotency_key, assertion_id from j where n = 1""",
    "p2_found": f"select project_id, event_day from ({_TOTALS}) where n_late > 0",
    "p2_totals": _TOTALS,
    "p5_found": """
  with recursive l as (select src, min(dst) dst from edges where lower(trim(rel)) = 'member-of' and src is not null and dst is not null group by src),
  e as (select src id from l union select dst from l),
  t as (select id, id as root, 0 as depth from e where id not in (select src from l)
        union all select l.src, t.root, t.depth + 1 from t join l on l.dst = t.id)
  select e.id as node_id, coalesce(t.root, 'cycle') as root_id, coalesce(t.depth, -1) as depth from e left join t using (id)""",
    "p5_hierarchy": """
  with recursive l as (select src, min(dst) dst from edges where lower(trim(rel)) = 'member-of' and src is not null and dst is not null group by src),
  e as (select src id from l union select dst from l),
  t as (select id, id as root, 0 as depth, id as path from e where id not in (select src from l)
        union all select l.src, t.root, t.depth + 1, t.path || ' > ' || l.src from t join l on l.dst = t.id),
  up as (select id, id as above from t union all select up.id, l.dst from up join l on l.src = up.above),
  n as (select above as id, count(*) - 1 as n from up group by above)
  select e.id as node_id, coalesce(t.root, 'cycle') as root_id, coalesce(t.depth, -1) as depth,
         coalesce(n.n, -1) as n_descendants, t.path as path
  from e left join t using (id) left join n using (id)""",
    "p5_descendants": """
  with recursive l as (select src, min(dst) dst from edges where lower(trim(rel)) = 'member-of' and src is not null and dst is not null group by src),
  t as (select dst as id from l where dst not in (select src from l) union select l.src from t join l on l.dst = t.id),
  up as (select l.src as id, l.dst as above, 1 as distance from l where src in (select id from t) union all select up.id, l.dst, up.distance + 1 from up join l on l.src = up.above)
  select above as node_id, count(*) as n_descendants, count(*) filter (distance = 1) as n_children, max(distance) as height from up group by above""",
    "p6_found": """
  select line_no from (select line_no, row_number() over (partition by idempotency_key order by recorded_at nulls last, line_no) n
    from intelligence_events where trim(coalesce(idempotency_key, '')) <> '') where n > 1""",
    "p6_kept": """
  select line_no, idempotency_key, kind from (select *, row_number() over (partition by idempotency_key order by recorded_at nulls last, line_no) n
    from intelligence_events) where n = 1 or trim(coalesce(idempotency_key, '')) = ''""",
    "p6_batch": """
  with m as (select (epoch_us(min(recorded_at)) + epoch_us(max(recorded_at))) // 2 as mid from intelligence_events),
  e as (select line_no, idempotency_key, recorded_at, coalesce(epoch_us(recorded_at) < mid, false) as old, trim(coalesce(idempotency_key, '')) = '' as blank from intelligence_events, m)
  select line_no, idempotency_key from (select *, row_number() over (partition by idempotency_key order by recorded_at nulls last, line_no) n from e where not old and not blank
    and idempotency_key not in (select idempotency_key from e where old and idempotency_key is not null)) where n = 1
  union all select line_no, idempotency_key from e where not old and blank""",
    "p7_found": """
  with s as (select 'src' as side, src as node_id from edges union all select 'dst', dst from edges)
  select side, node_id from s where node_id is not null group by all having count(*) * 100 >= (select count(*) from edges)""",
    "p7_stats": """
  with s as (select 'src' as side, src as node_id, confidence c from edges union all select 'dst', dst, confidence from edges)
  select side, node_id, count(*) as n_edges, round(avg(c), 6) as mean_confidence, min(c) as min_confidence, max(c) as max_confidence
  from s where node_id is not null group by side, node_id""",
    "p7_runs": """
  with e as (select src, dst, id, provenance p, row_number() over () as t from edges),
  s as (select 'src' as side, src as node_id, id, p, t from e union all select 'dst', dst, id, p, t from e),
  o as (select *, row_number() over (partition by side, node_id order by id nulls first, p nulls first, t) a,
               row_number() over (partition by side, node_id, p order by id nulls first, t) b from s where node_id is not null),
  r as (select side, node_id, p, a - b as g, count(*) n from o group by all),
  m as (select side, node_id, max(n) longest_run from r group by all)
  select side, node_id, count(*) as n_edges, any_value(longest_run) as longest_run, min(id) as first_edge, max(id) as last_edge
  from o join m using (side, node_id) group by side, node_id""",
}
