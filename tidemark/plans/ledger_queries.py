"""Queries of the evidence ledger and of the reports over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.times import blank, iso_micros
from tidemark.operators import ledger, reports, skew
from tidemark.plans import graph_queries
from tidemark.sources import table

#: The instant at which the journal and the ledger are read.
NOW = 1_615_766_400_000_000  # 2021-03-15T00:00:00Z


def _events(spark, d):
    e = table(spark, d, "intelligence_events").filter(~blank(F.col("idempotency_key")))
    first = F.min_by(F.struct("line_no", "kind", "sensitivity", "payload", "source", "identity", "retention", "occurred_at", "recorded_at"), F.struct(F.col("recorded_at").isNull(), "recorded_at", "line_no"))
    e = e.groupBy("idempotency_key").agg(first.alias("r")).select("r.*")
    return e.select("line_no", "kind", "sensitivity", "payload", "retention", F.col("source.session_id").alias("session"), F.col("identity.project_id").alias("project"), iso_micros(F.col("occurred_at")).alias("at"), F.unix_micros("recorded_at").alias("arrived"),
                    F.try_variant_get(F.try_parse_json("payload"), "$.subject", "string").alias("entity"))


def _a(spark, d):
    return ledger.assertions(table(spark, d, "memory_graph_assertions"))


def asof_history(spark, d):
    return ledger.as_of(_a(spark, d), NOW)


def valid_time(spark, d):
    w = ledger.valid_windows(_a(spark, d))
    return w.select("id", ledger.holds(F.col("valid_from"), F.col("valid_to"), F.lit(NOW)).alias("holds"), ledger.window_shape(F.col("valid_from"), F.col("valid_to")).alias("shape"))


def conflict_groups(spark, d):
    return ledger.conflict_groups(_a(spark, d))


def contradictions(spark, d):
    return ledger.contradictions(_a(spark, d))


def supported_assertions(spark, d):
    return ledger.supported(_a(spark, d), table(spark, d, "capture_sources"))


def alias_canonical(spark, d):
    a = _a(spark, d).filter("predicate in ('supersedes', 'derived-from')")
    return ledger.alias_canonical(a.select(F.col("subject").alias("src"), F.col("object").alias("dst")))


def verdict_overlay(spark, d):
    return ledger.believed(ledger.decisions(_events(spark, d)))


def decision_conflicts(spark, d):
    return ledger.decision_conflicts(ledger.decisions(_events(spark, d)))


def net_feedback(spark, d):
    return ledger.net_feedback(_events(spark, d))


def recall_order(spark, d):
    """Subjects with a current assertion that nothing excludes, by feedback, then time, then name."""
    cur = ledger.as_of(_a(spark, d), NOW).filter("predicate = 'part-of'").select("subject", "id", "valid_at")
    j = cur.join(verdict_overlay(spark, d), "subject", "left").join(net_feedback(spark, d), "subject", "left")
    out = ledger.exclusion(F.lit(True), F.lit(True), F.col("valid_at") > NOW - 30 * 86_400_000_000, F.coalesce("lifecycle", F.lit("active")) == "active", F.col("quarantined"))
    j = j.withColumn("excluded", out)
    order = [-F.coalesce("net", F.lit(0)), -F.col("valid_at"), F.col("subject")]
    j = j.select("subject", "id", "net", "valid_at", F.coalesce("excluded", F.lit("recalled")).alias("part"))
    return skew.numbered(j, ["part"], order, "place").select("subject", "id", "part", "place")


def ttl_filter(spark, d):
    e = _events(spark, d)
    return e.filter(~ledger.expired(F.col("at"), F.col("retention.expires_after_days"), F.col("retention.pinned"), NOW)).select("line_no")


def payload_scrub(spark, d):
    e = _events(spark, d).filter("payload is not null")
    return e.select("line_no", F.array_join(F.array_sort(F.map_keys(ledger.scrub(F.col("payload")))), ",").alias("keys"))


def session_projection(spark, d):
    return ledger.session_projection(_events(spark, d), NOW)


def handoff(spark, d):
    return ledger.last_other_session(_events(spark, d))


def kind_stats(spark, d):
    e = table(spark, d, "intelligence_events")
    size = F.try_variant_get(F.try_parse_json("payload"), "$.size", "bigint")
    return e.select("kind", size.alias("s")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), F.min("s").alias("least"), F.max("s").alias("most"))


def fingerprint(spark, d):
    n = table(spark, d, "nodes")
    return n.groupBy("kind").agg(F.concat_ws(":", F.count(F.lit(1)), F.max("id")).alias("fingerprint"))


def callable_coverage(spark, d):
    return reports.callable_coverage(table(spark, d, "nodes"), table(spark, d, "edges"))


def gaps(spark, d):
    return reports.gaps(table(spark, d, "nodes"), table(spark, d, "edges"))


def functional_map(spark, d):
    return reports.functional_map(table(spark, d, "nodes"), table(spark, d, "edges"))


def decision_rules(spark, d):
    return reports.decision_rules(table(spark, d, "edges"))


def owner_module(spark, d):
    return reports.owner_module(table(spark, d, "nodes"))


def cluster_digest(spark, d):
    return reports.cluster_digest(table(spark, d, "nodes"))


def graph_stats(spark, d):
    return reports.graph_stats(table(spark, d, "nodes"), table(spark, d, "edges"))


def recursion_stamp(spark, d):
    return reports.recursion(table(spark, d, "edges"))


def basic_blocks(spark, d):
    return reports.basic_blocks(table(spark, d, "nodes"))


def file_category(spark, d):
    return reports.file_category(table(spark, d, "nodes"))


QUERIES = {f.__name__: f for f in (asof_history, valid_time, conflict_groups, contradictions, supported_assertions, alias_canonical, verdict_overlay, decision_conflicts, net_feedback, recall_order, ttl_filter, payload_scrub, session_projection, handoff, kind_stats, fingerprint, callable_coverage, gaps, functional_map, decision_rules, owner_module, cluster_digest, graph_stats, recursion_stamp, basic_blocks, file_category)}

_T = "epoch_us(try_cast(case when regexp_matches({0}, '(Z|[+-]\\d\\d:\\d\\d)$') then {0} else {0} || 'Z' end as timestamptz))"
_A = f"""select id, min(subject_ref) subject, min(object_ref) object, min(predicate) predicate, min({_T.format("json_extract_string(assertion_json, '$.validAt')")}) valid_at,
  min({_T.format("json_extract_string(assertion_json, '$.knownAt')")}) known_at, min(cast(json_extract(assertion_json, '$.supportedBy') as varchar[])) s from memory_graph_assertions where id is not null and json_valid(assertion_json) group by id"""
_EV = f"""select line_no, kind, sensitivity, payload, retention, source.session_id session, identity.project_id project, {_T.format('occurred_at')} as occ, epoch_us(recorded_at) arrived, json_extract_string(payload, '$.subject') entity
  from (select *, row_number() over (partition by idempotency_key order by recorded_at nulls last, line_no) k from intelligence_events where trim(coalesce(idempotency_key, '')) <> '') where k = 1"""
_DEC = f"""select entity as subject, project as successor, case sensitivity when 'internal' then 'supersede' when 'public' then 'accept' when 'confidential' then 'quarantine' when 'restricted' then 'retract' end as decision
  from ({_EV}) where entity is not null and sensitivity in ('internal', 'public', 'confidential', 'restricted')"""
_BEL = f"""select subject, case when bool_or(decision = 'retract') then 'retracted' when bool_or(decision = 'supersede') then 'superseded' else 'active' end as lifecycle, bool_or(decision = 'quarantine') as quarantined, count(*) as n from ({_DEC}) group by subject"""
_NET = f"""select entity as subject, cast(greatest(least(sum(case when kind = 'memory.observed' then 1 else -1 end), 3), -3) as int) as net from ({_EV}) where entity is not null and kind in ('memory.observed', 'mcp.tool-invoked', 'file.changed') group by 1"""
_ASOF = f"""select subject, predicate, id, object, valid_at, known_at from (select *, row_number() over (partition by subject, predicate order by valid_at desc, known_at desc, id) as k from ({_A}) where valid_at <= {NOW} and known_at <= {NOW}) where k = 1"""
_E = "select distinct src, dst, lower(trim(rel)) as rel from edges where src is not null and dst is not null and rel is not null"
_N = "select id, min(kind) kind, min(file) file, min(cluster_id) cluster_id, min(span_start) span_start, min(name) as name, min(node_type) node_type from nodes where id is not null group by id"

SQL = {
    "asof_history": _ASOF,
    "valid_time": f"""select id, valid_at <= {NOW} and (nxt is null or {NOW} < nxt) as holds, case when nxt <= valid_at then 'inverted' else 'valid' end as shape
  from (select *, lead(valid_at) over (partition by subject, predicate order by valid_at, id) as nxt from ({_A}) where valid_at is not null)""",
    "conflict_groups": f"select subject, predicate, valid_at, count(distinct object) as n_objects, min(id) as first_id from ({_A}) where predicate not in ('supported-by', 'affects', 'contradicts') and valid_at is not null group by all having count(distinct object) >= 2",
    "contradictions": f"select least(subject, object) as a, greatest(subject, object) as b, count(*) as n from ({_A}) where predicate = 'contradicts' group by all",
    "supported_assertions": f"with a as ({_A}), u as (select id, unnest(s) as src from a) select a.id, count(u.src) as n_supporters, count(c.id) as n_found from a left join u using (id) left join (select distinct id from capture_sources) c on c.id = u.src group by a.id",
    "verdict_overlay": _BEL,
    "decision_conflicts": f"""select subject, count(*) filter (decision = 'retract') as n_retract, count(*) filter (decision = 'supersede') as n_supersede, count(distinct successor) filter (decision = 'supersede') as n_successors from ({_DEC}) group by subject
  having (n_retract > 0 and n_supersede > 0) or n_successors > 1""",
    "net_feedback": _NET,
    "recall_order": f"""with c as (select subject, id, valid_at from ({_ASOF}) where predicate = 'part-of'),
  j as (select c.*, coalesce(net, 0) as net, case when valid_at <= {NOW} - 30 * 86400000000 then 'applicability' when coalesce(lifecycle, 'active') <> 'active' then 'lifecycle' when quarantined then 'quarantined' else 'recalled' end as part
        from c left join ({_BEL}) b using (subject) left join ({_NET}) n using (subject))
  select subject, id, part, row_number() over (partition by part order by net desc, valid_at desc, subject) as place from j""",
    "ttl_filter": f"select line_no from ({_EV}) where coalesce(retention.pinned, false) or not coalesce(occ + retention.expires_after_days * 86400000000 <= {NOW}, true)",
    "payload_scrub": f"select line_no, array_to_string(list_sort(list_filter(json_keys(payload), lambda k: not regexp_matches(k, '(?i)(secret|token|password|path)'))), ',') as keys from ({_EV}) where payload is not null",
    "session_projection": f"""with e as ({_EV}), g as (select session, arg_max(kind, (arrived, line_no)) as last_kind, arg_max(line_no, (arrived, line_no)) as last_line, count(*) as n, array_to_string(list_sort(list(distinct kind)), ',') as kinds,
    cast(floor(({NOW} - max(arrived)) / 86400000000.0) as bigint) as idle_days from e where session is not null group by session) select *, idle_days >= 14 as stale from g""",
    "handoff": f"""with s as (select project, session, min(arrived) first from ({_EV}) where session is not null and project is not null group by all)
  select project, session, lag(session) over (partition by project order by first, session) as other_session from s""",
    "kind_stats": "select kind, count(*) as n, cast(sum(s) as bigint) as total, min(s) as least, max(s) as most from (select kind, cast(json_extract(payload, '$.size') as bigint) as s from intelligence_events) group by kind",
    "fingerprint": "select kind, count(*) || ':' || max(id) as fingerprint from nodes group by kind",
    "callable_coverage": f"""with n as ({_N}), c as (select e.dst as id, count(*) filter (k = 'statement') n_statements, count(*) filter (k = 'raise') n_raises, count(*) filter (k = 'cursor') n_cursors, count(*) filter (k = 'condition') n_conditions,
    count(*) filter (k = 'exception-handler') n_handlers, count(*) filter (k = 'assignment') n_assignments from ({_E}) e join (select id, kind k from n) m on m.id = e.src where rel = 'member-of' group by 1),
  j as (select n.id, coalesce(n_statements, 0) n_statements, coalesce(n_raises, 0) n_raises, coalesce(n_cursors, 0) n_cursors, coalesce(n_conditions, 0) n_conditions, coalesce(n_handlers, 0) n_handlers, coalesce(n_assignments, 0) n_assignments
    from n left join c using (id) where kind = 'symbol')
  select *, case when n_statements + n_assignments > 0 and n_conditions > 0 then 'complete' when n_statements + n_assignments + n_conditions + n_cursors > 0 then 'partial' else 'unimplemented' end as readiness from j""",
    "gaps": f"""with n as ({_N}), e as ({_E})
  select distinct dst as id, 'unresolved-call' as gap from e where rel = 'calls' and dst not in (select id from n)
  union all select id, 'executes-nothing' from n where kind = 'symbol' and id not in (select src from e where rel = 'executes')
  union all select id, 'route-without-call' from n where kind = 'route' and id not in (select src from e where rel = 'calls')
  union all select id, 'loose-statement' from n where kind = 'statement' and id not in (select src from e where rel = 'member-of')""",
    "functional_map": f"""with n as ({_N}), i as ({graph_queries._IMP}),
  j as (select n.*, split_part(file, '/', 1) as module, coalesce(importance, 0) as s from n left join i on i.node_id = n.id where file is not null)
  select module, count(*) filter (kind = 'file') as n_files, count(*) filter (kind = 'symbol') as n_symbols, count(*) filter (kind = 'route') as n_routes, count(*) filter (kind = 'doc-section') as n_docs,
    cast(round(sum(s), 4) as double) as importance, min_by(id, (-s, id)) as top_id from j group by module""",
    "cluster_digest": f"""with n as (select cluster_id, id, coalesce(hash, '') h from ({_N.replace('min(kind) kind,', 'min(kind) kind, min(hash) hash,')}) where cluster_id is not null),
  p as (select cluster_id, substr(md5(id), 1, 2) b, sha256(string_agg(id || '|' || h, chr(10) order by id || '|' || h)) d, count(*) n from n group by all)
  select cluster_id, cast(sum(n) as bigint) as n_members, sha256(string_agg(b || '|' || d, chr(10) order by b || '|' || d)) as digest from p group by cluster_id""",
    "decision_rules": """select distinct src, dst as action, lower(trim(rel)) as rel, array_to_string(cfg_path, ';') as conditions, cfg_path[-1] as innermost, coalesce(branch, '') as polarity, coalesce(in_loop, false) as in_loop
  from edges where cfg_path is not null and src is not null and dst is not null and lower(trim(rel)) in ('calls', 'executes')""",
    "owner_module": f"""with c as (select cluster_id, split_part(file, '/', 1) as module, count(*) n from ({_N}) where cluster_id is not null and file is not null group by all)
  select cluster_id, module, n from (select *, row_number() over (partition by cluster_id order by n desc, module) k from c) where k = 1""",
    "graph_stats": f"select 'node' as what, kind as name, count(*) as n from ({_N}) group by kind union all select 'edge', rel, count(*) from ({_E}) group by rel",
    "recursion_stamp": f"select distinct src as id from ({_E}) where rel = 'calls' and src = dst",
    "basic_blocks": f"""with b as (select file, kind, span_start, sum(case when kind in ('condition', 'exception-handler') then 1 else 0 end) over (partition by file order by span_start, id rows unbounded preceding) as block
    from ({_N}) where kind in ('statement', 'assignment', 'raise', 'condition', 'exception-handler') and file is not null and span_start is not null)
  select file, cast(block as bigint) as block, min(span_start) as start, max(span_start) as "end", count(*) as n from b where kind not in ('condition', 'exception-handler') group by file, block""",
    "file_category": r"""select case when regexp_matches(file, '(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$') then 'tests' when regexp_matches(file, '(^|/)fixtures?/') then 'fixtures' else 'project' end as category, count(*) as n
  from (select distinct file from nodes where kind = 'file' and file is not null) group by 1""",
}

SQL["alias_canonical"] = graph_queries.components_sql(f"select subject as src, object as dst from ({_A}) where predicate in ('supersedes', 'derived-from')")
