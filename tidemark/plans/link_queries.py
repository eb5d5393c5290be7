"""Queries of linking and merging over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import linking, merging
from tidemark.sources import table


def _one(n):
    cols = [c for c in n.columns if c != "id"]
    return n.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in cols])


def explicit_link(spark, d):
    return linking.explicit_links(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "nodes"))


def identifier_link(spark, d):
    n = table(spark, d, "nodes")
    sections = table(spark, d, "documents").filter("doc_kind = 'doc-section' and text is not null").select(F.col("doc_id").alias("section_id"), "text")
    return linking.identifier_links(sections, n.filter("kind = 'symbol'"))


def _spans(n):
    return _one(n).filter("kind = 'symbol' and span_start is not null and span_end is not null").select(F.col("id").alias("span_id"), "file", F.col("span_start").alias("start"), F.col("span_end").alias("end"))


def _points(n):
    return _one(n).filter("kind in ('statement', 'condition', 'assignment', 'raise')").select(F.col("id").alias("point_id"), "file", F.col("span_start").alias("line")).dropna()


def enclosing_symbol(spark, d):
    n = table(spark, d, "nodes")
    return linking.enclosing(_points(n), _spans(n))


def majority_owner(spark, d):
    n = table(spark, d, "nodes")
    blame = _one(n).filter("span_start is not null").select("file", F.col("span_start").alias("line"), F.col("kind").alias("owner"))
    return linking.majority_owner(blame, _spans(n))


def longest_prefix(spark, d):
    n = table(spark, d, "nodes").filter("file is not null")
    top = n.select(F.regexp_extract("file", "^([^/]+)/", 1).alias("prefix")).filter("prefix <> ''").distinct()
    deep = n.filter("kind = 'route'").select(F.regexp_extract("file", "^([^/]+/[^/]+)/", 1).alias("prefix")).filter("prefix <> ''").distinct()
    return linking.longest_prefix(n, top.unionByName(deep))


def locator_reattach(spark, d):
    """Fields as if their ids were lost, looked for among the same fields under new ids and without their hashes."""
    n = _one(table(spark, d, "nodes"))
    lost = n.filter("kind = 'field'")
    away = n.filter("kind = 'field'").withColumn("id", F.concat(F.lit("new:"), F.col("id"))).withColumn("hash", F.lit("x"))
    return linking.relocate(lost, away)


def conflict_upsert(spark, d):
    return merging.upsert_edges(table(spark, d, "edges")).select("src", "dst", "rel", "id", "method", "provenance", "confidence", "n_derived")


def _states(spark, d):
    n = _one(table(spark, d, "nodes")).select("id", "hash", "kind", "lang")
    edit = lambda c, tag: F.when(c, F.concat("hash", F.lit(tag))).otherwise(F.col("hash"))
    ours = n.filter("kind <> 'raise'").withColumn("hash", edit(F.col("kind").isin("route", "cursor"), "-a"))
    theirs = n.filter("kind <> 'cursor'").withColumn("hash", edit((F.col("kind") == "route") & (F.col("lang") == "go") | (F.col("kind") == "raise"), "-b"))
    return n, ours, theirs


def merge3(spark, d):
    return merging.merge3(*_states(spark, d))


def merge3_edges(spark, d):
    """Edges as one side (static derivations raised) and the other (paths made certain) changed them."""
    e = table(spark, d, "edges").filter("id is not null and confidence is not null and provenance is not null and method is not null").groupBy("id").agg(F.min(F.struct("provenance", "confidence", "method")).alias("r")).select("id", "r.*")
    state = lambda p, c: e.withColumn("provenance", p).withColumn("confidence", c).withColumn("hash", F.concat_ws("|", F.col("provenance"), F.round(F.col("confidence"), 3).cast("string"))).withColumn("m", merging.merit())
    conf, prov = F.col("confidence"), F.col("provenance")
    ours = state(prov, F.when(F.col("method").isin("static", "semantic"), conf + 0.01).otherwise(conf)).filter("method <> 'explicit'")
    theirs = state(F.when(F.col("method") == "semantic", "EXTRACTED").otherwise(prov), F.when(F.col("method") == "static", conf + 0.02).otherwise(conf)).filter("method <> 'path'")
    return merging.merge3(state(prov, conf), ours, theirs, better="m").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("top"))


def delta_changes(spark, d):
    n, ours, _ = _states(spark, d)
    return merging.delta(n, ours)


def multiset_parity(spark, d):
    e = table(spark, d, "edges")
    side = lambda m: e.filter(F.col("method") == m).select(F.lower(F.trim("rel")).alias("rel"), "provenance")
    return merging.parity(side("static"), side("path"), ["rel", "provenance"])


def cochange(spark, d):
    """How often two projects have messages in one batch; batches of 2 to 20 projects."""
    b = table(spark, d, "intelligence_events").select("batch_id", F.col("identity.project_id").alias("p")).dropna().distinct()
    fit = b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).filter("n between 2 and 20").select("batch_id")
    b = b.join(fit, "batch_id")
    pairs = b.select("batch_id", F.col("p").alias("a")).join(b.select("batch_id", F.col("p").alias("b")), "batch_id").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))


def quote_grounding(spark, d):
    """Whether what a document quotes first in back quotes stands in the anchored node's signature or file."""
    docs = table(spark, d, "documents").select("doc_id", "anchor_id", F.regexp_extract("text", "`([^`]+)`", 1).alias("quote"))
    n = _one(table(spark, d, "nodes")).select(F.col("id").alias("anchor_id"), F.concat_ws(" ", "signature", "file", "name").alias("source"))
    return docs.join(n, "anchor_id").select("doc_id", T.grounded(F.col("quote"), F.col("source")).alias("verdict"))


def public_projection(spark, d):
    n = table(spark, d, "nodes").filter("kind = 'symbol'")
    return n.select("id", "name", "file", T.compact_signature(F.col("signature")).alias("signature"), T.slug(F.col("name")).alias("slug")).distinct()


QUERIES = {f.__name__: f for f in (explicit_link, identifier_link, enclosing_symbol, majority_owner, longest_prefix, locator_reattach, conflict_upsert, merge3, merge3_edges, delta_changes, multiset_parity, cochange, quote_grounding, public_projection)}

_ONE = "select id, min(kind) kind, min(file) file, min(name) name, min(qualified_name) qualified_name, min(signature) signature, min(anchor) anchor, min(hash) hash, min(lang) lang, min(span_start) span_start, min(span_end) span_end from nodes where id is not null group by id"
_METHOD = "case method when 'static' then 0 when 'explicit' then 1 when 'identifier' then 2 when 'path' then 3 when 'semantic' then 4 when 'inferred' then 5 else 6 end"
_N3 = f"""n as ({_ONE}), o as (select id, case when kind in ('route', 'cursor') then hash || '-a' else hash end as hash from n where kind <> 'raise'),
  t as (select id, case when kind = 'route' and lang = 'go' or kind = 'raise' then hash || '-b' else hash end as hash from n where kind <> 'cursor')"""

SQL = {
    "explicit_link": """with r as (select distinct doc_id, regexp_replace(unnest(regexp_extract_all(text, '`([^`\\n]+)`', 1)), '\\(\\)$', '') as ref from documents),
  q as (select qualified_name ref, min(id) id from nodes where qualified_name is not null group by 1), f as (select file ref, min(id) id from nodes where kind = 'file' group by 1),
  m as (select name ref, min(id) id from nodes where name is not null group by 1 having count(distinct id) = 1)
  select doc_id, r.ref, coalesce(q.id, f.id, m.id) as id, cast(0.95 as double) as confidence from r left join q using (ref) left join f using (ref) left join m using (ref) where coalesce(q.id, f.id, m.id) is not null""",
    "identifier_link": """with w as (select distinct doc_id as section_id, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) as name from documents where doc_kind = 'doc-section' and text is not null),
  h as (select distinct section_id, n.id, n.file from w join nodes n on n.name = w.name and n.kind = 'symbol' where length(w.name) >= 3 and n.file is not null and n.id is not null),
  c as (select section_id, id, count(*) over (partition by section_id, file) as n from h)
  select section_id, id, cast(case when max(n) >= 2 then 0.8 else 0.6 end as double) as confidence from c group by all""",
    "enclosing_symbol": f"""with n as ({_ONE}) select point_id, span_id from (select p.id as point_id, s.id as span_id, row_number() over (partition by p.id order by s.span_start desc, s.span_end, s.id) as k
  from n p join n s on p.file = s.file and p.span_start between s.span_start and s.span_end where s.kind = 'symbol' and p.kind in ('statement', 'condition', 'assignment', 'raise')) where k = 1""",
    "majority_owner": f"""with n as ({_ONE}), c as (select s.id as span_id, b.kind as owner, count(*) as n_lines from n s join n b on b.file = s.file and b.span_start between s.span_start and s.span_end where s.kind = 'symbol' group by all)
  select span_id, owner, n_lines from (select *, row_number() over (partition by span_id order by n_lines desc, owner) as k from c) where k = 1""",
    "longest_prefix": """with p as (select distinct regexp_extract(file, '^([^/]+)/', 1) as prefix from nodes union select distinct regexp_extract(file, '^([^/]+/[^/]+)/', 1) from nodes where kind = 'route'),
  f as (select distinct file from nodes where file is not null)
  select file, arg_max(prefix, length(prefix)) as prefix from f join p on prefix <> '' and starts_with(file, prefix || '/') group by file""",
    "locator_reattach": f"""with n as ({_ONE}), r as (select *, regexp_extract(file, '([^/]+)$', 1) as base from n where kind = 'field'),
  s as (select a.id as lost_id, 'new:' || b.id as id, 30 + case when a.qualified_name = b.qualified_name then 30 when a.name = b.name then 25 else 0 end + case when a.signature = b.signature then 15 else 0 end
     + case when a.file = b.file then 15 when a.base = b.base then 8 else 0 end + case when a.anchor = b.anchor then 10 else 0 end as score from r a join r b on a.name = b.name or a.base = b.base)
  select * from (select *, row_number() over (partition by lost_id order by score desc, id) as rank from s where score >= 50) where rank <= 8""",
    "conflict_upsert": f"""with e as (select *, lower(trim(rel)) as r from edges where src is not null and dst is not null and rel is not null)
  select src, dst, r as rel, id, method, provenance, confidence, n_derived from (select *, count(*) over (partition by src, dst, r) as n_derived,
    row_number() over (partition by src, dst, r order by provenance <> 'EXTRACTED', coalesce(confidence, -1) desc, {_METHOD}, id) as k from e) where k = 1""",
    "merge3": f"""with {_N3}, j as (select coalesce(n.id, o.id, t.id) id, n.hash b, o.hash o, t.hash t, n.id is not null hb, o.id is not null ho, t.id is not null ht from n full join o on n.id = o.id full join t on coalesce(n.id, o.id) = t.id),
  k as (select id, b, o, t, ho, case when not ho and not ht then 'deleted' when not ho then case when b is not distinct from t then 'deleted' else 'kept-theirs' end
    when not ht then case when b is not distinct from o then 'deleted' else 'kept-ours' end when o is not distinct from t then case when b is not distinct from o then 'same' else 'both' end
    when b is not distinct from o then 'theirs' when b is not distinct from t then 'ours' else 'conflict' end as outcome from j)
  select id, case when outcome in ('theirs', 'kept-theirs') then t when ho then o else t end as hash, outcome from k where outcome <> 'deleted'""",
    "merge3_edges": """with e as (select id, r.p, r.c, r.m from (select id, min(struct_pack(p := provenance, c := confidence, m := method)) r from edges where id is not null and confidence is not null and provenance is not null and method is not null group by id)),
  s as (select id, m, p as bp, c as bc, p as op, case when m in ('static', 'semantic') then c + 0.01 else c end as oc, case when m = 'semantic' then 'EXTRACTED' else p end as tp, case when m = 'static' then c + 0.02 else c end as tc,
          coalesce(m <> 'explicit', false) as ho, coalesce(m <> 'path', false) as ht from e),
  h as (select *, concat_ws('|', bp, cast(round(bc, 3) as varchar)) b, concat_ws('|', op, cast(round(oc, 3) as varchar)) o, concat_ws('|', tp, cast(round(tc, 3) as varchar)) t from s),
  k as (select *, case when not ho and not ht then 'deleted' when not ho then case when b = t then 'deleted' else 'kept-theirs' end when not ht then case when b = o then 'deleted' else 'kept-ours' end
      when o = t then case when b = o then 'same' else 'both' end when b = o then 'theirs' when b = t then 'ours' else 'resolved' end as outcome from h),
  v as (select *, case when outcome in ('theirs', 'kept-theirs') then t
      when outcome = 'resolved' and ((coalesce(tp, '') <> 'EXTRACTED') < (coalesce(op, '') <> 'EXTRACTED') or (coalesce(tp, '') <> 'EXTRACTED') = (coalesce(op, '') <> 'EXTRACTED') and coalesce(tc, -1) > coalesce(oc, -1)) then t else o end as hash from k where outcome <> 'deleted')
  select outcome, count(*) as n, max(hash) as top from v group by outcome""",
    "delta_changes": f"with {_N3} select n.id, case when o.id is null then 'removed' else 'changed' end as change from n left join o using (id) where o.id is null or n.hash is distinct from o.hash",
    "multiset_parity": """with l as (select lower(trim(rel)) rel, provenance, count(*) c from edges where method = 'static' group by all), r as (select lower(trim(rel)) rel, provenance, count(*) c from edges where method = 'path' group by all)
  select coalesce(l.rel, r.rel) as rel, coalesce(l.provenance, r.provenance) as provenance, least(coalesce(l.c, 0), coalesce(r.c, 0)) as matched, greatest(coalesce(l.c, 0) - coalesce(r.c, 0), 0) as only_left,
    greatest(coalesce(r.c, 0) - coalesce(l.c, 0), 0) as only_right from l full join r on l.rel = r.rel and l.provenance is not distinct from r.provenance""",
    "cochange": """with b as (select distinct batch_id, identity.project_id p from intelligence_events where batch_id is not null and identity.project_id is not null), f as (select batch_id from b group by 1 having count(*) between 2 and 20),
  g as (select * from b where batch_id in (select batch_id from f)) select x.p as a, y.p as b, count(*) as support from g x join g y on x.batch_id = y.batch_id and x.p < y.p group by all""",
    "quote_grounding": f"""with n as ({_ONE}), q as (select doc_id, anchor_id, trim(regexp_replace(regexp_extract(text, '`([^`]+)`', 1), '\\s+', ' ', 'g')) quote from documents)
  select doc_id, case when coalesce(quote, '') = '' then 'unsupported' when contains(trim(regexp_replace(concat_ws(' ', signature, file, name), '\\s+', ' ', 'g')), quote) then 'grounded' else 'ungrounded' end as verdict from q join n on n.id = q.anchor_id""",
    "public_projection": """select distinct id, name, file, substring(trim(regexp_replace(regexp_replace(regexp_replace(signature, '/\\*.*?\\*/', ' ', 'gs'), '//[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g')), 1, 240) as signature,
  regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from nodes where kind = 'symbol'""",
}
