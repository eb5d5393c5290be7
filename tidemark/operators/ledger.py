"""Evidence ledgers over two times: what held when, what was believed when, conflicts, folds and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, iso_micros
from tidemark.operators import graph, skew

# fixed values: predicates of which a subject may have many at once, and the others that conflict
MULTI_VALUED = ("supported-by", "affects", "contradicts")


def assertions(raw: DataFrame) -> DataFrame:
    """id, subject, object, predicate, valid_at, known_at, supported_by, parsed from JSON; one row an id.

    Rows whose JSON does not parse are left out; unreadable times are null.
    """
    g = lambda p, t="string": F.try_variant_get("j", p, t)
    a = raw.filter("id is not null").select("id", F.col("subject_ref").alias("subject"), F.col("object_ref").alias("object"), "predicate", F.try_parse_json("assertion_json").alias("j")).filter("j is not null")
    a = a.select("id", "subject", "object", "predicate", iso_micros(g("$.validAt")).alias("valid_at"), iso_micros(g("$.knownAt")).alias("known_at"), g("$.supportedBy", "array<string>").alias("supported_by"))
    cols = [c for c in a.columns if c != "id"]
    return a.groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*")


def valid_windows(a: DataFrame) -> DataFrame:
    """``a`` with valid_from and valid_to: until the next assertion of the same subject and predicate, open at the end."""
    timed = a.filter("valid_at is not null").withColumn("valid_from", F.col("valid_at"))
    return skew.following(timed, ["subject", "predicate"], [F.col("valid_at"), F.col("id")], "valid_at", "valid_to")


def holds(start: Column, end: Column, at: Column) -> Column:
    """Half-open: from <= t < to; an open end holds, an unreadable start does not."""
    return F.coalesce((start <= at) & (end.isNull() | (at < end)), F.lit(False))


def window_shape(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), "unparseable").when(end.isNotNull() & (end <= start), "inverted").otherwise("valid")


def as_of(a: DataFrame, instant: int) -> DataFrame:
    """The assertion of each subject and predicate that was valid and known at an instant; ties to the least id."""
    seen = a.filter((F.col("valid_at") <= instant) & (F.col("known_at") <= instant))
    merit = F.struct((-F.col("valid_at")).alias("v"), (-F.col("known_at")).alias("k"), "id")
    return seen.groupBy("subject", "predicate").agg(F.min_by(F.struct("id", "object", "valid_at", "known_at"), merit).alias("w")).select("subject", "predicate", "w.*")


def conflict_groups(a: DataFrame) -> DataFrame:
    """subject, predicate, valid_at, n_objects of single-valued assertions that name several objects for one time."""
    one = a.filter(~F.col("predicate").isin(*MULTI_VALUED) & F.col("valid_at").isNotNull())
    return one.groupBy("subject", "predicate", "valid_at").agg(F.countDistinct("object").alias("n_objects"), F.min("id").alias("first_id")).filter("n_objects >= 2")


def contradictions(a: DataFrame) -> DataFrame:
    """a < b, n: subjects and objects joined by 'contradicts' in either direction, one group a pair."""
    c = a.filter("predicate = 'contradicts'")
    return c.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def supported(a: DataFrame, sources: DataFrame) -> DataFrame:
    """id, n_supporters, n_found: how many of an assertion's supporters are known; none may be."""
    by = a.select("id", F.explode_outer("supported_by").alias("source"))
    known = sources.select(F.col("id").alias("source"), F.lit(1).alias("k")).filter("source is not null").distinct()
    return by.join(known, "source", "left").groupBy("id").agg(F.count("source").alias("n_supporters"), F.count("k").alias("n_found"))


def alias_links(decisions: DataFrame) -> DataFrame:
    """src, dst of the aliases in force: of each pair (entity_a, entity_b, either way round) the latest decision counts.

    ``decisions``: id, kind ('establish' or 'reverse'), entity_a, entity_b, at.  Ties in time go to the greatest id.
    """
    pair = [F.least("entity_a", "entity_b").alias("src"), F.greatest("entity_a", "entity_b").alias("dst")]
    d = decisions.filter("entity_a is not null and entity_b is not null and entity_a <> entity_b and kind in ('establish', 'reverse')")
    return d.groupBy(*pair).agg(F.max_by("kind", F.struct("at", "id")).alias("kind")).filter("kind = 'establish'").select("src", "dst")


def alias_canonical(links: DataFrame) -> DataFrame:
    """node_id, component: the least name of each group of aliases (src, dst); established by any chain of links."""
    return graph.components(links.select("src", "dst", F.lit("alias").alias("rel")))


def current(a: DataFrame, instant: int) -> DataFrame:
    """Assertions known and valid at an instant, and not past the next of the same subject and predicate by then."""
    seen = a.filter((F.col("known_at") <= instant) & (F.col("valid_at") <= instant))
    return seen.filter(F.col("predicate").isin(*MULTI_VALUED)).unionByName(seen.filter(~F.col("predicate").isin(*MULTI_VALUED)).join(as_of(a, instant).select("id"), "id", "left_semi"))


def relations_among(a: DataFrame, refs: DataFrame, instant: int) -> DataFrame:
    """id, subject, predicate, object of current assertions with both ends among ``refs`` (column ref)."""
    r = refs.select("ref").distinct()
    return current(a, instant).join(r.select(F.col("ref").alias("subject")), "subject", "left_semi").join(r.select(F.col("ref").alias("object")), "object", "left_semi").select("id", "subject", "predicate", "object")


def adjacency(a: DataFrame, instant: int) -> DataFrame:
    """ref, n_out, n_in, n_neighbours over current assertions; loops count both ways, partial sums keep hubs cheap."""
    c = current(a, instant).select("subject", "object").dropna()
    ends = c.select(F.col("subject").alias("ref"), F.col("object").alias("other"), F.lit(1).alias("o")).unionByName(c.select(F.col("object").alias("ref"), F.col("subject").alias("other"), F.lit(0).alias("o")))
    return ends.groupBy("ref", "other").agg(F.sum("o").alias("o"), F.sum(1 - F.col("o")).alias("i")).groupBy("ref").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count(F.lit(1)).alias("n_neighbours"))


def superseded_by(a: DataFrame) -> DataFrame:
    """ref, n, latest_id, latest_subject: what supersedes a thing, the latest of it; ties of time to the least id."""
    s = a.filter("predicate = 'supersedes' and object is not null")
    merit = F.struct((-F.coalesce("valid_at", F.lit(0))).alias("t"), "id")
    g = s.groupBy(F.col("object").alias("ref")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "subject"), merit).alias("b"))
    return g.select("ref", "n", F.col("b.id").alias("latest_id"), F.col("b.subject").alias("latest_subject"))


def timeline(a: DataFrame) -> DataFrame:
    """id, subject, place, next_id: every assertion of a subject in order of time, then id; nothing is folded."""
    t = a.filter("subject is not null and valid_at is not null").select("id", "subject", "valid_at")
    order = [F.col("valid_at"), F.col("id")]
    return skew.following(skew.numbered(t, ["subject"], order, "place"), ["subject"], order, "id", "next_id").select("id", "subject", "place", "next_id")


def provenance_counts(a: DataFrame, sources: DataFrame, instant: int) -> DataFrame:
    """repo, n_considered, n_current, n_supported of assertions by the repository of their first supporter."""
    src = sources.filter("id is not null").groupBy(F.col("id").alias("source")).agg(F.min("repo_id").alias("repo"))
    now = current(a, instant).select("id", F.lit(1).alias("now"))
    first = a.select("id", F.get("supported_by", F.lit(0)).alias("source"), F.coalesce(F.size("supported_by"), F.lit(0)).alias("n"))
    j = first.join(src, "source", "left").join(now, "id", "left")
    return j.groupBy("repo").agg(F.count(F.lit(1)).alias("n_considered"), F.count("now").alias("n_current"), F.count(F.when(F.col("n") > 0, 1)).alias("n_supported"))


#: What a message decides about its subject, by its sensitivity; the tables hold no decisions of their own.
DECISIONS = {"internal": "supersede", "public": "accept", "confidential": "quarantine", "restricted": "retract"}
SIGNALS = {"memory.observed": 1, "mcp.tool-invoked": -1, "file.changed": -1}


def decisions(events: DataFrame) -> DataFrame:
    """subject, decision, successor, at of the first delivery of every message that decides about a subject."""
    d = F.lit(None).cast("string")
    for kind, v in DECISIONS.items():
        d = F.when(F.col("sensitivity") == kind, v).otherwise(d)
    return events.select(F.col("entity").alias("subject"), d.alias("decision"), F.col("project").alias("successor"), "at").filter("subject is not null and decision is not null")


def believed(d: DataFrame) -> DataFrame:
    """subject, lifecycle, quarantined, n: retracted for good, else superseded, else active; any quarantine counts."""
    g = d.groupBy("subject").agg(F.bool_or(F.col("decision") == "retract").alias("r"), F.bool_or(F.col("decision") == "supersede").alias("s"), F.bool_or(F.col("decision") == "quarantine").alias("quarantined"), F.count(F.lit(1)).alias("n"))
    return g.select("subject", F.when(F.col("r"), "retracted").when(F.col("s"), "superseded").otherwise("active").alias("lifecycle"), "quarantined", "n")


def decision_conflicts(d: DataFrame) -> DataFrame:
    """Subjects both retracted and superseded, or superseded by several successors."""
    g = d.groupBy("subject").agg(F.count_if(F.col("decision") == "retract").alias("n_retract"), F.count_if(F.col("decision") == "supersede").alias("n_supersede"), F.countDistinct(F.when(F.col("decision") == "supersede", F.col("successor"))).alias("n_successors"))
    return g.filter("(n_retract > 0 and n_supersede > 0) or n_successors > 1")


def net_feedback(events: DataFrame) -> DataFrame:
    """subject, net: +1 and -1 by kind, summed and held between -3 and 3."""
    s = F.lit(None).cast("int")
    for kind, v in SIGNALS.items():
        s = F.when(F.col("kind") == kind, v).otherwise(s)
    g = events.select(F.col("entity").alias("subject"), s.alias("s")).dropna().groupBy("subject").agg(F.sum("s").alias("t"))
    return g.select("subject", F.greatest(F.least("t", F.lit(3)), F.lit(-3)).cast("int").alias("net"))


def exclusion(trusted: Column, evidence: Column, current: Column, live: Column, quarantined: Column) -> Column:
    """The first clause that keeps a record from recall, or null."""
    f = F.coalesce
    no = F.lit(False)
    return (
        F.when(~f(trusted, no), "trust").when(~f(evidence, no), "evidence").when(~f(current, no), "applicability").when(~f(live, no), "lifecycle").when(f(quarantined, no), "quarantined")
    )


def expired(occurred: Column, days: Column, pinned: Column, now: int) -> Column:
    """Not pinned, and past its days; a time that cannot be read counts as past."""
    return ~F.coalesce(pinned, F.lit(False)) & F.coalesce(occurred + days * F.lit(DAY_US) <= now, F.lit(True))


def scrub(payload: Column, forbidden: str = r"(?i)(secret|token|password|path)") -> Column:
    """A JSON object's pairs without the keys that match; null stays null."""
    return F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: ~k.rlike(forbidden))


def session_projection(events: DataFrame, now: int, stale_days: int = 14) -> DataFrame:
    """session, last_kind, last_line, n, kinds, idle_days, stale: each session's latest event and what it did."""
    g = events.filter("session is not null").groupBy("session").agg(
        F.max_by(F.struct("kind", "line_no"), F.struct("arrived", "line_no")).alias("last"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("arrived").alias("arrived")
    )
    idle = F.floor((F.lit(now) - F.col("arrived")) / DAY_US)
    return g.select("session", F.col("last.kind").alias("last_kind"), F.col("last.line_no").alias("last_line"), "n", "kinds", idle.alias("idle_days"), (idle >= stale_days).alias("stale"))


def last_other_session(events: DataFrame) -> DataFrame:
    """project, session, other_session: for each session of a project the latest other session before its first event."""
    s = events.filter("session is not null and project is not null").groupBy("project", "session").agg(F.min("arrived").alias("first"), F.max("arrived").alias("last"))
    # the session before is the next one looking back
    backwards = s.withColumn("_back", -F.col("first")).withColumn("_name", F.col("session"))
    back = [F.col("_back"), F.concat(F.translate(F.hex("session"), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
    return skew.following(backwards, ["project"], back, "_name", "other_session").select("project", "session", "other_session")
