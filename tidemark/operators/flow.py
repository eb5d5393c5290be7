"""Dataflow over statements and control flow: post-dominators, control dependence, reaching definitions, taint.

Each function of the analysed code is one group of bounded size, so the fixpoints run in one task a function and
all functions run in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXIT = -1

CONTEXTS = ("code", "shell", "sql", "html", "url", "fs", "path")


class Rule(NamedTuple):
    """A source emits taint of some contexts, a sink is dangerous in one, a sanitizer clears some; none means all."""

    id: str
    kind: str
    match: tuple[str, ...]
    contexts: tuple[str, ...] = CONTEXTS


# fixed values: substrings, in lower case, that make a statement a source, a sink or a sanitizer
TAINT_RULES = (
    Rule("source.http-input", "source", ("req.query", "request.query", "req.params", "request.params", "req.body", "request.body", "req.headers", "request.headers")),
    Rule("source.url-search-params", "source", ("searchparams.get", "urlsearchparams")),
    Rule("source.env", "source", ("process.env",)),
    Rule("source.fs-read", "source", ("readfile", "readdir")),
    Rule("source.parsed-json", "source", ("json.parse",)),
    Rule("source.child-args", "source", ("argv",)),
    Rule("sink.code-eval", "sink", ("eval(", "new function("), ("code",)),
    Rule("sink.shell-exec", "sink", ("exec(", "execsync(", "spawn(", "spawnsync(", "execfile("), ("shell",)),
    Rule("sink.sql-concat", "sink", (".query(", ".execute("), ("sql",)),
    Rule("sink.html-inject", "sink", ("innerhtml", "dangerouslysetinnerhtml", "document.write("), ("html",)),
    Rule("sink.fs-write-path", "sink", ("writefile", "appendfile", "unlink", "rmsync", "mkdir"), ("path",)),
    Rule("sink.url-fetch", "sink", ("fetch(", "http.request(", "https.request("), ("url",)),
    Rule("sanitizer.schema-validate", "sanitizer", ("safeparse(", ".validate(", "z.object", "yup.object", "joi.object")),
    Rule("sanitizer.uri-encode", "sanitizer", ("encodeuricomponent(",), ("url",)),
)


def post_dominators(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, set[int]]:
    """For each node the nodes on every way from it to the exit; nodes that cannot leave have only themselves."""
    succ: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        succ[a].add(b)
    for n in nodes:
        if not succ[n] and n != EXIT:
            succ[n].add(EXIT)
    succ[EXIT] = set()
    back: dict[int, set[int]] = defaultdict(set)
    for a, bs in succ.items():
        for b in bs:
            back[b].add(a)
    leaves, work = {EXIT}, [EXIT]
    while work:
        for p in back[work.pop()]:
            if p not in leaves:
                leaves.add(p)
                work.append(p)
    dom = {n: set(leaves) if n in leaves else {n} for n in succ}
    dom[EXIT] = {EXIT}
    changed = True
    while changed:
        changed = False
        for n in leaves - {EXIT}:
            new = set.intersection(*(dom[s] for s in succ[n] if s in leaves)) | {n}
            if new != dom[n]:
                dom[n], changed = new, True
    return dom


def control_dependence(nodes: list[int], edges: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Pairs (branch, node): the node runs or not by which way the branch goes."""
    dom = post_dominators(nodes, edges)
    out = set()
    for a, b in edges:
        for n in dom[b] - {EXIT}:
            if n not in dom[a] or n == a:
                out.add((a, n))
    return {(a, n) for a, n in out if n != a or (a, a) in edges}


def reaching_definitions(defs: dict[int, set[str]], uses: dict[int, set[str]], edges: list[tuple[int, int]]) -> set[tuple[int, int, str]]:
    """(definition, use, name): definitions that reach a use with no other definition on the way."""
    succ: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
    nodes = {*defs, *uses, *(x for e in edges for x in e)}
    into: dict[int, set[tuple[int, str]]] = {n: set() for n in nodes}
    work = list(nodes)
    while work:
        n = work.pop()
        own = defs.get(n, set())
        out = {(d, v) for d, v in into[n] if v not in own} | {(n, v) for v in own}
        for s in succ[n]:
            if not out <= into[s]:
                into[s] |= out
                work.append(s)
    return {(d, n, v) for n in nodes for d, v in into[n] if v in uses.get(n, set())}


def taint_paths(texts: dict[int, str], data: set[tuple[int, int, str]], rules: tuple[Rule, ...] = TAINT_RULES) -> list[tuple[int, int, str, str, str, list[int]]]:
    """(source, sink, source rule, sink rule, context, statements from source to sink).

    A source's contexts go along the data edges.  A sanitizer takes away what it clears, at the source and sink
    statements themselves too.  A sink is reached if its own context arrives; of several ways the shortest is
    told, of those the least.
    """
    hits = {n: [r for r in rules if any(m in t.lower() for m in r.match)] for n, t in texts.items()}
    succ: dict[int, set[int]] = defaultdict(set)
    for d, u, _ in data:
        succ[d].add(u)
    keeps = {n: set(CONTEXTS).difference(*(r.contexts for r in rs if r.kind == "sanitizer")) for n, rs in hits.items()}
    out = []
    for s in sorted(texts):
        for source in (r for r in hits[s] if r.kind == "source"):
            for context in source.contexts:
                if context not in keeps[s]:
                    continue
                came: dict[int, int | None] = {s: None}
                level = [s]
                while level:
                    after = []
                    for n in level:
                        for u in sorted(succ[n]):
                            if u not in came and context in keeps.get(u, CONTEXTS):
                                came[u] = n
                                after.append(u)
                    level = sorted(after)
                for n in sorted(came):
                    for sink in (r for r in hits.get(n, ()) if r.kind == "sink" and context in r.contexts):
                        way, at = [], n
                        while at is not None:
                            way.append(at)
                            at = came[at]
                        out.append((s, n, source.id, sink.id, context, way[::-1]))
    return sorted(out)


def data_edges(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """fn, src, dst, name: data dependences within each function.

    ``statements``: fn, id, defs, uses (arrays).  ``flow``: fn, src, dst.
    """

    def run(key, s: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        sets = lambda c: {i: set(v) for i, v in zip(s["id"], s[c], strict=True) if v is not None}
        rows = reaching_definitions(sets("defs"), sets("uses"), list(zip(f["src"], f["dst"], strict=True)))
        return pd.DataFrame([(key[0], *r) for r in sorted(rows)], columns=["fn", "src", "dst", "name"])

    s, f = statements.select("fn", "id", "defs", "uses").toDF("fn", "id", "defs", "uses"), flow.select("fn", "src", "dst").toDF("fn", "src", "dst")
    return s.groupBy("fn").cogroup(f.groupBy("fn")).applyInPandas(run, "fn string, src bigint, dst bigint, name string")


def taint(statements: DataFrame, data: DataFrame, rules: tuple[Rule, ...] = TAINT_RULES) -> DataFrame:
    """fn, source, sink, source_rule, sink_rule, context, way.  ``statements``: fn, id, text.  ``data``: as ``data_edges`` gives."""
    names = ["fn", "source", "sink", "source_rule", "sink_rule", "context", "way"]

    def run(key, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        found = taint_paths(dict(zip(s["id"], s["text"].fillna(""), strict=True)), set(zip(e["src"], e["dst"], e["name"], strict=True)), rules)
        return pd.DataFrame([(key[0], *r) for r in found], columns=names)

    s, e = statements.select("fn", "id", "text").toDF("fn", "id", "text"), data.select("fn", "src", "dst", "name").toDF("fn", "src", "dst", "name")
    return s.groupBy("fn").cogroup(e.groupBy("fn")).applyInPandas(run, "fn string, source bigint, sink bigint, source_rule string, sink_rule string, context string, way array<bigint>")


def control_edges(flow: DataFrame) -> DataFrame:
    """fn, branch, node: control dependences within each function."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(pdf["src"], pdf["dst"], strict=True))
        nodes = sorted({x for e in edges for x in e})
        return pd.DataFrame([(pdf["fn"].iloc[0], a, n) for a, n in sorted(control_dependence(nodes, edges))], columns=["fn", "branch", "node"])

    return flow.select("fn", "src", "dst").groupBy("fn").applyInPandas(run, "fn string, branch bigint, node bigint")


def from_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements and flow of a node table: a file's statements in order of line; a condition may skip the next.

    An expression ``name op rest`` defines its first word and uses the words after it.
    """
    from pyspark.sql import Window

    n = nodes.filter("kind in ('statement', 'assignment', 'condition') and expr is not null and file is not null and span_start is not null")
    n = n.groupBy("id").agg(F.min("file").alias("fn"), F.min("span_start").alias("line"), F.min("expr").alias("text"), F.min("kind").alias("kind"))
    line = Window.partitionBy("fn").orderBy("line", "id")
    words = F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z_0-9]*)"), F.lit(1))
    s = n.select("fn", F.row_number().over(line).cast("bigint").alias("id"), "text", F.when(F.col("kind") == "assignment", F.slice(words, 1, 1)).otherwise(F.array().cast("array<string>")).alias("defs"), F.when(F.col("kind") == "assignment", F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words).alias("uses"), "kind")
    ways = F.when(F.col("kind") == "condition", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    flow = s.select("fn", F.col("id").alias("src"), F.explode(ways).alias("way")).select("fn", "src", (F.col("src") + F.col("way")).alias("dst"))
    return s, flow.join(s.select("fn", F.col("id").alias("dst")), ["fn", "dst"], "left_semi").select("fn", "src", "dst")
