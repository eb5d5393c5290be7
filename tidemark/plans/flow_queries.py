"""Queries of dataflow and of the text sources over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import flow
from tidemark.sources import markdown, stores, table


def data_edges(spark, d):
    s, f = flow.from_nodes(table(spark, d, "nodes"))
    return flow.data_edges(s, f)


def taint_paths(spark, d):
    s, f = flow.from_nodes(table(spark, d, "nodes"))
    return flow.taint(s, flow.data_edges(s, f))


def control_edges(spark, d):
    _, f = flow.from_nodes(table(spark, d, "nodes"))
    return flow.control_edges(f)


def markdown_sections(spark, d):
    docs = table(spark, d, "documents").filter("doc_kind = 'doc-section'")
    return markdown.sections(docs).select("doc_id", "heading", "level", "anchor", "start", "end", "parent")


def span_rehydrate(spark, d):
    n = table(spark, d, "nodes").filter("kind = 'symbol'").select("id", "file", "span_start", "span_end").dropna().distinct()
    s = table(spark, d, "source_files").filter("body is not null").groupBy("file").agg(F.min("body").alias("body"))
    return n.join(s, "file").select("id", stores.span_text(F.col("body"), F.col("span_start"), F.col("span_end")).alias("t")).select("id", "t.text", "t.truncated")


QUERIES = {f.__name__: f for f in (data_edges, taint_paths, control_edges, markdown_sections, span_rehydrate)}

SQL = {
    "span_rehydrate": """with n as (select distinct id, file, span_start s, span_end e from nodes where kind = 'symbol' and id is not null and file is not null and span_start is not null and span_end is not null),
  f as (select file, min(body) body from source_files where body is not null group by file),
  t as (select id, array_to_string(list_slice(string_split(body, chr(10)), greatest(s, 1), e), chr(10)) as t from n join f using (file))
  select id, substring(t, 1, 4000) as text, length(t) > 4000 as truncated from t""",
}
