"""Hooks for one's own extractors, rerankers and lexical scorers; all run in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Extractor(Protocol):
    """Turns files of a language into rows of nodes."""

    def supports(self, file: str, lang: str | None) -> bool: ...

    def extract(self, file: str, body: str) -> Iterable[tuple[str, str, str | None, int | None, int | None]]:
        """(id, kind, name, first line, last line) of what a file holds."""
        ...


def extract(files: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """file, id, kind, name, span_start, span_end, problem by the first extractor that supports each file.

    ``files``: file, lang, body.  A file that none supports, or without a text, gives no row; one whose
    extractor fails gives a row with the problem alone, and the others go on.
    """
    cols = ["file", "id", "kind", "name", "span_start", "span_end", "problem"]

    def run(frames):
        for f in frames:
            rows = []
            for file, lang, body in zip(f["file"], f["lang"], f["body"], strict=True):
                one = next((x for x in extractors if body is not None and x.supports(file, lang)), None)
                if one is None:
                    continue
                try:
                    rows += [(file, *r, None) for r in one.extract(file, body)]
                except Exception as e:  # a plugin may fail in any way; its file is reported
                    rows.append((file, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=cols).astype({"span_start": "Int32", "span_end": "Int32"})

    return files.select("file", "lang", "body").filter("file is not null").mapInPandas(run, "file string, id string, kind string, name string, span_start int, span_end int, problem string")


def rerank(hits: DataFrame, score: Callable[[str, list[str]], list[float]], *, window: int = 50, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """key, item, place: the first ``window`` hits of a query in order of ``score(query, texts)``, the tail as it was.

    ``hits``: key, item, rank, query, text.  Only the window, which is bounded, is gathered.  A scorer that gives
    another number of scores than texts fails the query rather than misplace anything.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", item])
        got = score(pdf["query"].iloc[0], pdf["text"].fillna("").tolist())
        if len(got) != len(pdf):
            raise ValueError(f"{len(got)} scores for {len(pdf)} texts")
        return pdf.assign(_again=[float(x) for x in got])[[key, item, "rank", "_again"]]

    types = dict(hits.dtypes)
    head = hits.filter(F.col("rank") <= window).select(key, item, "rank", "query", "text")
    scored = head.groupBy(key).applyInPandas(run, f"{key} {types[key]}, {item} {types[item]}, rank {types['rank']}, _again double")
    tail = hits.filter(F.col("rank") > window).select(key, item, "rank", F.lit(None).cast("double").alias("_again"))
    order = [F.col("_again").isNull(), F.col("_again").desc(), F.col("rank"), F.col(item)]
    return scored.unionByName(tail).select(key, item, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("place"))


def lexical(records: DataFrame, queries: list[tuple[str, str]], score: Callable[[str, pd.Series], pd.Series], *, k: int = 10, id_: str = "id", text: str = "text") -> DataFrame:
    """query_id, id, score, rank of stated queries (id, text) by one's own scorer over batches of texts; ties by id.

    Every batch keeps its ``k`` best a query, so what moves does not grow with the batches' size.
    """

    def run(frames):
        for f in frames:
            for query_id, q in queries:
                s = score(q, f["_t"]).astype(float)
                best = pd.DataFrame({"query_id": query_id, "_id": f["_id"], "score": s})
                best = best[best["score"] > 0].sort_values(["score", "_id"], ascending=[False, True])
                yield best.head(k)

    kind = dict(records.dtypes)[id_]
    r = records.select(F.col(id_).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).filter("_id is not null")
    s = r.mapInPandas(run, f"query_id string, _id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_id"))
    return s.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("_id").alias(id_), "score", "rank")
