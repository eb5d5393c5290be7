"""Source files that do not parse, per file and as rates per repository and language.

Files are lexed into rows of tokens.  Pairs of adjacent tokens are anti-joined against the pairs the grammar
permits; nesting is checked with running sums over each file; and the items of every bracket, put together by
windows over each nesting level, are matched against the productions of their kind, in time linear in their
length.  Equal items are matched once, however many files hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import grammars
from tidemark.runtime import Scratch


def language(file: Column) -> Column:
    """The checked language of a file name's extension, or null."""
    ext = F.regexp_extract(file, r"(\.[A-Za-z0-9]+)$", 1)
    out = F.lit(None).cast("string")
    for e, lang in grammars.LANGUAGE.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


#: Numbers of the languages, kept in the lowest digits of a file's number so that no token has to carry a name.
_CODES = {name: i for i, name in enumerate(grammars.GRAMMARS)}
_BASE = 8


def _lex_batches(batches):
    names = list(_CODES)
    schema = pa.schema([("fid", pa.int64()), ("pos", pa.int32()), ("line", pa.int32()), ("c", pa.string())])
    for b in batches:
        for fid, body in zip(b["fid"].to_pylist(), b["body"].to_pylist(), strict=True):
            classes, lines = grammars.lex(names[fid % _BASE], body)
            for i in range(0, len(classes), 100_000):
                c = list(classes[i : i + 100_000])
                m = len(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, fid)), pa.array(np.arange(i, i + m, dtype=np.int32)), pa.array(lines[i : i + m], pa.int32()), pa.array(c)], schema=schema)


def _reject(frames):
    names = list(_CODES)
    for f in frames:
        yield f[[not grammars.accepts(names[lang], kind, flat) for lang, kind, flat in zip(f["lang"], f["kind"], f["flat"], strict=True)]]


def _is(c: str, chars: str) -> Column:
    return F.col(c).isin(list(chars))


def _mapped(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _items(known: DataFrame) -> DataFrame:
    """fid, lang, level, grp, item, kind, flat, line, pair_line, nest_line: the items of every bracket of every file.

    Tokens move once, to their file.  ``pair_line`` and ``nest_line`` are the first lines where a pair of
    adjacent tokens is in no grammar and where brackets do not fit.
    """
    tokens = known.filter(F.col("body").rlike(r"\S")).select("fid", "body").mapInArrow(_lex_batches, "fid bigint, pos int, line int, c string")
    lang = (F.col("fid") % _BASE).cast("int")
    py = lang == _CODES["py"]
    opens = _is("c", "([{") | (py & (F.col("c") == "<"))
    closes = _is("c", ")]}") | (py & (F.col("c") == ">"))
    along = Window.partitionBy("fid").orderBy("pos")
    role = F.when(opens, 1).when(closes, -1).otherwise(0)
    laid = tokens.withColumn("next", F.lead("c").over(along)).withColumn("role", role).withColumn("depth", F.sum("role").over(along)).withColumn("lang", lang)

    # a few thousand rows, fixed by the grammars; the anti-join keeps its answer as a mark, so that tokens move once
    pairs = [(_CODES[name], a, b, False) for name, g in grammars.GRAMMARS.items() for a, b in g.pairs()]
    allowed = known.sparkSession.createDataFrame(pairs, "lang int, c string, next string, unknown boolean")
    laid = laid.join(F.broadcast(allowed), ["lang", "c", "next"], "left")
    pair_line = F.when(F.col("next").isNotNull() & F.col("unknown").isNull(), F.col("line"))
    # a last depth above 0 leaves something open
    open_line = F.when(F.col("next").isNull() & (F.col("depth") > 0), F.col("line"))

    # an opening token is a symbol of the level around it and begins a group of the level inside it
    none = F.lit(None).cast("string")

    def at(level: Column, sym: Column, opened: Column) -> Column:
        return F.struct(level.cast("bigint").alias("level"), sym.alias("sym"), opened.alias("open"))

    c, depth = F.col("c"), F.col("depth")
    parts = F.when(F.col("role") == 1, F.array(at(depth, none, c), at(depth - 1, _mapped(c, grammars.OPEN), none))).when(F.col("role") == -1, F.array(at(depth + 1, none, none))).otherwise(F.array(at(depth, c, none)))
    placed = laid.select("fid", "lang", "pos", "line", pair_line.alias("pair_line"), open_line.alias("open_line"), F.when(F.col("role") == -1, c).alias("close"), F.explode(parts).alias("p")).select("*", "p.*").drop("p")
    level = Window.partitionBy("fid", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("fid", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("kind", F.coalesce(F.last("open", ignorenulls=True).over(level), F.lit(""))).withColumn("grp", F.count("open").over(level))
    parting = F.lit(False)
    for name, g in grammars.GRAMMARS.items():
        for kind, seps in g.separators.items():
            parting = parting | ((F.col("lang") == _CODES[name]) & (F.col("kind") == kind) & F.coalesce(_is("sym", seps), F.lit(False)))
    # at level 0 there is nothing to close
    crossed = F.when(F.col("close").isNotNull() & ((F.col("level") < 1) | (F.col("kind") != _mapped(F.col("close"), grammars.CLOSE))), F.col("line"))
    cut = placed.withColumn("parts", parting.cast("int")).withColumn("crossed", crossed).withColumn("item", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    symbols = F.collect_list(F.when(F.col("sym").isNotNull(), F.struct("pos", "sym")))
    return cut.groupBy("fid", "lang", "level", "grp", "item").agg(
        F.first("kind").alias("kind"), F.min(F.when(F.col("sym").isNotNull(), F.col("line"))).alias("line"), F.array_join(F.transform(F.array_sort(symbols), lambda t: t["sym"]), "").alias("flat"),
        F.min("pair_line").alias("pair_line"), F.min(F.coalesce("open_line", "crossed")).alias("nest_line"),
    )


def unparsable(files: DataFrame) -> DataFrame:
    """id, lang, reason, line of every file that cannot be parsed in the language of its extension.

    ``files``: id, file, body; other columns are ignored.  ``reason`` is 'pair', 'nesting' or 'production' and
    ``line`` the first line where that showed.  Files of other extensions, with a null id, name or body, and
    files that are empty, blank or nothing but comments give no row.  Rows that repeat an id with another body
    are checked by the smallest body.  A text of any length is checked whole.
    """
    scratch = Scratch(files.sparkSession, "sourcecheck")
    known = files.select(F.col("id").alias("id"), F.col("body").alias("body"), language(F.col("file")).alias("lang")).dropna()
    code = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])[F.col("lang")]
    known = known.groupBy("id", "lang").agg(F.min("body").alias("body")).withColumn("fid", F.monotonically_increasing_id() * _BASE + code)
    known, _ = scratch.put(known, "files")
    items, _ = scratch.put(_items(known), "items")

    production = F.lit("production").alias("reason")
    told = items.filter("flat != ''")
    shapes = told.select("lang", "kind", "flat").distinct()
    rejected = shapes.mapInPandas(_reject, shapes.schema)
    wrong_item = told.join(rejected, ["lang", "kind", "flat"], "left_semi").select("fid", production, "line")

    # clauses that belong together: what begins the items before and after, within the same block
    block = Window.partitionBy("fid", "level", "grp").orderBy("item")
    clause = told.filter((F.col("lang") == _CODES["py"]) & F.col("kind").isin("", "<") & (F.col("flat") != "\n")).withColumn("first", F.regexp_extract("flat", "^Y?(.)", 1))
    clause = clause.withColumn("before", F.coalesce(F.lag("first").over(block), F.lit("?"))).withColumn("after", F.coalesce(F.lead("first").over(block), F.lit("?")))
    stray = F.lit(False)
    for c, after in grammars.PY_BEFORE.items():
        stray = stray | ((F.col("first") == c) & ~_is("after", after))
    for c, before in grammars.PY_AFTER.items():
        stray = stray | ((F.col("first") == c) & ~_is("before", before))
    wrong_clause = clause.filter(stray).select("fid", production, "line")

    wrong_pair = items.filter("pair_line is not null").select("fid", F.lit("pair").alias("reason"), F.col("pair_line").alias("line"))
    crossed = items.filter("nest_line is not null").select("fid", F.lit("nesting").alias("reason"), F.col("nest_line").alias("line"))
    found = wrong_pair.unionByName(crossed).unionByName(wrong_item).unionByName(wrong_clause)
    worst = found.groupBy("fid").agg(F.min(F.struct("line", "reason")).alias("w")).select("fid", "w.reason", "w.line")
    return known.select("fid", "id", "lang").join(worst, "fid").select("id", "lang", "reason", "line")


def file_nodes(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """id, root, file, body of every node of kind ``file`` whose text is known; repeated rows count once."""
    n = nodes.filter("kind = 'file' and id is not null and file is not null").groupBy("id").agg(F.min(F.struct("file", "root")).alias("f")).select("id", "f.file", "f.root")
    s = sources.filter("body is not null").groupBy("file").agg(F.min("body").alias("body"))
    return n.join(s, "file").select("id", "root", "file", "body")


def rates(files: DataFrame) -> DataFrame:
    """root, lang, n_files, n_bad, rate of the checked languages; blank files count as files."""
    checked = files.select("id", "root", language(F.col("file")).alias("lang")).filter("lang is not null")
    bad = unparsable(files).select("id", F.lit(1).alias("bad"))
    return checked.join(bad, "id", "left").groupBy("root", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_bad"), F.round(F.count("bad") / F.count(F.lit(1)), 6).alias("rate"))
