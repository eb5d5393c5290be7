"""Graph stores at rest: JSON lines with quarantine, source trees, spans of lines, exports with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merging import latest

NODE = "id string, kind string, hash string, file string, span struct<start:int,end:int>, lang string, name string, qualifiedName string, signature string, meta string"
EDGE = "id string, src string, dst string, rel string, method string, provenance string, confidence double, evidence map<string,string>"
# fixed values: closed sets of the model
NODE_KINDS = ("file", "symbol", "doc-section", "explanation", "cluster", "route", "statement", "condition", "assignment", "raise", "exception-handler", "cursor", "field", "table", "column", "media-segment", "config", "resource", "owner", "http-call", "agent-artifact")


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined): JSON lines of every shard below a folder; lines that do not parse go to the second."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("_raw"))
    parsed = raw.withColumn("r", F.from_json("_raw", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).filter("trim(_raw) <> ''")
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull() | F.col("r.id").isNull()
    return parsed.filter(~bad).select("r.*").drop("_corrupt"), parsed.filter(bad).select("_raw")


def valid_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) by the closed set of kinds."""
    ok = F.coalesce(F.col("kind").isin(*NODE_KINDS), F.lit(False))
    return nodes.filter(ok), nodes.filter(~ok)


def last_wins(rows: DataFrame, order: list[Column]) -> DataFrame:
    return latest(rows, ["id"], order)


def write_store(df: DataFrame, path: str, shard: str = "file", shards: int = 16) -> None:
    """Writes a table in folders by a hash of ``shard``; only the shards that are present are replaced."""
    (df.withColumn("shard", F.pmod(F.xxhash64(shard), F.lit(shards)).cast("int")).write.option("partitionOverwriteMode", "dynamic").partitionBy("shard").mode("overwrite").parquet(path))


def source_tree(spark: SparkSession, path: str, languages: dict[str, str]) -> DataFrame:
    """file, lang, size, body of the text files below a folder; files of other extensions are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    lang = F.lit(None).cast("string")
    for ext, name in languages.items():
        lang = F.when(F.col("path").endswith(ext), name).otherwise(lang)
    return f.select(F.col("path").alias("file"), lang.alias("lang"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("body")).filter("lang is not null")


def span_text(body: Column, start: Column, end: Column, max_chars: int = 4_000) -> Column:
    """struct(text, truncated): lines start to end of a text, counted from 1, cut at ``max_chars``."""
    lines = F.split(body, "\n")
    t = F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")
    return F.struct(F.substring(t, 1, max_chars).alias("text"), (F.length(t) > max_chars).alias("truncated"))


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Writes both tables as JSON and gives part, n, digest: counts and an order-free digest of what was written."""
    out = None
    for part, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").json(f"{path}/{part}")
        row = df.select(F.xxhash64(F.to_json(F.struct(*df.columns))).alias("h")).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("digest"))
        out = row if out is None else out.unionByName(row)
    return out


def verify_export(spark: SparkSession, path: str, manifest: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """part, ok: whether what stands at a path still has the number of rows and the digest of its manifest."""
    out = None
    for part, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{part}")
        row = df.select(F.xxhash64(F.to_json(F.struct(*df.columns))).alias("h")).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("_n"), F.bit_xor("h").alias("_d"))
        out = row if out is None else out.unionByName(row)
    return out.join(manifest, "part").select("part", ((F.col("n") == F.col("_n")) & F.col("digest").eqNullSafe(F.col("_d"))).alias("ok"))


def write_notes(records: DataFrame, path: str, *, title: str = "subject", body: str = "claim", folder: str = "kind") -> None:
    """Writes records as Markdown, a heading and a paragraph each, in folders by a column."""
    text = F.concat(F.lit("## "), F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"[\r\n]+", " "), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")), F.lit("\n"))
    records.select(F.col(folder), text.alias("value")).write.mode("overwrite").partitionBy(folder).text(path)


def materialize(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a graph for reading by id: both tables by ranges and in order, so that point reads skip files."""
    nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartitionByRange("src").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{path}/edges")
