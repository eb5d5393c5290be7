"""Session settings and the shared folder for intermediate tables.

Loops cut their lineage by writing a compressed Parquet table into the folder the cluster names in
``spark.checkpoint.dir``.  A written table survives the loss of any executor, holds only the columns that are
still needed and costs less disk than a checkpoint of serialised rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, adaptive execution, skew handling."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where the session may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_by_hand = spark.sparkContext.getCheckpointDir()
    if set_by_hand:
        return set_by_hand.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[app]


class Scratch:
    """Intermediate tables of one operator call, in a folder of their own.

    ``put`` writes a table and gives it back as a fresh scan together with its number of rows, which the write
    counts in passing.  Tables stay until the session ends, because results that are still lazy read them; a
    loop drops the ones it no longer needs with ``drop``.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        path = f"{self.root}/{name}"
        seen = Observation(uuid.uuid4().hex)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), int(seen.get["n"])

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is already gone; the cluster cleans its shared folder
            pass


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
