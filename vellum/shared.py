"""Helpers every operator shares: cutting lineage, spreading work, joins that check a size first."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key list that may be broadcast, and bytes of its strings: 16 MB of numbers on the wire, or that much text.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16_000_000

_made: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; where that is unset, only a local master gets a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="vellum-")
        _made[app] = f"{base.rstrip('/')}/vellum-{app}"
        atexit.register(_forget, spark, _made[app])
    return _made[app]


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written so far; frames that read them can't be used any more."""
    if app := _made.pop(spark.sparkContext.applicationId, None):
        _forget(spark, app)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone: the shared folder's own clean-up has to do
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and a later read takes only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only if the scan gives fewer tasks than there are cores (one small file, say)."""
    ship(df.sparkSession)
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # it has an exchange already, and asking for its partitions would run it
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialized key list for broadcast if it is within ``rows`` and ``BROADCAST_BYTES``; beyond that the join shuffles."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    size = df.agg(F.count("*").alias("n"), *(F.sum(F.octet_length(c)).alias(c) for c in text)).first()
    return F.broadcast(df) if size["n"] <= rows and sum(size[c] or 0 for c in text) <= BROADCAST_BYTES else df


def semi(df: DataFrame, keys: DataFrame, on: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` whose ``on`` is among the materialized ``keys``."""
    return df.join(bounded(keys.select(on).distinct(), rows), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` whose ``on`` is not among the materialized ``keys``."""
    return df.join(bounded(keys.select(on).distinct(), rows), on, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a test directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
