"""Session helpers: a default session, table paths, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parent.parent)

#: A broadcast is only asked for when the counted rows of the small side stay at or under this many.
BROADCAST_ROWS = 20_000
#: Nor is one of more bytes than this.
BROADCAST_BYTES = 16 << 20

#: Rows that a Python worker gets at once at most, read when a query runs: texts and their words are held several times over.
BATCH_ROWS = 1024


def get_spark(app: str = "quern", cores: str | int = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the test-suite and the bench use; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when the session was started from another folder, and bounds their batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    return spark


_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine (tests) a folder of the session's own."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = _own[app] = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quern-{what}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this session has written to the shared folder; frames that read it are of no use then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def width(kind: T.DataType, column: Column) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(column), F.lit(0)) * (32 if isinstance(kind.elementType, T.StringType) else 8) + 16
    return F.lit(8)


def is_broadcast_sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a count proves a frame small in rows and in bytes."""
    wide = sum((width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(wide)).first()
    return n <= rows and (total or 0) <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when a count proves it small in rows and in bytes; beyond that the plain frame, for a shuffled join."""
    return F.broadcast(df) if is_broadcast_sized(df, rows, size) else df


def broadcast_or_merge(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``maybe_broadcast`` for frames that repeat few values: beyond its bounds neither side of the join is broadcast.

    Without a hint Spark goes by the size of the files, and six million rows of few values are a file of two megabytes.
    """
    held = maybe_broadcast(df, rows, size)
    return df.hint("merge") if held is df else held
