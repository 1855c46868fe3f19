"""Incremental ingestion: micro-batches of upserts and deletions into a table whose changed partitions are swapped by a manifest.

A table is dealt to ``parts`` partitions by a hash of the key. A batch rewrites the partitions that hold its keys, into a new
folder, and then one manifest names the folder of each partition and the last batch of each source (the ledger). So a batch
that was applied before changes nothing, a batch that was killed before its manifest leaves the old table, and readers see one
version or the other.

Within a batch the row of the greatest sequence number counts; a key without a row (``gone``) is deleted. Null keys are left
out; batches without rows advance the ledger alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import prepare, scratch


@dataclass(frozen=True)
class Ingested:
    """A version of a table below ``root``: ``schema`` has the column ``key``."""

    spark: SparkSession
    root: str
    key: str
    schema: str
    parts: int = 16
    version: int = 0
    folders: tuple[tuple[int, str], ...] = ()
    ledger: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def opened(spark: SparkSession, root: str) -> Ingested:
        """The newest version."""
        rows = spark.read.schema("version int, state string").option("recursiveFileLookup", True).json(f"{root}/manifest")
        state = json.loads(rows.orderBy(F.desc("version")).first()["state"])
        pairs = lambda x: tuple((a, b) for a, b in x)
        return Ingested(spark, root, state["key"], state["schema"], state["parts"], state["version"], pairs(state["folders"]), pairs(state["ledger"]))

    def _committed(self, folders: dict[int, str], ledger: dict[str, int]) -> Ingested:
        new = Ingested(self.spark, self.root, self.key, self.schema, self.parts, self.version + 1, tuple(sorted(folders.items())), tuple(sorted(ledger.items())))
        state = json.dumps({"key": new.key, "schema": new.schema, "parts": new.parts, "version": new.version, "folders": new.folders, "ledger": new.ledger})
        self.spark.createDataFrame([(new.version, state)], "version int, state string").coalesce(1).write.json(f"{self.root}/manifest/{new.version:06d}")
        return new

    def created(self) -> Ingested:
        """The empty table as its first version."""
        return self._committed({}, {})

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """The rows of the table, or of some of its partitions."""
        wanted = [(p, f) for p, f in self.folders if parts is None or p in parts]
        by_folder: dict[str, list[str]] = {}
        for p, f in wanted:
            by_folder.setdefault(f, []).append(f"{self.root}/{f}/part={p}")
        each = [self.spark.read.schema(self.schema).parquet(*paths) for paths in by_folder.values()]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], self.schema)

    def applied(self, batch: DataFrame, batch_id: int, source: str = "stream", seq: str = "seq", gone: str = "gone") -> Ingested:
        """The next version: ``batch`` has the table's columns, a sequence number and whether the key is deleted."""
        ledger = dict(self.ledger)
        if batch_id <= ledger.get(source, -1):
            return self
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        columns = self.spark.createDataFrame([], self.schema).columns
        row = F.struct(*columns, gone)
        last = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(row, F.struct(seq, F.xxhash64(*columns))).alias("_row"))
        # numbers of partitions: as many as the table has at most
        touched = [r[0] for r in last.select(part.alias("p")).distinct().collect()]
        folders = dict(self.folders)
        if touched:
            name = f"rows-{self.version + 1:06d}-{uuid.uuid4().hex[:8]}"
            new = last.select("_row.*")
            kept = self.rows(touched).join(new.select(self.key), self.key, "left_anti").select(*columns)
            merged = kept.unionByName(new.where(~F.coalesce(F.col(gone), F.lit(False))).select(*columns))
            merged.withColumn("part", part).repartition("part", F.pmod(F.hash(self.key), F.lit(4))).write.partitionBy("part").parquet(f"{self.root}/{name}")
            full = {r[0] for r in self.spark.read.schema("part int").parquet(f"{self.root}/{name}").select("part").distinct().collect()}
            folders = {p: f for p, f in folders.items() if p not in touched} | {p: name for p in touched if p in full}
        return self._committed(folders, ledger | {source: batch_id})


def ingest(stream: DataFrame, root: str, source: str = "stream") -> Ingested:
    """Everything that a stream has now, batch by batch, into the table below ``root``; started again it goes on."""
    spark = prepare(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        Ingested.opened(batch.sparkSession, root).applied(batch, batch_id, source)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint-{source}").trigger(availableNow=True).start().awaitTermination()
    return Ingested.opened(spark, root)


def new_table(spark: SparkSession, key: str, schema: str, parts: int = 16) -> Ingested:
    """An empty table in the shared folder."""
    return Ingested(spark, scratch(spark, "ingested"), key, schema, parts).created()
