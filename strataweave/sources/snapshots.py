"""Tables that change by whole commits: snapshots and a ledger of what made them.

A commit writes its tables beside the old ones and then one row of the ledger,
which names them and the batch they come from. A table is what the last row of the
ledger says, so a commit that broke off before it has changed nothing, and a
batch that the ledger knows is not applied again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEDGER = "number long, stream string, batch long, paths map<string,string>, rows map<string,long>, committed_at timestamp"


class SnapshotStore:
    """Tables in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def ledger(self) -> DataFrame:
        """All commits: ``number, stream, batch, paths, rows, committed_at``."""
        if not self._there(f"{self.path}/ledger"):
            return self.spark.createDataFrame([], _LEDGER)
        # a row that was not finished has no mark of success and is no commit
        return self.spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/ledger")

    def _last(self):
        rows = self.ledger().orderBy(F.desc("number")).limit(1).collect()
        return rows[0] if rows else None

    def has(self, stream: str, batch: int) -> bool:
        return self.ledger().where((F.col("stream") == stream) & (F.col("batch") == batch)).limit(1).count() > 0

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables after the last commit, or after commit ``number``."""
        if number is None:
            row = self._last()
        else:
            rows = self.ledger().where(F.col("number") == number).collect()
            row = rows[0] if rows else None
        return {name: self.spark.read.parquet(path) for name, path in sorted(row.paths.items())} if row else {}

    def commit(self, stream: str, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Takes over ``tables`` as the result of a batch; tables not named stay. False, and no change, if the batch is in the ledger.

        Two writers that commit at once want the same row of the ledger: for one of them it is an error.
        """
        if self.has(stream, batch):
            return False
        last = self._last()
        paths = dict(last.paths) if last else {}
        rows = dict(last.rows) if last else {}
        for name, df in tables.items():
            paths[name] = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
            rows[name] = self.spark.read.parquet(paths[name]).count()
        number = last.number + 1 if last else 0
        entry = self.spark.createDataFrame([(number, stream, batch, paths, rows)], "number long, stream string, batch long, paths map<string,string>, rows map<string,long>")
        entry.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("error").parquet(f"{self.path}/ledger/{number:012d}")
        return True

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes data that none of the last ``keep`` commits names, that of broken commits too; returns the folders."""
        kept = {p for r in self.ledger().orderBy(F.desc("number")).limit(keep).collect() for p in r.paths.values()}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for table in system.listStatus(place) if system.exists(place) else []:
            for version in system.listStatus(table.getPath()):
                folder = f"{self.path}/data/{table.getPath().getName()}/{version.getPath().getName()}"
                if folder not in kept:
                    system.delete(version.getPath(), True)
                    gone.append(folder)
        return sorted(gone)
