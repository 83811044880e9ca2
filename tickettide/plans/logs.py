"""Logs of small entries, merged into one file now and then.

Layout for a log under a root folder::

    <log>/<partition>=.../...          an entry each, written as it happens
    <log>_checkpoint/upto=...          all entries up to a key, in one file

Readers take the newest checkpoint and the entries after it. A checkpoint
counts once it is written to the end. Entries that the checkpoint before it
held are removed then, so that readers who began with that one are undisturbed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.plans.workspace import finished_folders, path_exists, remove


@dataclass
class Log:
    """A log whose entries have an ascending `key` and a folder each, by `partitions`."""

    spark: SparkSession
    root: str
    name: str
    schema: T.StructType
    key: str
    partitions: Sequence[str]

    @property
    def _checkpoints(self) -> str:
        return f"{self.root}/{self.name}_checkpoint"

    def checkpoints(self) -> list[int]:
        """The keys up to which checkpoints go, in order."""
        return sorted(int(name.partition("=")[2]) for name in finished_folders(self.spark, self._checkpoints) if name.startswith("upto="))

    def _tail(self, after: int) -> DataFrame:
        path = f"{self.root}/{self.name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path).select(*self.schema.fieldNames()).filter(F.col(self.key) > after)

    def rows(self) -> DataFrame:
        held = self.checkpoints()
        if not held:
            return self._tail(-1)
        merged = self.spark.read.schema(self.schema).parquet(f"{self._checkpoints}/upto={held[-1]}")
        return merged.select(*self.schema.fieldNames()).unionByName(self._tail(held[-1]))

    def checkpoint(self, upto: int) -> None:
        """Merge all entries up to a key, after which no entry up to it may be written again."""
        held = self.checkpoints()
        if held and upto <= held[-1]:
            return
        rows = self.rows().filter(F.col(self.key) <= upto)
        rows.repartition(1).write.mode("overwrite").parquet(f"{self._checkpoints}/upto={upto}")
        if held:
            self._remove_upto(held[-1])
        for older in held[:-1]:
            remove(self.spark, f"{self._checkpoints}/upto={older}")

    def _remove_upto(self, last: int) -> None:
        for row in self._tail(-1).filter(F.col(self.key) <= last).select(*self.partitions).distinct().collect():
            remove(self.spark, "/".join([self.root, self.name, *(f"{p}={row[p]}" for p in self.partitions)]))
