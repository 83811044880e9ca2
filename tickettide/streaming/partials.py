"""Additive counts that batches write, merged into generations now and then.

Layout under the root folder::

    parts/stream=.../batch=...      the counts of one batch
    totals/generation=...           the sums of all batches up to some
    generations/generation=...      per stream the last batch a generation holds

A generation counts once it is in the log, which is written last; until then
readers take the one before and the batches after that. What a generation
holds is read from it alone, so a batch that is run again after it has been
merged adds nothing. Batches and totals that the generation before last held
are removed, which leaves readers that began earlier undisturbed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.plans.workspace import path_exists, remove

_BATCH = [T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
_LOG_SCHEMA = T.StructType([T.StructField("stream", T.StringType()), T.StructField("last", T.LongType()),
                            T.StructField("generation", T.LongType())])


class PartialCounts:
    """Counts under one folder: `keys` name the groups, all other columns of the schema are summed."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str]):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{folder}"
        return self.spark.read.schema(schema).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def write_batch(self, counts: DataFrame, stream: str, batch: int) -> None:
        counts.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/parts/stream={stream}/batch={batch}")

    def generation(self) -> tuple[int, dict[str, int]]:
        """The newest generation, 0 if there is none, and the last batch of each stream in it."""
        log = self._read("generations", _LOG_SCHEMA)
        newest = log.agg(F.max("generation")).first()[0] or 0
        return newest, {r["stream"]: r["last"] for r in log.where(F.col("generation") == newest).collect()}

    def _since(self, held: dict[str, int]) -> DataFrame:
        """The counts of batches that a generation doesn't hold; folders it does hold are not read."""
        parts = self._read("parts", T.StructType([*self.schema.fields, *_BATCH]))
        within = [(F.col("stream") == stream) & (F.col("batch") <= last) for stream, last in held.items()]
        return parts.where(~reduce(Column.__or__, within)) if within else parts

    def _totals(self, generation: int) -> DataFrame:
        return self._read(f"totals/generation={generation}", self.schema) if generation else self.spark.createDataFrame([], self.schema)

    def _added(self, rows: DataFrame) -> DataFrame:
        counts = [c for c in self.schema.fieldNames() if c not in self.keys]
        return rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in counts))

    def sums(self) -> DataFrame:
        """What all batches add up to: the newest generation and the batches after it."""
        generation, held = self.generation()
        since = self._since(held).select(*self.schema.fieldNames())
        return self._added(self._totals(generation).unionByName(since))

    def pending(self) -> int:
        """How many batches no generation holds yet."""
        _, held = self.generation()
        return self._since(held).select("stream", "batch").distinct().count()

    def _merge(self, generation: int, held: dict[str, int]) -> DataFrame:
        """Write the next generation's totals and return its log, which makes it count."""
        since = self._since(held)
        last = since.groupBy("stream").agg(F.max("batch").alias("last")).collect()
        marks = {**held, **{r["stream"]: r["last"] for r in last}}
        # Batches that come while this runs are after the marks, and stay for later.
        upto = [(F.col("stream") == s) & (F.col("batch") <= b) for s, b in marks.items()]
        rows = self._totals(generation).unionByName(since.where(reduce(Column.__or__, upto)).select(*self.schema.fieldNames()))
        self._added(rows).write.mode("overwrite").parquet(f"{self.root}/totals/generation={generation + 1}")
        return self.spark.createDataFrame(list(marks.items()), "stream string, last long")

    def compact(self) -> None:
        """Merge all finished batches into a new generation. One at a time; readers and batches may go on."""
        generation, held = self.generation()
        if not self.pending():
            return
        log = self._merge(generation, held)
        log.write.mode("overwrite").parquet(f"{self.root}/generations/generation={generation + 1}")
        self._remove_before(generation, held)

    def _remove_before(self, generation: int, held: dict[str, int]) -> None:
        """Remove what the generation before the newest one has taken in."""
        for folder in ("totals", "generations") if generation > 1 else ():
            remove(self.spark, f"{self.root}/{folder}/generation={generation - 1}")
        folders = self._read("parts", T.StructType(_BATCH)).distinct().collect() if held else []
        for row in folders:
            if row["batch"] <= held.get(row["stream"], -1):
                remove(self.spark, f"{self.root}/parts/stream={row['stream']}/batch={row['batch']}")
