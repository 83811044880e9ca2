"""The snapshot store: dated runs in Parquet, last write wins on reading.

Layout under the root folder::

    runs/<domain>/snapshot_date=.../run_id=.../attempt=...   rows of each run, once per ticket
    run_log/id=...                                 one row per finished run, with its attempt
    stream_runs/stream=.../batch=...               the run each batch of a stream became
    run_log_checkpoint/, stream_runs_checkpoint/   both logs up to a settled run, in one file
    settled/<domain>/generation=.../snapshot_date=...   winners up to a run
    settled_log/domain=.../generation=...          dates each generation holds
    latest/<domain>/generation=...                 each ticket's newest row up to a run, by number

A run counts once it is in the run log, which is written last, and only with
the rows of the attempt and the date that the log names: rows of an attempt
that failed are never seen, whatever the next attempt holds. A generation is
the last run it takes in; it counts once it is in the settled log. Nothing that
is being read is ever overwritten. Reading writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickettide.functions.tickets import raw_payload
from tickettide.operators.pull import Snapshot, stamp
from tickettide.operators.upsert import (
    keyed,
    last_write_wins,
    latest_run_per_ticket,
    latest_run_wins,
    once_per_ticket,
)
from tickettide.plans.logs import Log
from tickettide.plans.workspace import finished_folders, path_exists, remove
from tickettide.schema import DOMAINS, RUN_LOG_SCHEMA, Domain

# Fixed value: a run is logged only once it has succeeded.
STATUS_SUCCESS = "success"

_ATTEMPT = T.StructField("attempt", T.StringType())
_ATTEMPT_LOG_SCHEMA = T.StructType([*RUN_LOG_SCHEMA.fields, _ATTEMPT])

_STREAM_RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("as_of", T.TimestampNTZType()),
    T.StructField("stream", T.StringType()),
    T.StructField("batch", T.LongType()),
])

_SETTLED_LOG_SCHEMA = T.StructType([
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("domain", T.StringType()),
    T.StructField("generation", T.LongType()),
])


def with_payload(rows: DataFrame, domain: Domain) -> DataFrame:
    """Stamped rows in the stored columns, with the whole record as JSON.

    A record that the source has kept as it came stays so, display values and
    fields that are no columns included.
    """
    built = raw_payload(list(domain.fields))
    kept = F.coalesce("raw_payload", built) if "raw_payload" in rows.columns else built
    return rows.withColumn("raw_payload", kept).select(*domain.snapshot_columns)


def run_message(counts: Mapping[str, Column]) -> Column:
    """The run log's note on how much was pulled. Its wording is a fixed value."""
    number = {name: counts[name].cast("string") for name in DOMAINS}
    return F.concat(
        F.lit("Pulled "), number["incident"], F.lit(" incidents and "),
        number["request_item"], F.lit(" request items; "),
        number["change_request"], F.lit(" change requests; "),
        number["problem"], F.lit(" problems"),
    )


def run_log_rows(
    stamped: Mapping[str, DataFrame], since_days: int, notes: str | None = None
) -> DataFrame:
    """One log row per run with the rows pulled per domain, repeats included.

    Needs no field of the tickets, so counting reads next to nothing of them.
    """
    tagged = [
        rows.select("run_id", "snapshot_date", "pulled_at", F.lit(name).alias("domain"))
        for name, rows in stamped.items()
    ]
    counts = {name: F.col(f"{name}_count") for name in DOMAINS}
    return (
        reduce(DataFrame.unionAll, tagged)
        .groupBy(F.col("run_id").alias("id"), "snapshot_date", "pulled_at")
        .agg(*(F.count_if(F.col("domain") == name).alias(f"{name}_count") for name in DOMAINS))
        .withColumns({
            "since_days": F.lit(since_days).cast("bigint"),
            "status": F.lit(STATUS_SUCCESS),
            "notes": F.lit(notes) if notes is not None else run_message(counts),
        })
        .select(*RUN_LOG_SCHEMA.fieldNames())
    )


def _observed(observation: Observation, rows: DataFrame) -> int:
    """The count that a write observed; a plan that Spark found to be empty observes nothing."""
    try:
        return observation.get["n"]
    except Py4JJavaError:
        if rows.isEmpty():
            return 0
        raise


class SnapshotStore:
    """Reads and writes one store folder. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        """A table of the store; one that nobody has written yet is empty."""
        path = f"{self.root}/{folder}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def _write(
        self, rows: DataFrame, folder: str, *partitions: str, one_partition: bool = False
    ) -> None:
        """Replace just the partitions the rows belong to.

        Rows of several partitions are rebalanced: Spark splits a large one
        over several tasks and files and puts small ones together. Rows of one
        partition are written as they come, which saves that shuffle.
        """
        (
            (rows if one_partition else rows.hint("rebalance", *partitions))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy(*partitions)
            .parquet(f"{self.root}/{folder}")
        )

    def _attempt_log(self) -> Log:
        return Log(self.spark, self.root, "run_log", _ATTEMPT_LOG_SCHEMA, "id", ["id"])

    def _stream_log(self) -> Log:
        return Log(self.spark, self.root, "stream_runs", _STREAM_RUNS_SCHEMA, "run_id", ["stream", "batch"])

    def _attempts(self) -> DataFrame:
        return self._attempt_log().rows()

    def run_log(self) -> DataFrame:
        return self._attempts().select(*RUN_LOG_SCHEMA.fieldNames())

    def next_run_id(self) -> int:
        """An id above every run that is logged or promised to a batch of a stream."""
        given = self.run_log().select("id").unionAll(self._stream_runs().select("run_id"))
        return (given.agg(F.max("id")).first()[0] or 0) + 1

    def _stream_runs(self) -> DataFrame:
        return self._stream_log().rows()

    def run_of_batch(self, stream: str, batch: int, as_of: datetime) -> tuple[int, datetime]:
        """The run and time of a stream's batch: given out once, looked up on every retry."""
        own = (F.col("stream") == stream) & (F.col("batch") == batch)
        known = self._stream_runs().filter(own).select("run_id", "as_of").first()
        if known:
            return known["run_id"], known["as_of"]
        run = self.next_run_id()
        row = self.spark.createDataFrame([(run, as_of, stream, batch)], _STREAM_RUNS_SCHEMA)
        self._write(row, "stream_runs", "stream", "batch", one_partition=True)
        return run, as_of

    def _refuse_settled(self, run: int) -> None:
        settled = self._read("settled_log", _SETTLED_LOG_SCHEMA).agg(F.max("generation")).first()[0] or 0
        if run <= settled:
            raise ValueError(f"run {run} is settled (up to {settled}) and can't be written again")

    def _write_tickets(
        self, stamped: Mapping[str, DataFrame], attempt: str, one_run: bool = False, once: Collection[str] = ()
    ) -> None:
        """Write the winners; of the domains in `once` each ticket has one row, so all rows are."""
        for name, rows in stamped.items():
            domain = DOMAINS[name]
            winners = keyed(rows) if name in once else last_write_wins(rows, domain)
            # The JSON copy is made of the winners, so it is not shuffled.
            self._write(
                with_payload(winners, domain).withColumn("attempt", F.lit(attempt)),
                f"runs/{name}", "snapshot_date", "run_id", "attempt", one_partition=one_run,
            )

    def _log(self, rows: DataFrame, attempt: str, one_run: bool = False) -> None:
        self._write(rows.withColumn("attempt", F.lit(attempt)), "run_log", "id", one_partition=one_run)

    def write_runs(
        self, stamped: Mapping[str, DataFrame], since_days: int, notes: str | None = None
    ) -> None:
        """Store stamped rows of one or more runs, then log the runs."""
        first = reduce(DataFrame.unionAll, (rows.select("run_id") for rows in stamped.values()))
        self._refuse_settled_rows(first)
        attempt = uuid.uuid4().hex
        self._write_tickets(stamped, attempt)
        self._log(run_log_rows(stamped, since_days, notes), attempt)

    def _refuse_settled_rows(self, runs: DataFrame) -> None:
        """Looks at the runs only where something is settled."""
        if self._read("settled_log", _SETTLED_LOG_SCHEMA).isEmpty():
            return
        lowest = runs.agg(F.min("run_id")).first()[0]
        if lowest is not None:
            self._refuse_settled(lowest)

    def store(
        self, snapshot: Snapshot, run_id: int | None = None, stable: bool = False, once: Collection[str] | None = None
    ) -> DataFrame:
        """Store one pull as one run and return its log row.

        A pull without any rows is a run too, so its row starts from zero counts.
        Frames that are `stable` give the same rows each time and are cheap to
        read, as landed files are. Then it is looked first whether ids repeat;
        where none does, the rows are written as they come. A caller that has
        looked itself names the domains whose ids do not repeat as `once`.
        """
        run = self.next_run_id() if run_id is None else run_id
        self._refuse_settled(run)
        as_of = snapshot.as_of
        if as_of is None:
            as_of = datetime.now(timezone.utc).replace(tzinfo=None)
        attempt = uuid.uuid4().hex
        pulled = {name: Observation() for name in snapshot.frames}
        # Rows are counted as they are written, so that log and table agree.
        stamped = {
            name: stamp(rows, run, as_of).observe(pulled[name], F.count(F.lit(1)).alias("n"))
            for name, rows in snapshot.frames.items()
        }
        if once is None:
            once = {name for name, rows in snapshot.frames.items() if stable and once_per_ticket(rows)}
        self._write_tickets(stamped, attempt, one_run=True, once=once)
        self._log(self._single_run_log(pulled, run, as_of, snapshot), attempt, one_run=True)
        return self.run_log().filter(F.col("id") == run)

    def _single_run_log(self, pulled, run, as_of, snapshot) -> DataFrame:
        counts = {
            name: F.lit(_observed(pulled[name], snapshot.frames[name]) if name in pulled else 0).cast("bigint")
            for name in DOMAINS
        }
        numbered = stamp(self.spark.range(1).select(), run, as_of).withColumns(
            {f"{name}_count": count for name, count in counts.items()}
        )
        note = {name: F.col(f"{name}_count") for name in DOMAINS}
        return numbered.withColumnRenamed("run_id", "id").withColumns({
            "since_days": F.lit(snapshot.since_days).cast("bigint"),
            "status": F.lit(STATUS_SUCCESS),
            "notes": F.lit(snapshot.notes) if snapshot.notes is not None else run_message(note),
        }).select(*RUN_LOG_SCHEMA.fieldNames())

    def run_rows(self, name: str, after: int = 0) -> DataFrame:
        """Rows of all finished runs after a given one, older ones of the same day included.

        The run is a partition column, so files of earlier runs are not read.
        """
        finished = self._attempts().filter(F.col("id") > after).select(
            F.col("id").alias("run_id"), "snapshot_date", "attempt"
        )
        schema = T.StructType([*DOMAINS[name].snapshot_schema.fields, _ATTEMPT])
        rows = self._read(f"runs/{name}", schema).filter(F.col("run_id") > after)
        return rows.join(finished, ["run_id", "snapshot_date", "attempt"], "left_semi").select(
            *DOMAINS[name].snapshot_columns
        )

    def _settled_log(self, name: str) -> DataFrame:
        log = self._read("settled_log", _SETTLED_LOG_SCHEMA)
        return log.filter(F.col("domain") == name)

    def _settled_up_to(self, name: str) -> int:
        """The run up to which dates are settled: one number, read when a plan is made."""
        return self._settled_log(name).agg(F.max("generation")).first()[0] or 0

    def _settled_rows(self, name: str) -> DataFrame:
        """Winners of every settled date, from the newest generation that holds it."""
        newest = self._settled_log(name).groupBy("snapshot_date").agg(
            F.max("generation").alias("generation")
        )
        schema = DOMAINS[name].snapshot_schema.add("generation", T.LongType())
        rows = self._read(f"settled/{name}", schema)
        return rows.join(newest, ["snapshot_date", "generation"], "left_semi").select(
            *DOMAINS[name].snapshot_columns
        )

    def _dates_after(self, run: int) -> DataFrame:
        return self.run_log().filter(F.col("id") > run).select("snapshot_date").distinct()

    def _contested(self, name: str, settled_run: int) -> DataFrame:
        """Winners of the dates that have runs after the settled one.

        A run holds a ticket once, so a date of a single run has no others and
        its rows pass straight through; only dates of several are shuffled.
        """
        fresh = self.run_rows(name, after=settled_run)
        runs = self.run_log().filter(F.col("id") > settled_run).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))
        single = runs.filter("n = 1").select("snapshot_date")
        if not settled_run:
            several = fresh.join(single, "snapshot_date", "left_anti")
            alone = fresh.join(single, "snapshot_date", "left_semi")
            return alone.unionByName(latest_run_wins(several)).select(*fresh.columns)
        settled = self._settled_rows(name)
        reopened = settled.join(self._dates_after(settled_run), "snapshot_date", "left_semi")
        new = single.join(self._settled_log(name).select("snapshot_date"), "snapshot_date", "left_anti")
        contested = latest_run_wins(reopened.unionByName(fresh.join(new, "snapshot_date", "left_anti")))
        return contested.unionByName(fresh.join(new, "snapshot_date", "left_semi"))

    def settled_dates(self, name: str) -> DataFrame:
        """(snapshot_date, generation) of the dates that no run after the settled ones has touched."""
        newest = self._settled_log(name).groupBy("snapshot_date").agg(F.max("generation").alias("generation"))
        return newest.join(self._dates_after(self._settled_up_to(name)), "snapshot_date", "left_anti")

    def current_of_dates(self, name: str, settled: DataFrame) -> DataFrame:
        """`current` rows of the dates with runs that are not settled, and of some settled dates (snapshot_date, generation)."""
        contested = self._contested(name, self._settled_up_to(name))
        schema = DOMAINS[name].snapshot_schema.add("generation", T.LongType())
        untouched = self._read(f"settled/{name}", schema).join(settled, ["snapshot_date", "generation"], "left_semi")
        return contested.unionByName(untouched.select(*contested.columns))

    def current(self, name: str) -> DataFrame:
        """One row per ticket and day: the last run that held the ticket.

        Settled dates without newer runs pass straight through; only the other
        dates are shuffled by ticket. The log tables that pick partitions have
        a row per run or date, and whether to broadcast them is Spark's size
        check.
        """
        settled_run = self._settled_up_to(name)
        contested = self._contested(name, settled_run)
        if not settled_run:
            return contested
        untouched = self._settled_rows(name).join(
            self._dates_after(settled_run), "snapshot_date", "left_anti"
        )
        return untouched.select(*contested.columns).unionByName(contested)

    def latest(self, name: str) -> DataFrame:
        """The newest row of each ticket.

        The settled ones are read as they were written down, by ranges of their
        number, so that a filter on it skips files and row groups. Newer runs
        are cut to a row per ticket; what they replace is taken out by a join
        with these alone, whose side is small.
        """
        settled_run = self._settled_up_to(name)
        newer = latest_run_per_ticket(self.run_rows(name, after=settled_run))
        folder = f"latest/{name}/generation={settled_run}"
        if not settled_run or not path_exists(self.spark, f"{self.root}/{folder}"):
            rows = self.run_rows(name, after=settled_run)
            return latest_run_per_ticket(self._settled_rows(name).unionByName(rows)) if settled_run else newer
        settled = self._read(folder, DOMAINS[name].snapshot_schema)
        if self.run_log().filter(F.col("id") > settled_run).isEmpty():
            return settled
        # Of a ticket's two rows the later date wins, then the later run, which is the newer one.
        marks = newer.select("sys_id", F.col("snapshot_date").alias("_date"))
        beside = settled.join(marks, "sys_id", "left")
        kept = beside.filter("_date IS NULL OR snapshot_date > _date").drop("_date")
        beaten = settled.select("sys_id", "snapshot_date").join(marks, "sys_id").filter("snapshot_date > _date").select("sys_id")
        return kept.select(*settled.columns).unionByName(newer.join(beaten, "sys_id", "left_anti").select(*settled.columns))

    def _write_latest(self, name: str, generation: int) -> None:
        """Write down the newest row of each ticket up to a generation, sorted by number over all files."""
        rows = self.latest(name).filter(F.col("run_id") <= generation)
        self._sorted(rows, "number", "sys_id").write.mode("overwrite").parquet(f"{self.root}/latest/{name}/generation={generation}")

    @staticmethod
    def _sorted(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)

    def settle(self, name: str) -> None:
        """Write down the winners of every date with runs not settled yet.

        Later reads of these dates need no shuffle. Runs up to this point must
        not be rewritten afterwards. The logs of runs are merged up to here.
        """
        generation = self.run_log().agg(F.max("id")).first()[0] or 0
        settled_run = self._settled_up_to(name)
        if generation <= settled_run:
            return
        tag = F.lit(generation).cast("bigint")
        winners = self._contested(name, settled_run).withColumn("generation", tag)
        self._write(winners, f"settled/{name}", "generation", "snapshot_date")
        self._write_latest(name, generation)
        marks = self._dates_after(settled_run).select(
            "snapshot_date", F.lit(name).alias("domain"), tag.alias("generation")
        )
        self._write(marks, "settled_log", "domain", "generation")
        # Settled runs are never written again, so their log entries can be merged.
        for log in (self._attempt_log(), self._stream_log()):
            log.checkpoint(generation)
        # Readers may still be at the generation before this one.
        for folder in finished_folders(self.spark, f"{self.root}/latest/{name}"):
            if int(folder.partition("=")[2]) < settled_run:
                remove(self.spark, f"{self.root}/latest/{name}/{folder}")
