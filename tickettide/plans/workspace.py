"""Where jobs put what they write."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SHARED_FOLDER_SETTINGS = ("spark.checkpoint.dir", "spark.sql.warehouse.dir")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: the checkpoint folder, else the warehouse.

    A warehouse in a local folder will do where driver and tasks are one
    process; elsewhere it is an error, since other machines don't see it.
    """
    named = ((setting, spark.conf.get(setting, None)) for setting in SHARED_FOLDER_SETTINGS)
    setting, folder = next((s, f) for s, f in named if f)
    local = folder.startswith(("file:", "/"))
    if setting == SHARED_FOLDER_SETTINGS[1] and local and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {SHARED_FOLDER_SETTINGS[0]} to a folder that all machines see; the warehouse is local: {folder}")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/tickettide/{purpose}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a path whose writing has ended well."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = [status.getPath() for status in system.listStatus(place) if status.isDirectory()]
    return [folder.getName() for folder in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark knows, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Give a folder another place in the same file system."""
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    system = here.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(there.getParent())
    if not system.rename(here, there):
        raise FileNotFoundError(f"{path} could not be moved to {target}")


#: Shuffle files go as what made them ends. Otherwise they stay until the driver happens to
#: collect its garbage, which one that does little but plan may not do for hours.
_LITTLE_DISK = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # A task that writes a few partitions keeps a file open for each instead of sorting its rows, which spills.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


@contextmanager
def little_disk(spark: SparkSession) -> Iterator[None]:
    """What is run inside keeps no shuffle files and does not sort rows by the folders they go to."""
    before = {setting: spark.conf.get(setting, None) for setting in _LITTLE_DISK}
    try:
        for setting, value in _LITTLE_DISK.items():
            spark.conf.set(setting, value)
        yield
    finally:
        for setting, value in before.items():
            if value is None:
                spark.conf.unset(setting)
            else:
                spark.conf.set(setting, value)
