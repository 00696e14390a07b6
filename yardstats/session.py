"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Used only when this package creates the session; an existing session keeps its
# own. Broadcast joins stay subject to Spark's own size check (no hints are used
# anywhere): a side above the threshold falls back to a shuffle join, which the
# adaptive planner splits when a key is hot.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Web pages travel to Python in batches of this many; a page may be megabytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("yardstats")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may go without the setting; it gets a fresh folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="yardstats-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_made: list[str] = []  # folders of intermediate results


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Delete the intermediate results that this process has stored; returns how many.

    Results are lazy, so call it when none that was derived from them is read any more.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_made)
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Store an intermediate result in the shared folder and read it from there.

    It is computed once however often it is used, survives lost executors, and
    its size is known to the planner.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Names and small texts in a folder that every executor can reach, whatever store it lies in."""

    def __init__(self, spark: SparkSession, base: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._text = spark._jvm.org.apache.commons.io.IOUtils.toString
        self._base = base.rstrip("/")
        self._store = self._path(self._base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self._base}/{name}" if name else self._base)

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing if there is none."""
        at = self._at(name)
        return sorted(x.getPath().getName() for x in self._store.listStatus(at)) if self._store.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._store.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._store.open(self._at(name))
        try:
            return self._text(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that readers see whole or not at all; it must not be there yet."""
        draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._store.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._store.exists(self._at(name)) or not self._store.rename(draft, self._at(name)):
            self._store.delete(draft, False)
            raise FileExistsError(f"{self._base}/{name}")

    def rename(self, name: str, to: str) -> None:
        if not self._store.rename(self._at(name), self._at(to)):
            raise OSError(f"{self._base}/{name} cannot be renamed")

    def delete(self, name: str) -> None:
        self._store.delete(self._at(name), True)


def settle_table(spark: SparkSession, path: str) -> None:
    """Finish the replacement of a table that broke off: the new rows if they are complete, else the old ones."""
    base, _, name = path.rstrip("/").rpartition("/")
    files = Files(spark, base)
    if files.exists(f"{name}__next/_SUCCESS"):
        files.delete(name)
        files.rename(f"{name}__next", name)
    elif files.exists(f"{name}__next"):
        files.delete(f"{name}__next")


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace a stored table by a result that may have been read from it.

    The result is first written beside the table, and takes its place when it is complete.
    Broken off before that, the table is as it was; after it, ``settle_table`` has the new rows in
    their place, which every next replacement does first. One writer at a time.
    """
    path = path.rstrip("/")
    df.write.mode("overwrite").parquet(f"{path}__next")
    settle_table(df.sparkSession, path)
