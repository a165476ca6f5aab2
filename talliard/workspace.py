"""Shared storage: where intermediate tables live and how versions are published.

Every table that cuts lineage is written below ``spark.checkpoint.dir``, the folder that all executors share. Only a
``local[...]`` session, which has no other machines, may fall back to a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in a local session without one, a new temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="talliard-")
    spark.conf.set("spark.checkpoint.dir", at)
    spark.sparkContext.setCheckpointDir(at)
    atexit.register(_remove_local, at)
    return at


def _remove_local(at: str) -> None:
    import shutil

    shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the application's part of the shared folder that nothing else uses; the first write creates it."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/talliard/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes all that this application wrote for itself below the shared folder. Results that are still to be read go too."""
    file = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)
    _shipped.discard(spark.sparkContext.applicationId)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once below the shared folder and reads it back: a lost executor never forces a second evaluation, so
    values that depend on row order or on chance stay the same for all later readers."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer parts than there are: a few large row groups would keep most of them idle. What
    then moves is less than one part per core; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: A table is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if counting finds at most ``rows`` rows; else df itself, to be joined by a shuffle whose
    hot partitions adaptive execution splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Bucketed:
    """Tables whose files are hashed into sorted buckets by a column: joins and aggregates on it leave their rows where they
    are. The session's catalog knows a table only inside the ``with``; its files stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def __enter__(self) -> "Bucketed":
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _name(self) -> str:
        self.names.append(f"talliard_{uuid.uuid4().hex}")
        return self.names[-1]

    def save(self, df: DataFrame, by: str, path: str, buckets: int) -> DataFrame:
        name = self._name()
        writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
        writer.bucketBy(buckets, by).sortBy(by).saveAsTable(name)
        return self.spark.table(name)

    def open(self, ddl: str, by: str, path: str, buckets: int) -> DataFrame:
        name = self._name()
        how = f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet {how} LOCATION '{path}'")
        return self.spark.table(name)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once per application: they needn't have it installed, nor run
    where the driver runs."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    at = f"{fresh_dir(spark, 'package')}.zip"
    file = spark._jvm.org.apache.hadoop.fs.Path(at)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, False)
    stream.write(bytearray(raw.getvalue()))
    stream.close()
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


class VersionLog:
    """A directory of numbered JSON manifests. The newest one is the state of a table; publishing is one rename that
    fails if the number is taken, so a crash before it leaves no trace and two writers can't both succeed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _file(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def current(self) -> tuple[int, dict]:
        """(number, manifest) of the newest version; (0, {}) before the first."""
        where = self._fs.Path(self.path)
        fs = where.getFileSystem(self._conf)
        if not fs.exists(where):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        done = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not done:
            return 0, {}
        return max(done), json.loads(self._read(self._file(f"{max(done):010d}.json")))

    def _read(self, file) -> str:
        stream = file.getFileSystem(self._conf).open(file)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, number: int, manifest: dict) -> None:
        """Makes manifest the version ``number``; raises FileExistsError if another writer took that number."""
        target, temp = self._file(f"{number:010d}.json"), self._file(f"_{uuid.uuid4().hex}.tmp")
        fs = target.getFileSystem(self._conf)
        stream = fs.create(temp, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        sc = self.spark.sparkContext
        kind = getattr(self._fs, "Options$Rename")
        none = sc._gateway.new_array(kind, 0)
        try:
            self._fs.FileContext.getFileContext(target.toUri(), self._conf).rename(temp, target, none)
        except Exception as e:
            fs.delete(temp, False)
            if fs.exists(target):
                raise FileExistsError(f"version {number} of {self.path} was published by another writer") from e
            raise

    def names(self, path: str) -> list[str]:
        """Names of the folders in a folder; none if it doesn't exist."""
        where = self._fs.Path(path)
        fs = where.getFileSystem(self._conf)
        found = fs.listStatus(where) if fs.exists(where) else []
        return [s.getPath().getName() for s in found if s.isDirectory()]

    def delete(self, path: str) -> None:
        where = self._fs.Path(path)
        where.getFileSystem(self._conf).delete(where, True)


__all__ = ["Bucketed", "VersionLog", "broadcast_if_small", "clean", "fresh_dir", "materialize", "shared_dir", "ship", "spread"]
