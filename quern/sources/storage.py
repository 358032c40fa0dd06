"""Saved intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder set on its context.

    Where neither is set, one process (``local[...]``, as in tests) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if current := context.getCheckpointDir():
        return current.rsplit("/", 1)[0]
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-checkpoints-"))
    return context.getCheckpointDir().rsplit("/", 1)[0]


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: cuts lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """A folder of tables and small committed records on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def commit(self, name: str, record: dict) -> None:
        """Write a record under a temporary name and rename it; readers see all of it or nothing. A name is committed once."""
        temporary = self._path(f"_{name}-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        if self._fs.exists(self._path(f"{name}.json")) or not self._fs.rename(temporary, self._path(f"{name}.json")):
            raise OSError(f"{self.path(name)} could not be committed")

    def last(self, prefix: str) -> int:
        """The greatest number n of the committed records ``<prefix>-<n>``, 0 without any."""
        return max((int(x[len(prefix) + 1 : -5]) for x in self.names() if x.startswith(f"{prefix}-") and x.endswith(".json")), default=0)

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def exists(self, name: str) -> bool:
        """Whether a table was written to its end."""
        return self._fs.exists(self._path(f"{name}/_SUCCESS"))

    def read(self, name: str) -> dict | None:
        """The committed record, if there is one."""
        where = self._path(f"{name}.json")
        if not self._fs.exists(where):
            return None
        found = self._fs.open(where)
        try:
            return json.loads(bytes(found.readAllBytes()))
        finally:
            found.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
