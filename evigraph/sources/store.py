"""Tables as versioned parquet folders; the newest version that is marked as complete is in force."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


#: Names of the files that mark versions as complete.
MARK = "_at_"


class Store:
    """Reads and writes of named tables; a write becomes visible at once, when its version is marked.

    Paths go through Spark's file system, so a folder may be local or shared. Readers of an old version aren't
    disturbed: versions stay until vacuum.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self, name: str) -> str | None:
        """The newest version that was marked as complete."""
        fs, root = self._fs(f"{self.folder}/{name}")
        if not fs.exists(root):
            return None
        marks = [s.getPath().getName() for s in fs.listStatus(root)]
        return max((m[len(MARK) :] for m in marks if m.startswith(MARK)), default=None)

    def _point(self, name: str, version: str) -> None:
        fs, path = self._fs(f"{self.folder}/{name}/{MARK}{version}")
        fs.create(path, True).close()  # a file is there or not: no reader sees a state between

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[name])

    def read(self, name: str) -> DataFrame:
        """The table, empty if it was never written or its folder is gone."""
        version = self._pointer(name)
        if version is None or not (lambda x: x[0].exists(x[1]))(self._fs(f"{self.folder}/{name}/{version}")):
            return self.empty(name)
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table; df may read the version it replaces. Edges are partitioned by kind, so kinds are pruned."""
        version = f"v{time.time_ns()}"
        columns = [f.name for f in self.empty(name).schema.fields]
        writer = df.select(*columns).write
        if name == "edges":
            writer = writer.partitionBy("kind")
        writer.parquet(f"{self.folder}/{name}/{version}")
        self._point(name, version)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to the version in force."""
        version = self._pointer(name)
        if version is None:
            self.write(name, df)
        else:
            columns = [f.name for f in self.empty(name).schema.fields]
            df.select(*columns).write.mode("append").parquet(f"{self.folder}/{name}/{version}")

    def vacuum(self, name: str) -> None:
        """Delete the versions that aren't in force."""
        current = self._pointer(name)
        fs, root = self._fs(f"{self.folder}/{name}")
        for status in fs.listStatus(root):
            found = status.getPath().getName()
            if current and found.removeprefix(MARK).startswith("v") and found.removeprefix(MARK) != current:
                fs.delete(status.getPath(), True)
