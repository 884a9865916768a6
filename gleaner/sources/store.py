"""A project's tables in one folder, with snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.vectors import cluster_key


class Store:
    """Named parquet tables under a folder that all executors reach. A table is written aside and then moved into place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/.new/{name}")
        new, fs = self._path(".new", name)
        old, _ = self._path(name)
        fs.delete(old, True)
        fs.rename(new, old)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def load(self, name: str) -> DataFrame:
        """The table; corrupt files are passed over."""
        return self.spark.read.option("ignoreCorruptFiles", "true").parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def names(self) -> list[str]:
        path, fs = self._path()
        return sorted(n for f in (fs.listStatus(path) if fs.exists(path) else []) if not (n := f.getPath().getName()).startswith((".", "_")))

    def clear(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def snapshot(self, label: str) -> None:
        """A copy of all tables as they are."""
        for name in self.names():
            self.load(name).write.mode("overwrite").parquet(f"{self.root}/_snapshots/{label}/{name}")

    def restore(self, label: str) -> None:
        for name in Store(self.spark, f"{self.root}/_snapshots/{label}").names():
            self.save(name, self.spark.read.parquet(f"{self.root}/_snapshots/{label}/{name}"))

    def cached(self, kind: str, make, **spec) -> DataFrame:
        """The table of a result with these settings, made if it isn't there: a bank by its source and time, a clustering by its spec."""
        name = f"{kind}-{cluster_key(**spec)[:16]}"
        if not self.has(name):
            self.save(name, make())
        return self.load(name)
