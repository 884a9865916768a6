"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str | None] = {}


def build_session(app: str = "gleaner", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings that the engine expects on a cluster too (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLEANER_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for `purpose` under spark.checkpoint.dir, which all executors share.

    Only where that setting is unset and the master is this one process, as in
    tests, a temporary folder is made; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="gleaner-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back; cuts the lineage.

    Unlike a local checkpoint the copy outlives the executors that wrote it.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table that materialize() made and that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(spark, parent)


def drop_path(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def wide(spark: SparkSession) -> int:
    """Partitions for a stage of heavy Python work: two per core, or the shuffle setting, if larger."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df in enough partitions to keep every core busy; a scan of few files is dealt out anew, others stay."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wide(df.sparkSession)) if few else df
