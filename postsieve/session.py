"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Cluster-neutral settings. Partition counts are left to the cluster: AQE coalesces from
# `spark.sql.shuffle.partitions`, which the operator of the cluster sizes for the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "postsieve", cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; production jobs bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without that setting a local session gets a private folder; a cluster has no folder that its executors
    share unless one is named, so there it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not is_local(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="postsieve-checkpoint-"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a private folder is shared by all."""
    return master == "local" or master.startswith("local[")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared checkpoint folder; nothing is made yet."""
    return f"{checkpoint_dir(spark)}/{kind}/{uuid.uuid4()}"


def stage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder and reads it back.

    For rows that are costly to make and read more than once. Unlike a checkpoint of rows the table
    is columnar, so a reader that needs two columns scans two columns. ``drop_staged`` removes the
    tables once their readers are done.
    """
    spark = df.sparkSession
    path = new_folder(spark, "staged")
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def staged_tables() -> list[str]:
    return list(_STAGED)


def drop_staged(spark: SparkSession, keep: Sequence[str] = ()) -> None:
    """Removes the staged tables of this process but those in ``keep``; frames that read them end with it."""
    for path in [p for p in _STAGED if p not in keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _STAGED.remove(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
