"""Session settings, shared scratch folders and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "millwatch", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MILLWATCH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"Set {_CHECKPOINT_DIR} to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="millwatch-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system its scheme names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table of this library; any other path is refused."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError(f"{path} is not below the shared folder")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a glob pattern, sorted, on whatever file system its scheme names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return sorted(status.getPath().toString() for status in found or [])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def dimension(spark: SparkSession, **columns: tuple[str, ...]) -> DataFrame:
    """Every combination of a few fixed names, such as tier x class, with positions."""
    rows = spark.range(0, 1, 1, numPartitions=1)
    for name, values in columns.items():
        rows = rows.select(
            *[c for c in rows.columns if c != "id"],
            F.posexplode(literal_array(values)).alias(f"{name}_pos", name),
        )
    return rows
