"""Tables written between stages, in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where it is unset and Spark runs on one machine, as in tests, a temporary folder is made
    and set; executors elsewhere couldn't read that, so there an error is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local_dir()
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def _local_dir() -> str:
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="insumo-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return _made[0]


#: Spark's setting that shuffle files go when the statement that wrote them ends, not when the driver next collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """The rows of df from a Parquet table written now. The table stays until forget() or the session's end, as results read it.
    release: the shuffle files that were needed to write it are removed at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/insumo-{uuid.uuid4().hex}-{name}"
    was = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if was is None else spark.conf.set(RELEASE, was)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of saved() that nothing reads any more, as those of finished rounds."""
    for t in tables:
        if path := getattr(t, "saved_at", None):
            _drop(t.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a table at the driver's end; if Spark has stopped, only a local one can be."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        shutil.rmtree(Path(path.removeprefix("file://")), ignore_errors=True)
