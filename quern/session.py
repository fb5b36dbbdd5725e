"""What the library asks of a session: that Python workers can import it, and a folder that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_own: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Adds this package's folder to the workers' path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own if all executors run in this machine's one JVM, else an error."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    sc.setCheckpointDir(made := tempfile.mkdtemp(prefix="quern-shared-"))
    return f"file://{made}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver's JVM ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _own:
        made = sc._jvm.org.apache.hadoop.fs.Path(path := f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}")
        store = made.getFileSystem(sc._jsc.hadoopConfiguration())
        store.mkdirs(made)
        store.deleteOnExit(made)
        _own.clear()
        _own[sc.applicationId] = path
    return f"{_own[sc.applicationId]}/{uuid.uuid4().hex[:12]}-{name}"


def is_folder(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_folder() gave."""
    sc = spark.sparkContext
    gone = sc._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)
