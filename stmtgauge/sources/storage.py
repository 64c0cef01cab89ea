"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict[str, str | None] = {}
_OWN_FOLDERS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in its settings; only where none is set (tests, one machine) a local one."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _LOCAL_FOLDERS.setdefault(app, None) or tempfile.mkdtemp(prefix="stmtgauge-")
        _LOCAL_FOLDERS[app] = folder
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is; nothing happens when there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate data, inside one of the application that goes when its driver ends."""
    own = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(own)
        context = spark.sparkContext
        conf, path = context._jsc.hadoopConfiguration(), context._jvm.org.apache.hadoop.fs.Path(own)

        def clean() -> None:
            try:
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # noqa: BLE001  the JVM may have ended first
                pass

        atexit.register(clean)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The scan, or None when its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def materialize(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    For a result that several later steps read: its cost is paid once and the lineage ends at a table that survives
    lost executors.
    """
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan that keeps the cores busy.

    Shredding and normalizing are CPU work on narrow rows. A table of so few row groups that it would occupy less than
    half of the cores is spread out; a table with enough splits, as any large one, is read as it lies.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
