"""What every operator needs from the session: the shared folder, staged tables, table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode a temporary folder.

    A session on a cluster without the setting is an error, as a machine-local folder would not survive a lost executor.
    """
    known = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT, None)
    if known:
        return known
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError(f"set {_CHECKPOINT} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lymphspark-")
    spark.sparkContext.setCheckpointDir(made)
    atexit.register(_drop_local, made)
    return made


def _drop_local(url: str) -> None:
    if url.startswith(("file:", "/")):
        shutil.rmtree(url.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


class Stage:
    """Tables written to the shared folder to cut lineage; each can be dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._seen = 0
        # On any file system: results are lazy and may be read until the program ends.
        atexit.register(self._forget)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._seen += 1
        path = f"{self.root}/{self._seen:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stage_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Remove a table that write() returned. The caller vouches that nothing lazy reads it."""
        self._delete(df._stage_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _forget(self) -> None:
        """Remove all tables of the stage; a session that has ended leaves only local ones to remove."""
        try:
            self._delete(self.root)
        except Exception:
            _drop_local(self.root)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="lymphspark-package-")) / "lymphspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    atexit.register(_drop_local, str(target.parent))


def spread(df: DataFrame) -> DataFrame:
    """Small inputs of one file are spread over the cores before costly expressions; inputs with partitions enough stay as
    they are, so that nothing large is ever shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
