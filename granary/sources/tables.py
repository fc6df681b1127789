"""Parquet tables of a data directory."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: The folder of this process, where the session names none.
_own: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed on every node (or sent with --py-files); this only adds the
    driver's checkout to the workers' PYTHONPATH, which costs nothing where it does not exist.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of ``sf_dir``; a file or a directory of files."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of this machine only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="granary-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = _own[0]
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's own part of the shared folder; all of that is deleted when the application ends."""
    own = f"{shared_folder(spark)}/granary-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own)
    # The file system keeps a set of what it deletes at its end.
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to a new folder in the shared one, and read from there: for tables that several branches of a plan use."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
