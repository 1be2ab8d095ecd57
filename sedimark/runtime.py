"""Session helpers: where lineage is cut and how table paths are read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SENT: set[str] = set()


def send_package(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the executors' Python workers, wherever the driver found it. Once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        _SENT.add(app)
        here = Path(__file__).resolve().parent
        folder = tempfile.TemporaryDirectory(prefix="sedimark-")
        atexit.register(folder.cleanup)
        # addPyFile hands the archive to every executor over Spark's own file server
        with zipfile.ZipFile(f"{folder.name}/{here.name}.zip", "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(f"{folder.name}/{here.name}.zip")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor can reach.

    Only a local[...] session may go without one; it then gets a folder of its own, kept for the session.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        tmp = tempfile.TemporaryDirectory(prefix="sedimark-")
        atexit.register(tmp.cleanup)
        _OWN[app] = "file://" + tmp.name
    return _OWN[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the application's folder in the shared one; release deletes it."""
    return f"{shared_dir(spark)}/sedimark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this application has staged. Results that read staged tables must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sedimark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Timestamps without a zone are taken as UTC."""
    df = send_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    fix = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(fix) if fix else df
