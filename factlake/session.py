"""Session settings and the places where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_ROOT: list[str] = []
_USED: set[str] = set()


def build_session(app: str = "factlake", cores: int | str = "*", memory: str = "8g", **conf) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster use the session given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by all executors. Only where none is set, and only in local mode, one is made here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        path = tempfile.mkdtemp(prefix="factlake-")
        _LOCAL_ROOT.append(path)
        owner = os.getpid()
        atexit.register(lambda: os.getpid() == owner and shutil.rmtree(path, ignore_errors=True))
    return f"file://{_LOCAL_ROOT[0]}"


def own_folder(spark: SparkSession) -> str:
    """The folder of this application; it goes when the driver's program ends, or by sweep()."""
    path = f"{checkpoint_root(spark)}/factlake/{spark.sparkContext.applicationId}"
    if path not in _USED:
        _USED.add(path)
        atexit.register(_sweep_at_exit, spark, os.getpid())
    return path


def sweep(spark: SparkSession) -> None:
    """Delete everything that this application has written with cut(): once the results made so far have been read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep_at_exit(spark: SparkSession, owner: int) -> None:
    if os.getpid() == owner and spark.sparkContext._jsc is not None:
        try:
            sweep(spark)
        except Exception:  # the JVM is gone already; a folder is left, results are not touched
            pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: one pass, survives the loss of executors, ends the lineage."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factlake_cut = path
    return out


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """cut() and aggregates of the rows, taken while they are written: no further pass for a stop test."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
    return out, seen.get


def drop_cut(*frames: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_factlake_cut", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
