"""Session helpers: a local session for tests, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int = 8, memory: str = "12g", app: str = "quillspan") -> SparkSession:
    """A single-JVM session with adaptive execution, UTC and one shuffle partition a core."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillspan-ship-")) / "quillspan_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join(root.name, path.relative_to(root)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder named in spark.checkpoint.dir as checkpoint folder; a temporary one only where none is named and the master is local."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def working_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, deleted when the application ends."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{shared.rstrip('/')}/quillspan-{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """`df` written to the shared folder and read back, so that it is worked out once and later readers take the columns they need.

    A checkpoint would work the last stage out twice and keep whole rows without statistics.
    """
    path = working_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, by whatever store Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
