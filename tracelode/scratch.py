"""What plans share with executors: tables read more than once, and this package itself."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is known to have at most so many bytes (or rows of a known width).
BROADCAST_BYTES = 64 << 20

_own_dir: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of this machine, if all of Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tracelode-")
        spark.sparkContext.setCheckpointDir(f"file://{_own_dir[app]}")
    return f"file://{_own_dir[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tracelode/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_remove_staged)
    _staged.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _remove_staged() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone before the driver's Python; the files are scratch
            return


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives the loss of any executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` of ``row_bytes`` stay within ``limit``; else unchanged, so a shuffle join (split by AQE where it is skewed) is planned."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors' Python, once for each application. Without a session: to the active one's, if there is one."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    key = f"ship:{spark.sparkContext.applicationId}"
    if key in _own_dir:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tracelode-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _own_dir[key] = target
