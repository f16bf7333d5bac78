"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster sets to a folder that all executors share.

    Where it is missing in a local session, as in tests, a folder of our own is
    chosen once and set on the context; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when Python ends."""
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget_all)
    _written.append((spark, path))
    return path


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: a cut in the lineage that
    survives lost executors, at columnar size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(path: str) -> None:
    """Delete one written table, which nothing may read any more."""
    for k, (spark, p) in enumerate(_written):
        if p == path:
            del _written[k]
            _delete(spark, p)
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget_all() -> None:
    """Delete every written table (frames that read them stop working)."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return
