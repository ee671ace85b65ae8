"""Tables between the rounds of an iterative plan.

They are written to the folder that driver and executors share
(``spark.checkpoint.dir``), so a lost executor costs a re-read and lineage ends at
every round. Where that is unset, a local session, whose driver is its executor,
uses a temporary folder; a cluster gets an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="ringflow-"))
    return _LOCAL[0]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted with the tables."""
    path = f"{shared_dir(spark)}/ringflow/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clear_tables)
    _WRITTEN.append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ringflow_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of ``write_table`` that nothing will read again."""
    for table in tables:
        path = table._ringflow_path
        _delete(table.sparkSession, path)
        _WRITTEN.remove(path)


def clear_tables() -> None:
    """Delete what this process has written (also run at exit)."""
    spark = SparkSession.getActiveSession()
    while _WRITTEN:
        path = _WRITTEN.pop()
        try:
            if spark is not None:
                _delete(spark, path)
        except Exception:  # the session may already be gone; the cluster's own clean-up follows
            return
