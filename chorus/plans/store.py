"""Stage tables: materialise a pipeline stage once, read it many times.

The pipeline's stage outputs (cleaned rows, flagged rows) feed many reports.
Writing them as Parquet under the shared checkpoint folder
(``spark.checkpoint.dir``) cuts the lineage -- a lost executor re-reads the
table instead of recomputing the regex/UDF chain -- and lets every report
read only the columns it needs.  Tables are memoised per application and key.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chorus.session import ensure_checkpoint_dir

def input_stamp(spark: SparkSession, path: str) -> str:
    """Path, size and time of an input's files: a stage table is reused only for the same input."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if not fs.exists(place):
        return path
    files = fs.listStatus(place)
    return f"{path}:" + ",".join(sorted(f"{f.getLen()}-{f.getModificationTime()}" for f in files))


_TABLES: dict[tuple[str, str], str] = {}


def stage_table(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per (application, key) to the checkpoint folder; return a scan of it."""
    app = spark.sparkContext.applicationId
    path = _TABLES.get((app, key))
    if path is None:
        root = ensure_checkpoint_dir(spark).rstrip("/")
        safe = re.sub(r"[^A-Za-z0-9_.=-]+", "_", key)[-60:]
        digest = hashlib.md5(key.encode()).hexdigest()[:10]
        path = f"{root}/stage-tables/{safe}-{digest}-{uuid.uuid4().hex[:8]}"
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _TABLES[(app, key)] = path
    return spark.read.parquet(path)


def forget(spark: SparkSession | None = None) -> None:
    """Drop the memo (tables stay on storage; the checkpoint folder's owner cleans it)."""
    if spark is None:
        _TABLES.clear()
        return
    app = spark.sparkContext.applicationId
    for k in [k for k in _TABLES if k[0] == app]:
        _TABLES.pop(k)


def write_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the checkpoint folder and return a scan of it (no memo)."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    safe = re.sub(r"[^A-Za-z0-9_.=-]+", "_", name)[-60:]
    path = f"{root}/stage-tables/{safe}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def table_stage(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A ``stage`` hook that always writes (for iterative operators)."""
    return write_table(build(), name)
