"""Tables written to the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it back.
The folder is the one the session names in ``spark.checkpoint.dir``; only a
local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return f"{root.rstrip('/')}/lodestrata-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, uri: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; give the table read back and its path.

    The schema is passed to the reader, so nothing is inferred from the files
    and an empty table keeps its columns.
    """
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    for held in _OPEN:
        held.append(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def discard(spark: SparkSession, *uris: str) -> None:
    """Delete stored tables that no later step reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for uri in uris:
        path = _path(spark, uri)
        path.getFileSystem(conf).delete(path, True)


def store_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """``store``, with aggregates of the rows taken while they are written, so no job reads them again for that."""
    seen = Observation()
    back, uri = store(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), label)
    return back, uri, seen.get


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end every table stored within, whatever read it; results must be written or collected by then."""
    held: list[str] = []
    _OPEN.append(held)
    try:
        yield
    finally:
        _OPEN.remove(held)
        discard(spark, *held)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, a file or a folder of files."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
