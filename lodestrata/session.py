"""Session construction for stand-alone use and tests.

On a cluster the session is the caller's: nothing here is required there, the
library only ever reads settings from the session it is given.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "lodestrata", cores: int | None = None, partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings every operator is tested under (UTC, ANSI, AQE)."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="lodestrata-shared-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="lodestrata-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
