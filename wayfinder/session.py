"""Session defaults and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session as the tests and the benchmark use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("wayfinder").config("spark.sql.shuffle.partitions", partitions).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", memory).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one only where driver and executors are one machine."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """df in the reliable checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
