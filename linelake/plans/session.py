"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder of spark.checkpoint.dir, where the loss of an executor doesn't touch it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="linelake-"))
    return df.checkpoint()
