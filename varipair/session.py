"""One place that builds a SparkSession with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "varipair", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session: adaptive execution and ANSI mode on, time zone UTC. On a cluster the
    submitting tool sets master and sizes; operators only read settings from the session."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": os.environ.get("VARIPAIR_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share. Only a session on one machine may go without
    that setting (tests); it gets a temporary folder."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/varipair-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """df as a table in a scratch folder, read again: cuts lineage, so that a lost executor recomputes nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
