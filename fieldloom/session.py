"""Session and shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fieldloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir`` or, where that is unset, a
    folder in the warehouse, which driver and executors also share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return root.rstrip("/")


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """A new path below the folder that the cluster shares."""
    return "/".join([shared_root(spark), "fieldloom", uuid.uuid4().hex, *parts])


def stored(frame: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut in the lineage that survives
    the loss of executors."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
