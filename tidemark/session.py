"""Session settings that the engine's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "tidemark", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    return configure((builder.master(master) if master else builder).getOrCreate())


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path that nothing uses yet, in the folder that driver and executors share; a local master without one takes a temporary folder."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{kind}-{uuid.uuid4().hex}"
