"""SparkSession factory with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "semforge", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    settings = DEFAULTS | {
        "spark.driver.memory": os.environ.get("SEMFORGE_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(cpus if str(cpus).isdigit() else 8),
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
