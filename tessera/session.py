"""A session with the settings that the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive, in UTC. On a cluster ``master`` and sizes come from spark-submit; locally, from the cores."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    if master:
        cores = "".join(c for c in master if c.isdigit()) or str(os.cpu_count())
        builder = builder.master(master)
        settings |= {"spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
