"""The session of the tests: local mode, few partitions, a shared folder of its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gleaner-tests-"))
        .getOrCreate()
    )
