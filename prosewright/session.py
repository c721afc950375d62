"""Spark sessions for tests, benches and the command line; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    shuffles = 8 if cpus == "*" else int(cpus)
    conf = {
        "spark.sql.shuffle.partitions": shuffles,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("prosewright").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
