"""Session settings this library relies on, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that decide results (time zone) or plan shape (adaptive execution).
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method above 8,000 bytes; such a stage is run as projections of small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = 8, name: str = "clearcase") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs more than building the column it annotates.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RESULT_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where none is set (tests), a folder of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
