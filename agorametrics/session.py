"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Report keys and month keys are UTC. Skewed joins are split at run time, also where
# that costs one more shuffle; writes and joins get partitions sized by bytes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}

# For streams on a cluster: state larger than the executors' heap.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own for a stream, with the stream settings; ``spark`` keeps its own.

    ``partitions`` is how many parts the stream's state is kept in. Read the stream from it.
    """
    session = spark.newSession()
    for key, value in {**SETTINGS, **STREAM_SETTINGS}.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    return session


def local_session(name: str, cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
