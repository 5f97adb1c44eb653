"""Session settings for local runs and tests (a cluster brings its own)."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gridsla") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in SQL_SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(input_bytes: int, executor_cores: int = 4, executors: int = 1000,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Suggested SQL settings for a run over ``input_bytes`` of job, alarm and import logs.

    Scan splits of ``target_partition_bytes``; shuffle partitions sized so a
    partition stays near the AQE advisory size even before coalescing (AQE
    then merges small ones and splits skewed join partitions by map output);
    at least two waves of tasks over the cluster's cores.
    """
    cores = executor_cores * executors
    shuffle = max(2 * cores, input_bytes // target_partition_bytes)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "gridsla.broadcast.maxRows": "2000000",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    for k, v in settings.items():
        spark.conf.set(k, v)
    return spark
