"""Readers for the three inputs and their canonical schemas.

Canonical columns (types as used by every operator):

* jobs:    job_id bigint, task string, guid string, status string, meterid string,
           createddate timestamp_ntz, completiondatetime timestamp_ntz (nullable)
* alarms:  meterid string, alarm_date timestamp_ntz, alarm_names string
* imports: meter_id string, das_rtc timestamp_ntz

Inputs named as in the source system (``mdastaskname`` ...) are renamed. Every
reader returns a lazy DataFrame, so Catalyst pushes filters and column pruning
into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB_COLUMNS = ("job_id", "task", "guid", "status", "meterid", "createddate", "completiondatetime")
ALARM_COLUMNS = ("meterid", "alarm_date", "alarm_names")
IMPORT_COLUMNS = ("meter_id", "das_rtc")

# Source-system column names -> canonical names.
SOURCE_NAMES = {
    "mdastaskname": "task",
}

_TYPES = {
    "job_id": "bigint", "task": "string", "guid": "string", "status": "string",
    "meterid": "string", "createddate": "timestamp_ntz", "completiondatetime": "timestamp_ntz",
    "alarm_date": "timestamp_ntz", "alarm_names": "string",
    "meter_id": "string", "das_rtc": "timestamp_ntz",
}


def conform(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rename source names, check presence, cast to the canonical types, project."""
    for src, dst in SOURCE_NAMES.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select(*[F.col(c).cast(_TYPES[c]).alias(c) for c in columns])


def conform_jobs(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """The job log in canonical columns.

    ``id_column`` names the job key. Without it and without a column job_id, the key is a hash of the
    row's columns: it does not depend on partitioning, and rows equal in all columns share a key.
    """
    if id_column is not None:
        df = df.withColumn("job_id", F.col(id_column))
    elif "job_id" not in df.columns:
        df = df.withColumn("job_id", F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    return conform(df, JOB_COLUMNS)


def conform_alarms(df: DataFrame) -> DataFrame:
    return conform(df, ALARM_COLUMNS)


def conform_imports(df: DataFrame) -> DataFrame:
    return conform(df, IMPORT_COLUMNS)


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """A catalog table name (fmt='table'), or a path in any Spark file format."""
    if fmt == "table":
        return spark.read.table(source)
    return spark.read.format(fmt).options(**options).load(source)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower_bound=None, upper_bound=None, num_partitions: int | None = None,
              **options) -> DataFrame:
    """A table of a relational database through Spark's JDBC source.

    Give ``partition_column`` with bounds to read in parallel slices; without it
    the read is one task.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions or 64))
    return reader.options(**options).load()
