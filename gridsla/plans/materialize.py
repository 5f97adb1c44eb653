"""Materialising small intermediates and broadcasting them only behind a size check.

A per-batch table (one row per task, day and guid) is tiny next to the job log,
but its size is not known when the plan is built. It is written once as Parquet to the
folder that ``spark.checkpoint.dir`` names (where it is unset, to the session's warehouse folder, on a
cluster only if that is no local path). Driver and executors share it, so a lost executor loses no row and the lineage is cut.
A broadcast is hinted only below a row bound; above it the join stays a shuffle join, where AQE can
still convert it or split skewed keys at run time.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a per-batch table that may be broadcast (about 100 bytes a row).
DEFAULT_BROADCAST_ROWS = 2_000_000
BROADCAST_ROWS_CONF = "gridsla.broadcast.maxRows"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the session's warehouse folder.

    On a cluster the warehouse counts as shared only with a file system of its own (not a local path, which is
    each machine's): otherwise a ValueError asks for the setting.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    folder = given or spark.conf.get("spark.sql.warehouse.dir")
    master = spark.sparkContext.master
    one_machine = master.startswith("local") and not master.startswith("local-cluster")
    if not given and not one_machine and urlparse(folder).scheme in ("", "file"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share ({folder} is a local path)")
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridsla-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._gridsla_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` wrote."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._gridsla_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


def broadcast_if_small(done: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``done`` (already materialised, so counting is a cheap read) with a broadcast
    hint if it has at most ``max_rows`` rows; otherwise unhinted (shuffle join)."""
    limit = broadcast_row_limit(done.sparkSession) if max_rows is None else max_rows
    rows = done.limit(limit + 1).count()
    return F.broadcast(done) if rows <= limit else done


def broadcast_if_rows(df: DataFrame, rows: int, max_rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint when its known row count is within the bound."""
    limit = broadcast_row_limit(df.sparkSession) if max_rows is None else max_rows
    return F.broadcast(df) if rows <= limit else df


def checked_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Materialise ``df``; broadcast it only below the row bound."""
    return broadcast_if_small(materialize(df), max_rows)
