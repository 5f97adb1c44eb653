"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names; where
it is unset, to the session's warehouse folder (on a cluster only if that is no
local path). Driver and executors share it, so a lost executor loses no
intermediate row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsla.plans.materialize import shared_dir

MAX_BROADCAST_ROWS = 100_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name for ``F.col`` that may hold any character."""
    return "`" + name.replace("`", "``") + "`"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (lineage is cut)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridsla-llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # nothing reads this job's shuffles after the table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridsla_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the folder of a materialised table that no later plan reads."""
    path = getattr(df, "_gridsla_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a materialised table counted at ``max_rows`` rows or fewer."""
    return F.broadcast(df) if df.count() <= max_rows else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node: columns ``id``, ``component``.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and loops do
    not matter; an empty table gives an empty result. Each round takes the least
    label among the neighbours and then follows the label of that label, so the
    number of rounds grows with the logarithm of the longest chain. All joins
    are between freshly read tables, which lets AQE split a node with many links.
    The result is a written table, which ``discard`` deletes.
    """
    links = materialize(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .where("src <> dst").distinct())
    labels = materialize(links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
                         .select("id", F.least("id", "m").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        seen = (links.join(labels.select(F.col("id").alias("src"), F.col("component").alias("c")), "src")
                .groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c")))
        best = labels.join(seen, "id").select("id", "component", F.least("component", "c").alias("via"))
        step = labels.select(F.col("id").alias("via"), F.col("component").alias("jump"))
        new = materialize(best.join(step, "via").select(
            "id", F.col("jump").alias("component"), (F.col("jump") < F.col("component")).alias("moved")))
        discard(labels)
        labels = new
    discard(links)
    found = labels.select("id", "component")
    found._gridsla_path = labels._gridsla_path
    return found
