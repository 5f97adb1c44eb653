"""Vector bin packing of documents into shards (bytes, tokens and rows together)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsla.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of non-negative bytes, tokens, rows).

    Largest first. A shard whose byte capacity is open takes part, and the one
    with the largest dot product of the item and its residual capacity gets the
    item; with none open, the one with the most bytes left.
    """
    total = np.maximum(items.sum(axis=0), 1e-9)
    need = items / total * shards  # in units of one shard's capacity
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -need[:, 0])):
        open_ = left[:, 0] >= need[i, 0]
        fit = left @ need[i]
        s = int(np.argmax(np.where(open_, fit, -np.inf))) if open_.any() else int(np.argmax(left[:, 0]))
        out[i] = s
        left[s] -= need[i]
    return out


def shard_documents(docs: DataFrame, shards: int = 24, bundles_per_shard: int = 400,
                    whole_group_share: int = 16, rows_per_slot_bucket: int = 2_000) -> DataFrame:
    """Shard and gapless slot of every document.

    Groups are documents of equal text. A group stays whole unless it is larger than
    ``1 / whole_group_share`` of a shard; then its rows are dealt out in turn, whatever their doc_ids. Small
    groups go by a hash of their text into ``shards * bundles_per_shard`` bundles; groups
    above an average bundle are items of their own, at most two per bundle in number
    (one by bytes, one by rows). The placement thus handles a number of items bounded by
    the parameters, whatever the table's size; all else is aggregates and joins.

    Null text counts as empty, null doc_id is kept, repeated rows get slots of their own,
    an empty table gives an empty result, other columns are ignored.
    Returns doc_id, size, tokens, text_crc32, shard, slot.
    """
    spark = docs.sparkSession
    n_bundles = shards * bundles_per_shard
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select(F.col("doc_id"), text.alias("t")).select(
        "doc_id", (F.octet_length("t") + 8).cast("long").alias("size"),
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(F.encode("t", "utf-8")).alias("text_crc32"),
        F.unhex(F.md5("t")).alias("grp")).withColumn(
        "bundle", F.pmod(F.xxhash64("grp"), F.lit(n_bundles)).cast("int"))
        .withColumn("row", F.monotonically_increasing_id()))  # written, so the same in every later read
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")]

    per_bundle = rows.groupBy("bundle").agg(*sums).collect()  # at most n_bundles rows
    bytes_, n_rows = sum(x.b for x in per_bundle), sum(x.r for x in per_bundle)
    mean_b, mean_r = bytes_ / n_bundles, n_rows / n_bundles
    cut_b, cut_r = (max(1, x / shards / whole_group_share) for x in (bytes_, n_rows))
    heavy = [x.bundle for x in per_bundle if x.b > mean_b or x.r > mean_r]
    heavy_table = spark.createDataFrame([(x,) for x in heavy], "bundle int")
    large = (rows.join(F.broadcast(heavy_table), "bundle").groupBy("grp").agg(*sums)
             .where((F.col("b") > mean_b) | (F.col("r") > mean_r))
             .select("grp", F.greatest(F.ceil(F.col("b") / cut_b), F.ceil(F.col("r") / cut_r)).alias("parts"))
             .collect())  # at most 2 * n_bundles rows
    first, at = [], n_bundles
    for x in sorted(large, key=lambda x: bytes(x.grp)):
        first.append((x.grp, at, int(x.parts)))
        at += int(x.parts)
    large_table = spark.createDataFrame(first, "grp binary, first long, parts long")
    part = F.pmod("row", F.col("parts"))
    items = rows.join(F.broadcast(large_table), "grp", "left").withColumn(
        "item", F.coalesce(F.col("first") + part, F.col("bundle").cast("long")))

    sized = sorted(items.groupBy("item").agg(*sums).collect())
    shard_of = place(np.array([[x.b, x.t, x.r] for x in sized], dtype=float).reshape(-1, 3), shards)
    map_table = spark.createDataFrame(
        [(int(x.item), int(s)) for x, s in zip(sized, shard_of)], "item long, shard int")

    buckets = int(min(4_096, max(1, n_rows // (shards * rows_per_slot_bucket) + 1)))
    placed = items.join(F.broadcast(map_table), "item").select(
        "doc_id", "size", "tokens", "text_crc32", "shard", "row",
        F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = sorted(placed.groupBy("shard", "bucket").count().collect())  # at most shards * 4,096 rows
    starts, seen = [], {}
    for shard, bucket, n in counts:
        starts.append((shard, bucket, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    start_table = spark.createDataFrame(starts, "shard int, bucket int, start long")
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")
    return placed.withColumn("rn", F.row_number().over(order)).join(
        F.broadcast(start_table), ["shard", "bucket"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.col("rn") - 1).alias("slot"))


def op10_sharding(spark, sf_dir) -> DataFrame:
    from gridsla.llm.common import table
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")
