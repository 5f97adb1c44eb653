"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import MAX_BROADCAST_ROWS, broadcast_if_small, materialize, quoted, table

MAX_BROADCAST_ENTRIES = 2_000_000  # values of all sources' distributions, 16 MB
SEED = 42
TEMPERATURE = 0.5


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None,
                     temperature: float = TEMPERATURE, target_ratio: float = 1.0) -> DataFrame:
    """Mean repetition rate per source: target bytes of the source over its bytes.

    Targets share ``target_ratio`` times all bytes (UTF-8 text plus 1 a document) by
    ``weights`` (a source without weight gets none), by default by each source's
    bytes to the power ``temperature``. A null source is a source of its own.
    Columns: source, rate, low, cdf: the Poisson distribution's values at low, low + 1, ... from below 2**-52 to beyond
    1 - 2**-52. There are about 24 square roots of the rate of them, and a rate is large only for a source with few bytes.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1
    sizes = docs.groupBy("source").agg(F.sum(size).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        given = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.when(F.col("source").isNotNull(), F.element_at(given, F.col("source"))), F.lit(0.0))
    sizes = materialize(sizes.withColumn("weight", weight))
    total, all_weights = sizes.agg(F.sum("bytes"), F.sum("weight")).first()
    scale = float(total or 0) * target_ratio / all_weights if all_weights else 0.0
    rates = sizes.select("source", (F.col("weight") * F.lit(scale) / F.col("bytes")).alias("rate"))
    return materialize(rates.mapInPandas(_distributions, "source string, rate double, low long, cdf array<double>"))


def _distributions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        low, cdf = [], []
        for rate in pdf["rate"]:
            if not rate > 0:
                low.append(0)
                cdf.append([1.0])
                continue
            width = 12 * math.sqrt(rate) + 30
            first = max(0, math.floor(rate - width))
            k = np.arange(first, math.ceil(rate + width) + 1, dtype=float)
            # probabilities by their logarithms: no underflow at large rates
            steps = np.log(rate / k[1:])
            start = first * math.log(rate) - rate - math.lgamma(first + 1)
            low.append(first)
            cdf.append(np.cumsum(np.exp(start + np.concatenate(([0.0], np.cumsum(steps))))))
        yield pd.DataFrame({"source": pdf["source"], "rate": pdf["rate"], "low": low, "cdf": cdf})


def _hex(col, digits: int):
    return F.conv(F.substring(F.md5(col), 1, digits), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED,
                temperature: float = TEMPERATURE, target_ratio: float = 1.0,
                max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every document repeated a Poisson-distributed number of times, in a global random order.

    The count inverts the Poisson distribution of the source's rate at a uniform number hashed from seed and doc_id, so
    it depends on nothing else. Rows whose doc_id is null or repeated are written once and numbered; their numbers
    go into the hash, so each has a count and a place of its own. Rows keep all columns and gain ``copy`` (from 0),
    ``repeats`` and ``shuffle_key`` (the global order; partitions are random and
    sorted by it). Columns of these names in the input are replaced, others may have any name. An empty table gives an
    empty result. The table of sources is broadcast only when counted small, in rows and in entries.
    """
    docs = docs.drop("copy", "repeats", "shuffle_key")
    rates = repetition_rates(docs, weights, temperature, target_ratio)
    entries = rates.agg(F.sum(F.size("cdf"))).first()[0] or 0
    small = broadcast_if_small(rates, max_broadcast_rows) if entries <= MAX_BROADCAST_ENTRIES else rates
    small = small.select(F.col("source").alias("at_source"), "low", "cdf")
    # the caller's columns stay in a struct, so that they may have any names
    rows = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("rest"),
                       docs["source"].cast("string").alias("from_source"), docs["doc_id"].cast("string").alias("ident"))
    shared = materialize(rows.groupBy("ident").count().where("ident IS NULL OR count > 1").select("ident"))
    if shared.limit(1).count():
        keys = broadcast_if_small(shared.select(F.col("ident").alias("key")), max_broadcast_rows)
        same = F.col("ident").eqNullSafe(F.col("key"))
        several = materialize(rows.join(keys, same, "left_semi").withColumn("row", F.monotonically_increasing_id()))
        rows = rows.join(keys, same, "left_anti").unionByName(several.withColumn(
            "ident", F.concat_ws(":", F.coalesce("ident", F.lit("null")), F.col("row"))).drop("row"))
    u = (_hex(F.concat(F.lit(f"{seed}:"), F.col("ident")), 13) + F.lit(0.5)) / F.lit(float(2**52))
    counted = rows.withColumn("u", u).join(small, F.col("from_source").eqNullSafe(F.col("at_source"))).withColumn(
        "repeats", (F.col("low") + F.size(F.filter("cdf", lambda c: c < F.col("u")))).cast("int"))
    copies = counted.where("repeats > 0").select("rest", "ident", "repeats", F.explode(
        F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", _hex(F.concat_ws(":", F.lit(str(seed)), "ident", "copy"), 15))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("rest").getField(c).alias(c) for c in docs.columns], "repeats", "copy", "shuffle_key")


def op1_mixing(spark, sf_dir) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "lang", "source", "n_chars", "repeats", "copy", "shuffle_key")


OP1_SQL = f"""
WITH d AS (SELECT *, (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
           FROM documents),
s AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS bytes FROM d GROUP BY source),
r AS (SELECT source, sqrt(bytes) / (SELECT sum(sqrt(bytes)) FROM s) * (SELECT sum(bytes) FROM s) / bytes AS rate FROM s),
p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS pk FROM r, range(0, 400) t(k)
      WHERE k <= rate + 12 * sqrt(rate) + 31),
c AS (SELECT source, k, sum(pk) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
n AS (SELECT d.doc_id, count(*) AS repeats FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf < d.u
      GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, n.repeats::INT AS repeats, x.copy::INT AS copy,
       ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || x.copy), 1, 15))::BIGINT AS shuffle_key
FROM d JOIN n USING (doc_id), LATERAL (SELECT unnest(range(0, n.repeats)) AS copy) x
"""
