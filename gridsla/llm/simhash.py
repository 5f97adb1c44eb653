"""SimHash near-duplicates: general pigeonhole search with per-fingerprint thresholds.

Fingerprints, grouped by value, are cut into ``parts`` groups of correlated bits.
For a query the thresholds t_i (from -1, "not searched") may be any with sum
``distance - parts + 1``: a fingerprint within ``distance`` then differs by t_i or
fewer bits in some group i. Dynamic programming picks the thresholds with the least
estimated candidates; the query probes each group's values within t_i and verifies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import connected_components, discard, materialize, quoted, table

BITS = 64
SHINGLE = 3
DISTANCE = 2
PARTS = 3
CELL_BITS = 11  # bits of one estimation histogram


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """64-bit SimHash: bit b is set when more than half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII spaces count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        spans = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = [joined[a:b] for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in spans), dtype="<u8", count=len(spans))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        block = hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``twin`` (a hash of the text) and ``fp`` (the fingerprint as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64)
            yield pa.record_batch([*b.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "twin", "fp"])

    return docs.select(F.col("doc_id").cast("long"), twin_of(docs).alias("twin"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, twin long, fp long")


def twin_of(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def bit_groups(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Bits grouped by correlation: a 64 x 64 table of joint counts is summed over the tasks,
    then each group grows from the strongest free bit by the bit most correlated with it."""
    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.T.astype(float) @ bits.astype(float)
            n += len(bits)
        if n:
            i, j = np.indices((BITS, BITS)).reshape(2, -1)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total.ravel(), n)})

    joint, n = np.zeros((BITS, BITS)), 0.0
    for i, j, c in distinct.select("fp").mapInPandas(run, "i int, j int, n double").groupBy("i", "j").agg(
            F.sum("n")).collect():  # 64 * 64 + 1 rows
        if i < 0:
            n = c
        else:
            joint[i, j] = c
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    corr = np.abs(cov / np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12)))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        size = (BITS - sum(map(len, groups)) + parts - g - 1) // (parts - g)
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(sorted(free), key=lambda b: corr[b, own].sum()))
            free.remove(own[-1])
        groups.append(sorted(own))
    return groups


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, as a number."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.int64(b)) & 1) << np.int64(k)
    return out


def _cells(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(group, bits) of each estimation histogram: a group's bits in runs of at most CELL_BITS."""
    return [(g, bits[i:i + CELL_BITS]) for g, bits in enumerate(groups) for i in range(0, len(bits), CELL_BITS)]


def ball_histograms(distinct: DataFrame, groups: list[list[int]], distance: int) -> list[np.ndarray]:
    """Per cell, an array [t, value]: the share of fingerprints at exactly t differing bits from the value."""
    cells = _cells(groups)

    def run(batches):
        sums = [np.zeros(1 << len(bits)) for _, bits in cells]
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for s, (_, bits) in zip(sums, cells):
                s += np.bincount(gather(fp, bits), minlength=len(s))
        for c, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pd.DataFrame({"cell": c, "value": at, "n": s[at]})

    counts = [np.zeros(1 << len(bits)) for _, bits in cells]
    for c, v, n in distinct.select("fp").mapInPandas(run, "cell int, value int, n double").groupBy(
            "cell", "value").agg(F.sum("n")).collect():  # at most 64 / CELL_BITS * 2 ** CELL_BITS rows
        counts[c][v] = n
    out = []
    for (_, bits), n in zip(cells, counts):
        share, values = n / max(n.sum(), 1), np.arange(len(n))
        rows = [share]
        for t in range(1, distance + 1):
            rows.append(sum((share[values ^ sum(1 << b for b in flip)] for flip in combinations(range(len(bits)), t)),
                            np.zeros(len(n))))
        out.append(np.array(rows))
    return out


def allocate(fp: np.ndarray, groups: list[list[int]], balls: list[np.ndarray], distance: int, n: int) -> np.ndarray:
    """Thresholds [row, group] from -1 with sum distance - parts + 1 and the least estimated cost.

    The cost of a group at threshold t is the estimated number of candidates (cells taken as
    independent) plus the values probed. Dynamic programming over the groups; spent budget is t + 1.
    """
    cells, budget = _cells(groups), distance + 1
    cost = np.zeros((len(groups), budget + 1, len(fp)))  # [group, t + 1]
    for g, bits in enumerate(groups):
        exact = None
        for (own, cell), ball in zip(cells, balls):
            if own == g:
                here = ball[:, gather(fp, cell)]
                exact = here if exact is None else np.array(
                    [sum(exact[a] * here[t - a] for a in range(t + 1)) for t in range(distance + 1)])
        probes = np.cumsum([1.0] + [len(list(combinations(bits, t))) for t in range(1, distance + 1)])
        cost[g, 1:] = np.cumsum(exact, axis=0) * n + probes[:, None]
    best, choice = cost[0], []
    for g in range(1, len(groups)):
        options = np.array([[best[b - s] + cost[g, s] if s <= b else np.full(len(fp), np.inf)
                             for s in range(budget + 1)] for b in range(budget + 1)])
        choice.append(options.argmin(axis=1))
        best = options.min(axis=1)
    spent, left = np.zeros((len(fp), len(groups)), dtype=np.int64), np.full(len(fp), budget)
    rows = np.arange(len(fp))
    for g in range(len(groups) - 1, 0, -1):
        spent[:, g] = choice[g - 1][left, rows]
        left = left - spent[:, g]
    spent[:, 0] = left
    return spent - 1


def near_links(distinct: DataFrame, distance: int = DISTANCE, parts: int = PARTS, written: list | None = None) -> DataFrame:
    """Links (a, b) between fingerprints at ``distance`` or fewer differing bits (even distance).

    ``distinct`` is a materialised table of different fingerprints (column fp). Links keep every
    connection; in a crowded bucket not every pair is listed: where a bucket's pairs
    would cost more than the neighbourhoods of its members, each member is
    instead written under all values within ``distance / 2`` bits. Members of one such value are
    within ``distance``, and any two within ``distance`` meet at one, so linking each to
    the smallest there is exact for the components and grows with the members alone.
    """
    n = distinct.count()
    groups = bit_groups(distinct, parts)
    balls = ball_histograms(distinct, groups, distance)
    masks = [{t: [sum(1 << k for k in flip) for flip in combinations(range(len(bits)), t)]
              for t in range(distance + 1)} for bits in groups]

    def probes(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 5_000):
                fp = pdf["fp"].to_numpy()[at:at + 5_000]
                thresholds = allocate(fp, groups, balls, distance, n)
                for g, bits in enumerate(groups):
                    value = gather(fp, bits)
                    yield pd.DataFrame({"part": g, "value": value, "fp": fp, "probe": False})
                    for t in range(distance + 1):
                        own = thresholds[:, g] >= t
                        for mask in masks[g][t]:
                            if own.any():
                                yield pd.DataFrame({"part": g, "value": value[own] ^ mask, "fp": fp[own], "probe": True})

    entries = materialize(distinct.select("fp").mapInPandas(probes, "part int, value long, fp long, probe boolean"))
    per_bucket = entries.groupBy("part", "value").agg(
        F.sum(F.col("probe").cast("long")).alias("p"), F.sum((~F.col("probe")).cast("long")).alias("m"),
        (F.min("fp") != F.max("fp")).alias("mixed")).where("p > 0 and m > 0 and mixed").drop("mixed")
    spread = 1 + BITS if distance == 2 else sum(len(list(combinations(range(BITS), t))) for t in range(distance // 2 + 1))
    buckets = materialize(per_bucket.withColumn(
        "crowded", F.col("p") * F.col("m") > spread * (F.col("p") + F.col("m"))))
    data = entries.where("not probe").select("part", "value", F.col("fp").alias("b"))
    keyed = entries.where("probe").select("part", "value", F.col("fp").alias("a"))
    usual = buckets.where("not crowded").select("part", "value")
    pairs = (keyed.join(usual, ["part", "value"]).join(data, ["part", "value"])
             .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
             .select("a", "b"))
    crowd = entries.join(buckets.where("crowded").select("part", "value"), ["part", "value"]).select("fp").distinct()
    flips = [sum(1 << b for b in f) for t in range(distance // 2 + 1) for f in combinations(range(BITS), t)]
    flips = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    around = crowd.select("fp", F.explode(F.transform(
        F.array(*[F.lit(f) for f in flips]), lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    around = materialize(around)
    least = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    star = around.join(least, "mid").where("a <> fp").select("a", F.col("fp").alias("b"))
    if written is not None:
        written += [entries, buckets, around]  # the tables that the links are read from
    return pairs.unionByName(star).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                       parts: int = PARTS) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Documents of one fingerprint, and fingerprints linked at ``distance`` (even) or fewer bits, share a
    component: the smallest doc_id in it. Texts without a word (null too) have
    fingerprint zero and link like any other. Repeated rows are returned as often as they occur; a null
    doc_id is never the smallest (a component of only such rows has a null id). An empty table gives an
    empty result. Returns doc_id, twin, fp, component_id and ``component``, the smallest fingerprint linked,
    which also tells components of null ids apart.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    own = materialize(fingerprints(docs, shingle))
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    written: list[DataFrame] = []
    parts_of = connected_components(near_links(distinct, distance, parts, written)).select(F.col("id").alias("fp"), "component")
    named = materialize(distinct.join(parts_of, "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")))
    smallest = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")))
    ids = materialize(named.join(smallest, "component").select("fp", "component_id", "component"))
    for done in (*written, distinct, named, smallest):
        discard(done)
    return own.join(ids, "fp").select("doc_id", "twin", "fp", "component_id", "component")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id (of several rows of it, one).

    All columns are kept. Null doc_ids come after all others.
    """
    found = materialize(simhash_components(docs, shingle, distance))
    names = ["none", "doc", "twin"]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "twin")
    first = materialize(found.groupBy("component").agg(F.min(key).alias("k")).select("k.*"))
    repeated = found.groupBy("doc_id", "twin").count().where("count > 1").limit(1).count()
    discard(found)
    doc_id = docs["doc_id"].cast("long")
    # the caller's columns stay in a struct, so that they may have any names
    rows = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("rest"), doc_id.isNull().alias("none"),
                       F.coalesce(doc_id, F.lit(0)).alias("doc"), twin_of(docs).alias("twin"))
    kept = rows.join(first, names, "left_semi")
    if repeated:  # a null text and an empty one are the same
        kept = kept.withColumn("whole", F.coalesce(F.col("rest.text"), F.lit(""))).dropDuplicates([*names, "whole"])
    return kept.select(*[F.col("rest").getField(c).alias(c) for c in docs.columns])


def op4_simhash(spark, sf_dir) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
