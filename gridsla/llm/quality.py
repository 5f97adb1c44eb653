"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio with a threshold.

Only DataFrame functions. The ratio compares the unigrams and bigrams of words, hashed into
``BUCKETS`` buckets, under two smoothed multinomials: the trusted target (every text labelled
good) and the raw corpus (all texts). Bucket weights are whole millionths, so a text's sum does
not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import broadcast_if_small, table

BUCKETS = 1 << 14
SCALE = 1_000_000
MAX_BROADCAST_ROWS = 2_000_000  # ids of the target that are broadcast; more are joined by a shuffle
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
_INDEX_BITS = 24


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(hashes: Column, index_bits: int = _INDEX_BITS) -> Column:
    """Words inside 3-word windows that occur twice or more (all occurrences count).

    Window hashes are packed with their position into one long and sorted, which brings equal windows
    together. Where positions need more than ``index_bits``, or two windows differ but share the hash bits
    that are left beside the position, whole hashes and positions are sorted as structs instead.
    """
    mask = F.lit((1 << index_bits) - 1).cast("long")

    def covered(starts: Column) -> Column:
        return let(F.sort_array(starts), lambda s: total(F.transform(s, lambda x, j: F.when(
            j == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), x - F.get(s, j - 1))))))

    def repeats(p: Column, same) -> Column:
        return F.filter(p, lambda x, j: F.coalesce(same(x, F.get(p, j - 1)), F.lit(False))
                        | F.coalesce(same(x, F.get(p, j + 1)), F.lit(False)))

    def whole(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return let(rows, lambda p: covered(F.transform(repeats(p, lambda x, y: x["h"] == y["h"]), lambda x: x["i"])))

    def of(windows: Column) -> Column:
        def full(x):
            return F.get(windows, x.bitwiseAND(mask).cast("int"))

        def close(x, y):
            return F.shiftright(x, index_bits) == F.shiftright(y, index_bits)

        def judged(twins: Column) -> Column:
            mixed = F.exists(F.transform(twins, lambda x, j: close(x, F.get(twins, j + 1)) & (
                full(x) != full(F.get(twins, j + 1)))), lambda x: F.coalesce(x, F.lit(False)))
            return F.when(mixed, whole(windows)).otherwise(covered(F.transform(twins, lambda x: x.bitwiseAND(mask))))

        packed = F.sort_array(F.transform(
            windows, lambda h, i: F.shiftleft(h, index_bits).bitwiseOR(i.cast("long"))))
        return F.when(F.size(windows) > (1 << index_bits), whole(windows)).otherwise(
            let(packed, lambda p: let(repeats(p, close), judged)))

    three = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(
        F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.when(F.size(hashes) < 4, F.lit(0).cast("long")).otherwise(let(three, of))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _pair(h: Column, after: Column) -> Column:
    return h.bitwiseXOR(F.shiftleft(after, 1))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def ngram_sum(hashes: Column, weights: Column) -> Column:
    """Sum of the weights of all unigrams and bigrams of a text."""
    return total(F.transform(hashes, lambda h, i: F.get(weights, _bucket(h)) + F.coalesce(
        F.get(weights, _bucket(_pair(h, F.get(hashes, i + 1)))), F.lit(0).cast("long"))))


def bucket_weights(docs: DataFrame, labels: DataFrame, smoothing: float = 1.0,
                   max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> Column:
    """Array of BUCKETS log ratios (millionths) of target over raw corpus, as a constant.

    Both counts cover all rows. The ids of the target are counted and broadcast up to ``max_broadcast_rows``
    (so the texts stay where they are); beyond that the texts are shuffled by id.
    """
    target = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")).distinct()
    target = broadcast_if_small(target, max_broadcast_rows)
    hashed = docs.select("doc_id", "text").join(target, F.col("doc_id") == F.col("_id"), "left")
    buckets = let(_hashes(words_of(F.coalesce(F.col("text"), F.lit("")))), lambda h: F.concat(
        F.transform(h, _bucket), F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))),
                                             lambda x, i: _bucket(_pair(x, F.get(h, i + 1))))))
    counts = (hashed.select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode(buckets).alias("bucket"))
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")))
    rows = counts.collect()  # at most BUCKETS rows
    n_raw, n_good = sum(r.raw for r in rows), sum(r.good for r in rows)
    if not n_good:  # nothing labelled good: no preference
        return F.array_repeat(F.lit(0).cast("long"), BUCKETS)
    spark = docs.sparkSession
    known = spark.createDataFrame([(r.bucket, r.raw, r.good) for r in rows], "bucket int, raw long, good long")
    log = (F.log((F.col("good") + smoothing) / (n_good + smoothing * BUCKETS))
           - F.log((F.col("raw") + smoothing) / (n_raw + smoothing * BUCKETS)))
    weight = {r.bucket: r.w for r in known.select("bucket", F.round(log * SCALE).cast("long").alias("w")).collect()}
    empty = weight.get(-1, 0)
    joined = ",".join(str(weight.get(b, empty)) for b in range(BUCKETS))
    return F.split(F.lit(joined), ",").cast("array<bigint>")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: int | None = None,
                  max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """All columns of ``docs`` and a struct ``quality`` (a column of that name is replaced).

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr (mean
    log ratio per n-gram in millionths, null without words). Null text counts as empty; such texts
    fail the base rules. ``threshold`` (millionths) is by default a third of the way from the mean ratio of
    all texts labelled good to that of all bad ones; without both kinds every text that passes the base rules is kept.
    Repeated rows and null doc_ids are judged like any other.
    """
    weights = bucket_weights(docs, labels, max_broadcast_rows=max_broadcast_rows)
    text = F.coalesce(F.col("text"), F.lit(""))

    def mean_ratio(h: Column) -> Column:
        return F.when(F.size(h) > 0, F.floor(ngram_sum(h, weights) / (F.size(h).cast("long") * 2 - 1)))

    if threshold is None:
        known = labels.where(F.col("quality").isin(0, 1)).select(
            F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).distinct()
        ratio, same = let(_hashes(words_of(text)), mean_ratio).alias("_r"), F.col("doc_id") == F.col("_id")
        if known.count() <= max_broadcast_rows:  # only labelled texts are rated
            rated = docs.select("doc_id", "text").join(F.broadcast(known), same).select("_q", ratio)
        else:  # every text is rated where it lies, ids and ratios are shuffled
            rated = docs.select("doc_id", ratio).join(known, same)
        means = {r["_q"]: r.s / r.n for r in rated.groupBy("_q").agg(
            F.sum("_r").alias("s"), F.count("_r").alias("n")).collect() if r.n}
        threshold = int((means[0] + 2 * means[1]) / 3) if len(means) == 2 and means[0] < means[1] else None

    def judge(h: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).alias("n_repeat_words"),
                        mean_ratio(h).alias("llr"))

    def finish(x: Column) -> Column:
        n, repeats = x["n_words"], x["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeats > 50 * n)
        passed = F.lit(True) if threshold is None else F.coalesce(x["llr"] >= threshold, F.lit(False))
        return F.struct(
            n.alias("n_words"),
            F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeats.alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & passed).alias("kept"), x["llr"].alias("llr"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    judged = let(let(_hashes(words_of(text)), judge), finish)
    # always true; as rand() may not be moved or repeated, a later filter does not compute the struct anew
    return docs.withColumn("quality", F.when(F.rand(0) < 2, judged))


def op3_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality.*")
