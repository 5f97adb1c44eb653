"""Importance resampling of documents towards a target distribution of hashed word runs.

Segment deduplication: newlines cut the texts into lines. A line's features are found once, whatever the number
of documents it stands in, and count as often as it occurs; runs of words over the end of a line belong to
the document and are added separately. A document's weight is the sum of its lines' gains and of the gains of
those runs; Gumbel noise from a hash of the doc_id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import discard, materialize, table
from gridsla.llm.order import join_groups, numbered

RUN = 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text with A-Z lowered, on its UTF-8 bytes
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_CACHE_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # bytes.lower changes A-Z only


class _Buckets:
    """Bucket of a feature; single words are remembered up to a bound."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, feature: bytes) -> int:
        at = self.known.get(feature)
        if at is None:
            at = zlib.crc32(feature) % self.buckets
            if len(self.known) < _CACHE_WORDS:
                self.known[feature] = at
        return at

    def runs(self, words: list[bytes], run: int) -> list[int]:
        """Buckets of all runs of 1 to ``run`` words."""
        known = self.known
        found = [known[w] if w in known else self.of(w) for w in words]
        for m in range(2, run + 1):
            found += [zlib.crc32(b" ".join(words[i:i + m])) % self.buckets for i in range(len(words) - m + 1)]
        return found

    def crossing(self, lines: list[list[bytes]], run: int) -> list[int]:
        """Buckets of the runs of 2 to ``run`` words that lie in more than one line."""
        words, starts = [], []
        for line in lines:
            if line:
                starts.append(len(words))
                words += line
        found = []
        for k, at in enumerate(starts[1:], 1):
            end = starts[k + 1] if k + 1 < len(starts) else len(words)
            # the run's last word is in line k, its first one before it
            for last in range(at, min(end, at + run - 1)):
                for first in range(max(0, last - run + 1), at):
                    found.append(zlib.crc32(b" ".join(words[first:last + 1])) % self.buckets)
        return found


def _lists(parts: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for p in parts for x in p], pa.int32()))


def _slices(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of that column (or one row)."""
    part = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _line_features(run: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Buckets(buckets)
        for batch in batches:
            for b in _slices(batch, 2):
                words = [words_of(x) for x in b.column(2).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int64()),
                                       _lists([found.runs(w, run) for w in words])],
                                      names=["key", "copies", "words", "buckets"])
    return work


def _crossing_features(run: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Buckets(buckets)
        for batch in batches:
            for b in _slices(batch, 1):
                lines = [[words_of(x) for x in t.split(b"\n")] for t in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), _lists([found.crossing(x, run) for x in lines])],
                                      names=["row", "buckets"])
    return work


def _counted(buckets: int):
    """Occurrences per bucket of one task's rows (copies, buckets)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            np.add.at(sums, lists.flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), sizes))
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])
    return work


def _gained(gains: np.ndarray):
    """The last column, an array of buckets, replaced by its length and its sum of gains."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            ends = lists.offsets.to_numpy()
            sums = np.concatenate(([0], np.cumsum(gains[lists.flatten().to_numpy()])))
            ends = ends - ends[0]
            yield pa.record_batch([*b.columns[:-1], pa.array(np.diff(ends).astype(np.int64)),
                                   pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())],
                                  names=[*b.schema.names[:-1], "features", "gain"])
    return work


def _text(docs: DataFrame):
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _lines(text):
    return F.split(text, "\n", -1)


def _distinct_lines(docs: DataFrame, run: int, buckets: int) -> DataFrame:
    """One row per different line: key (its md5), copies (occurrences), words and the buckets of its features."""
    lines = docs.select(F.explode(_lines(_text(docs))).alias("line")).groupBy("line").agg(
        F.count(F.lit(1)).alias("copies"))
    return materialize(lines.select(F.unhex(F.md5("line")).alias("key"), "copies", F.col("line").cast("binary").alias("line"))
                       .mapInArrow(_line_features(run, buckets), "key binary, copies long, words long, buckets array<int>"))


def _crossings(texts: DataFrame, run: int, buckets: int) -> DataFrame:
    """``row`` and the buckets of its runs over line ends, of a table (row, text)."""
    return texts.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(
        _crossing_features(run, buckets), "row long, buckets array<int>")


def _bucket_sums(parts: list[DataFrame], buckets: int) -> np.ndarray:
    """Feature occurrences per bucket: at most ``buckets`` rows come to the driver."""
    out = np.zeros(buckets, np.int64)
    for part in parts:
        for bucket, n in part.mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(
                F.sum("n")).collect():
            out[bucket] += n
    return out


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the source share) per bucket."""
    t_all, s_all, n = int(target.sum()), int(source.sum()), len(source)
    return np.array([math.floor(1000.0 * math.log(float((int(t) + 1) * (s_all + n)) / float((int(s) + 1) * (t_all + n))))
                     for t, s in zip(target, source)], np.int64)


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Weight, score and rank of every document for a draw that looks like ``target``.

    Features are the runs of 1 to ``run`` words. Of the N documents with ``min_words`` words or more, the
    ``percent * N // 100`` with the highest scores are drawn and ranked from 1, ties by doc_id.

    Only the columns doc_id and text of ``docs`` and text of ``target`` are read. A null text is empty: no
    features, weight 0, never drawn unless ``min_words`` is 0. A null doc_id gets the noise of the word ``null`` and
    comes last among equal scores; repeated rows are documents of their own with equal scores, in any order. An empty
    target has all its shares from smoothing; an empty table of documents gives an empty result. One line of any
    length is held by a task; a text's lines are not.

    Returns doc_id, n_words, n_features, weight, score, rank (long; rank null where not drawn).
    """
    text = _text(docs)
    keys = F.transform(_lines(text), lambda x: F.unhex(F.md5(x)))
    row = F.monotonically_increasing_id().alias("row")
    cross = None
    if run > 1:
        kept = materialize(docs.select(row, F.col("doc_id"), text.alias("text")))
        rows = materialize(kept.select("row", "doc_id", F.transform(_lines(F.col("text")), lambda x: F.unhex(F.md5(x))).alias("keys")))
        cross = materialize(_crossings(kept, run, buckets))
        discard(kept)
    else:
        rows = materialize(docs.select(row, F.col("doc_id"), keys.alias("keys")))
    distinct = _distinct_lines(docs, run, buckets)
    one = F.lit(1).cast("long").alias("copies")
    source_parts = [distinct.select("copies", "buckets")] + ([cross.select(one, "buckets")] if cross else [])
    target_lines = _distinct_lines(target, run, buckets)
    target_parts = [target_lines.select("copies", "buckets")]
    if run > 1:
        target_parts.append(_crossings(target.select(F.lit(0).cast("long").alias("row"), _text(target).alias("text")),
                                       run, buckets).select(one, "buckets"))
    gains = bucket_gains(_bucket_sums(target_parts, buckets), _bucket_sums(source_parts, buckets))
    discard(target_lines)

    known = materialize(distinct.mapInArrow(_gained(gains), "key binary, copies long, words long, features long, gain long"))
    discard(distinct)
    parts = join_groups(rows.select("row", "doc_id", F.explode("keys").alias("key")), known, "key", "copies").select(
        "row", "doc_id", "words", "features", "gain")
    if cross is not None:
        crossing = cross.mapInArrow(_gained(gains), "row long, features long, gain long")
        doc_id = F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id")
        parts = parts.unionByName(crossing.select("row", doc_id, F.lit(0).cast("long").alias("words"), "features", "gain"))
    sums = [F.sum(c).alias(c) for c in ("words", "features", "gain")]
    if cross is not None:
        sums.append(F.max("doc_id").alias("doc_id"))
    weighed = parts.groupBy("row", *([] if cross is not None else ["doc_id"])).agg(*sums)
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))),
                                       256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scored = materialize(weighed.withColumn(
        "score", F.col("gain") + F.floor(F.lit(-1000.0) * F.log(-F.log(noise))).cast("long")))
    for done in (rows, known, cross):
        discard(done)
    able = F.col("words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    order = numbered(scored.withColumn("out", ~able), F.asc("out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    discard(scored)
    rank = F.col("position") + 1
    return order.select(
        "doc_id", F.col("words").alias("n_words"), F.col("features").alias("n_features"), F.col("gain").alias("weight"),
        "score", F.when(~F.col("out") & (rank <= drawn), rank).alias("rank"))


def op11_resampling(spark, sf_dir) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


# crc32 of distinct words by its table of 256 remainders
OP11_SQL = rf"""
WITH RECURSIVE remainders AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r),
low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
aim AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS MATERIALIZED (SELECT doc_id, unnest(words) AS word FROM low),
b AS MATERIALIZED (SELECT unnest(words) AS word FROM aim),
vocabulary AS (SELECT word FROM w UNION SELECT word FROM b),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(word) + 1),
    lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, r[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM vocabulary, remainders),
s AS (SELECT bucket, count(*) AS n FROM w JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
gain AS MATERIALIZED (SELECT h.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM w) + {BUCKETS}))::DOUBLE
    / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM b) + {BUCKETS}))::DOUBLE))::BIGINT AS g
    FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight
    FROM w JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scores AS (SELECT l.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || l.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                            / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM low l LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
    FROM scores WHERE n_features >= {MIN_WORDS})
SELECT s.doc_id, s.n_features, s.weight, s.score, r.rank
FROM scores s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.rank <= r.n * {PERCENT} // 100
"""
