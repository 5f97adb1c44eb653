"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``length`` bytes, by most-significant-digit passes; a suffix that
is alone in its group after a pass is finished, and the groups left after the last pass are exactly the
repeated windows. The digits are chosen so that few suffixes have to be moved:

1. the window's anchor, its least-hashed gram of ``GRAM`` bytes. Neighbouring windows share
   an anchor, so one row stands for a run of suffixes (one per 27 bytes on average);
2. the run's whole context (all bytes of its windows). In a group of equal contexts all
   windows but the first one's repeat, for all suffixes of the run at once;
3. single windows, only for the first run of each context in a group with several contexts (the
   ends of repeated passages).

Digits are 64-bit polynomial hashes of the bytes; the bytes themselves are not compared again. Two different contexts or
windows are taken for one only where they share an anchor and their hashes are equal as well: for an anchor with n
different contexts the chance is about n * n / 2**65 (a thousand million contexts of one gram: 3 %; the largest group
of a usual corpus, a million: 3 in 10**8). Order is by doc_id, then (rows of one doc_id) by a hash of the text, then by start.

Texts are hashed in stretches of ``STRETCH`` window starts, so the memory for a text is its bytes and one stretch's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsla.llm.common import broadcast_if_small, discard, materialize, quoted, table

LENGTH = 100
GRAM = 48
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Bytes:
    """Hashes of any substrings of one text from prefix sums."""

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by minima from the left and from the right of blocks."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def runs(data: bytes, length: int, gram: int):
    """Runs of window starts with one anchor, a stretch at a time: (first start, last start, anchor digit, context digit).

    A run over the end of a stretch is cut in two: each window is in one run, which is all that the digits need.
    """
    for at in range(0, len(data) - length + 1, STRETCH):
        first, last, anchor, context = _stretch_runs(data[at:at + STRETCH + length - 1], length, gram)
        yield first + at, last + at, anchor, context


def _stretch_runs(data: bytes, length: int, gram: int):
    n = len(data)
    text, starts = Bytes(data), np.arange(n - gram + 1)
    digit = _mix(text.hashes(starts, starts + gram))
    least = sliding_min((digit & _HIGH) | starts.astype(np.uint64), length - gram + 1)
    anchor = (least & _LOW).astype(np.int64)
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [n - length + 1])) - 1
    at = anchor[first]
    context = _mix(text.hashes(first, last + length) + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                   + (last - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return first, last, digit[at].view(np.int64), context.view(np.int64)


def _suffix_runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for doc, twin, text in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                for first, last, anchor, context in runs(data, length, gram):
                    parts.append((np.full(len(first), doc), np.full(len(first), twin), first, last, anchor, context))
                    held += len(first)
                    if held > 200_000:
                        yield _batch(parts)
                        parts, held = [], 0
            if parts:
                yield _batch(parts)

    def _batch(parts):
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts)],
                               names=["doc", "twin", "first", "last", "anchor", "context"])
    return run


def _single_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for doc, twin, text, wanted in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                anchors, firsts, lasts = (wanted.values.field(k).to_numpy() for k in range(3))
                stretch = firsts // STRETCH
                for k in np.unique(stretch):
                    anchor, first, last = (x[stretch == k] for x in (anchors, firsts, lasts))
                    at = int(k) * STRETCH
                    hashed = Bytes(data[at:int(last.max()) + length])
                    count = last - first + 1
                    start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    window = _mix(hashed.hashes(start - at, start - at + length)).view(np.int64)
                    parts.append((np.full(len(start), doc), np.full(len(start), twin), start, np.repeat(anchor, count), window))
                    held += len(start)
                    if held > 200_000:
                        yield _batch(parts)
                        parts, held = [], 0
            if parts:
                yield _batch(parts)

    def _batch(parts):
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts)],
                               names=["doc", "twin", "first", "anchor", "window"])
    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the given intervals."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, kepts, spans = [], [], []
        for text, marks in zip(b.column(2), b.column(3)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            cut = [] if not marks.is_valid else merged(*(marks.values.field(k).to_numpy() for k in range(2)))
            at, kept = 0, []
            for s, e in cut:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            sizes.append(len(data))
            joined = b"".join(kept)
            kepts.append(joined.decode("utf-8", "ignore") if as_text else joined)
            spans.append([{"start": s, "end": e} for s, e in cut])
        yield pa.record_batch([
            b.column(1), pa.array(sizes, pa.int64()), pa.array(kepts, pa.string() if as_text else pa.binary()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["rest", "n_bytes", "kept", "spans"])


def _once(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per (doc, twin), and the written table of the keys that had several.

    Only rows of those keys are moved (one per task and key); usual tables have few or none of them.
    """
    keys = materialize(texts.groupBy("doc", "twin").count().where("count > 1").select("doc", "twin"))
    if not keys.limit(1).count():
        return texts, keys
    small = broadcast_if_small(keys)
    single = texts.join(small, ["doc", "twin"], "left_anti")
    return single.unionByName(texts.join(small, ["doc", "twin"], "left_semi").dropDuplicates(["doc", "twin"])), keys


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Judged on the input's UTF-8 bytes; matches never cross documents. Null and short texts lose
    nothing; rows of one doc_id and one text are one document, which is searched once and gives all of them
    one result; a null doc_id comes after all others; an empty table gives an empty result. All columns of ``docs`` but the text are returned
    inside the struct ``rest``; with n_bytes, ``kept`` (the remaining bytes, joined) and ``spans``
    (array of start, end: the maximal removed runs). With ``as_text``, ``kept`` is a string without the
    bytes of characters that a removal cut in two.
    """
    text = F.col("text").cast("string")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    named = docs.select(ident.alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("twin"), text.alias("text"))
    long_texts, repeated_rows = _once(named.where(F.octet_length("text") >= length))
    suffixes = long_texts.mapInArrow(
        _suffix_runs(length, gram), "doc long, twin long, first long, last long, anchor long, context long")
    where = F.struct("doc", "twin", "first")

    # first digit: anchors met once are finished
    repeated = materialize(suffixes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("several"))
        .where("n > 1").select("anchor", "several"))
    left = materialize(suffixes.join(repeated, "anchor"))
    discard(repeated)
    # second digit: contexts
    contexts = materialize(left.groupBy("anchor", "context", "several").agg(
        F.min(F.struct("doc", "twin", "first", "last")).alias("least"), F.count(F.lit(1)).alias("n")))
    whole = materialize(left.join(contexts.where("n > 1").select("anchor", "context", "least"), ["anchor", "context"])
                        .where(where != F.struct("least.doc", "least.twin", "least.first"))
                        .select("doc", "twin", F.col("first").alias("start"), (F.col("last") + length).alias("end")))
    discard(left)
    # third digit: single windows at the ends of repeated passages
    wanted = contexts.where("several").select("anchor", "least.*").groupBy("doc", "twin").agg(
        F.collect_list(F.struct("anchor", "first", "last")).alias("wanted"))
    windows = materialize(
        long_texts.join(wanted, ["doc", "twin"]).select("doc", "twin", "text", "wanted").mapInArrow(
            _single_windows(length), "doc long, twin long, first long, anchor long, window long"))
    discard(contexts)
    least = materialize(windows.groupBy("anchor", "window").agg(F.min(where).alias("least"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("anchor", "window", "least"))
    single = windows.join(least, ["anchor", "window"]).where(where != F.col("least")).select(
        "doc", "twin", F.col("first").alias("start"), (F.col("first") + length).alias("end"))

    marks = materialize(whole.unionByName(single).groupBy("doc", "twin").agg(
        F.collect_list(F.struct("start", "end")).alias("marks")))
    for done in (whole, windows, least, repeated_rows):  # before the texts are moved
        discard(done)
    rest = F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(ident.alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("twin"), rest, text.alias("text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([rows.schema["rest"], T.StructField("n_bytes", T.LongType()),
                        T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
                        T.StructField("spans", T.ArrayType(span))])
    return rows.join(marks, ["doc", "twin"], "left").select("doc", "rest", "text", "marks").mapInArrow(
        lambda batches: _cut(batches, as_text), out)


def op5_suffixes(spark, sf_dir) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        F.col("rest.doc_id").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
