"""Exact dedup by a cuckoo-filter index over content digests.

A digest (SHA-256 of the text with A-Z lowered) belongs to a shard by its first bits and, inside the shard, to two
filter buckets of ``SLOTS`` short tags. Content is kept by filter bucket: a tag that matches is verified
against the full digests stored there, so a false hit of the filter never joins two texts. A filter that cannot
place a tag after ``MAX_KICKS`` moves is built anew at twice the size from the stored digests. Digests can be
deleted again; the index is a table with one row per shard, so a stored index takes later batches of insertions and
deletions without the old documents.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import discard, materialize, table
from gridsla.llm.order import join_groups

SLOTS = 4
MAX_KICKS = 200
LEAST_BUCKETS = 64
SHARD_KEYS = 20_000
LOCAL_KEYS = 50_000
ENTRY = "digest binary, keep_id long, keep_row long, size long"
INDEX = "shard int, buckets int, tags binary, digests binary, keep_ids array<long>, keep_rows array<long>, sizes array<long>"


class CuckooFilter:
    """Tags of 16 bits in buckets of ``SLOTS``; zero is an empty slot."""

    def __init__(self, buckets: int = LEAST_BUCKETS, tags: np.ndarray | None = None):
        self.mask = buckets - 1  # a power of two
        self.tags = [0] * (buckets * SLOTS) if tags is None else tags.tolist()

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """The digest's tag and its two buckets; either bucket and the tag give the other one."""
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & self.mask
        return tag, first, first ^ ((tag * 0x5BD1E995) & self.mask)

    def _put(self, bucket: int, tag: int) -> bool:
        at = bucket * SLOTS
        for k in range(at, at + SLOTS):
            if not self.tags[k]:
                self.tags[k] = tag
                return True
        return False

    def contains(self, digest: bytes) -> bool:
        tag, a, b = self.places(digest)
        return tag in self.tags[a * SLOTS:(a + 1) * SLOTS] or tag in self.tags[b * SLOTS:(b + 1) * SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False when no slot was found; the filter has then lost a tag and has to be built anew."""
        tag, a, b = self.places(digest)
        if self._put(a, tag) or self._put(b, tag):
            return True
        at = b
        for kick in range(MAX_KICKS):
            slot = at * SLOTS + (kick + tag) % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            at ^= (tag * 0x5BD1E995) & self.mask
            if self._put(at, tag):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Take one tag of a digest out; only for digests that were inserted."""
        tag, a, b = self.places(digest)
        for bucket in (a, b):
            for k in range(bucket * SLOTS, (bucket + 1) * SLOTS):
                if self.tags[k] == tag:
                    self.tags[k] = 0
                    return True
        return False


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (doc_id, row): the larger doc_id, null least; then the smaller row."""
    def rank(x):
        return (x[0] is not None, x[0] or 0, -x[1])
    return a if rank(a) >= rank(b) else b


class CuckooIndex:
    """Live digests with (keep_id, keep_row, size), found through the filter."""

    def __init__(self, buckets: int = LEAST_BUCKETS):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, list[list]] = defaultdict(list)  # by first bucket: [digest, keep_id, keep_row, size]
        self.size = self.resizes = self.false_hits = 0

    def find(self, digest: bytes) -> list | None:
        if not self.filter.contains(digest):
            return None
        for entry in self.content.get(self.filter.places(digest)[1], ()):
            if entry[0] == digest:
                return entry
        self.false_hits += 1
        return None

    def insert(self, digest: bytes, keep_id: int | None, keep_row: int, size: int = 1) -> None:
        entry = self.find(digest)
        if entry is not None:
            entry[1], entry[2] = _better((entry[1], entry[2]), (keep_id, keep_row))
            entry[3] += size
            return
        self.content[self.filter.places(digest)[1]].append([digest, keep_id, keep_row, size])
        self.size += 1
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        entry = self.find(digest)
        if entry is None:
            return False
        self.filter.delete(digest)
        self.content[self.filter.places(digest)[1]].remove(entry)
        self.size -= 1
        return True

    def _resize(self) -> None:
        stored, buckets = list(self.entries()), self.filter.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self.filter, self.content = CuckooFilter(buckets), defaultdict(list)
            if all([self._place(e) for e in stored]):
                return

    def _place(self, entry: list) -> bool:
        self.content[self.filter.places(entry[0])[1]].append(entry)
        return self.filter.insert(entry[0])

    def entries(self) -> Iterator[list]:
        for found in self.content.values():
            yield from found

    # one row of the index table
    def row(self, shard: int) -> dict:
        stored = list(self.entries())
        return {"shard": shard, "buckets": self.filter.mask + 1, "tags": np.array(self.filter.tags, np.uint16).tobytes(),
                "digests": b"".join(e[0] for e in stored), "keep_ids": [e[1] for e in stored],
                "keep_rows": [e[2] for e in stored], "sizes": [e[3] for e in stored]}

    @classmethod
    def load(cls, row: dict) -> CuckooIndex:
        index = cls(row["buckets"])
        index.filter = CuckooFilter(row["buckets"], np.frombuffer(row["tags"], np.uint16))
        for k, (i, r, n) in enumerate(zip(row["keep_ids"], row["keep_rows"], row["sizes"])):
            digest = row["digests"][32 * k:32 * k + 32]
            index.content[index.filter.places(digest)[1]].append([digest, i, r, n])
        index.size = len(row["sizes"])
        return index


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [hashlib.sha256((t or b"").lower()).digest() for t in map(pa.BinaryScalar.as_py, b.column(1))]
        yield pa.record_batch([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
                       ).mapInArrow(_digests, "doc_id long, digest binary")


def _entry_batch(index: CuckooIndex) -> pa.RecordBatch:
    stored = list(zip(*index.entries()))
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(stored, kinds)],
                           names=["digest", "keep_id", "keep_row", "size"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, doc_id, row) of a task as entries, one per digest and at most ``LOCAL_KEYS`` held at once."""
    index = CuckooIndex()
    for b in batches:
        for digest, doc_id, row in zip(*(c.to_pylist() for c in b.columns)):
            index.insert(digest, doc_id, row)
        if index.size >= LOCAL_KEYS:
            yield _entry_batch(index)
            index = CuckooIndex()
    if index.size:
        yield _entry_batch(index)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows, deletions and insertions, sorted by shard and kind, as one index row per shard."""
    schema = pa.schema([("shard", pa.int32()), ("buckets", pa.int32()), ("tags", pa.binary()), ("digests", pa.binary()),
                        ("keep_ids", pa.list_(pa.int64())), ("keep_rows", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64()))])
    at, index = None, None
    for r in _rows(batches):
        if r["shard"] != at:
            if index is not None:
                yield pa.RecordBatch.from_pylist([index.row(at)], schema)
            at, index = r["shard"], CuckooIndex()
        if r["kind"] == 0:
            index = CuckooIndex.load(r["stored"])
        elif r["kind"] == 1:
            index.delete(r["digest"])
        else:
            index.insert(r["digest"], r["keep_id"], r["keep_row"], r["size"])
    if index is not None:
        yield pa.RecordBatch.from_pylist([index.row(at)], schema)


def _entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        index = CuckooIndex.load(r)
        if index.size:
            yield _entry_batch(index)


def _shard(digest, shards: int):
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def index_entries(index: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row and size of every live digest of an index."""
    return index.mapInArrow(_entries_of, ENTRY)


def update_index(index: DataFrame | None, inserted: DataFrame | None = None, deleted: DataFrame | None = None,
                 shards: int | None = None) -> DataFrame:
    """An index after deletions and then insertions, as a written table of one row per shard.

    ``inserted`` has the columns digest, doc_id (or null) and row; ``deleted`` a column digest: digests that are not
    live are passed over. Insertions are combined by a local index in the tasks that read them, so a text
    that a third of all rows hold arrives once per task. ``shards`` is kept from ``index``; for a new one it is set
    so that a shard has about ``SHARD_KEYS`` rows. Shards that outgrow it are larger rows, never cut off: give
    ``index_entries`` to a new index to deal them again. No input gives an empty index.
    """
    combined = None
    if inserted is not None:
        combined = materialize(inserted.select("digest", "doc_id", "row").mapInArrow(_combine, ENTRY))
    if shards is None:
        if index is not None:
            shards = (index.agg(F.max("shards")).first()[0]) or 1
        else:
            n = combined.count() if combined is not None else 0
            shards = n // SHARD_KEYS + 1
    stored = "struct<buckets:int,tags:binary,digests:binary,keep_ids:array<long>,keep_rows:array<long>,sizes:array<long>>"
    none = F.lit(None)
    blank = {"digest": none.cast("binary"), "keep_id": none.cast("long"), "keep_row": none.cast("long"),
             "size": none.cast("long"), "stored": none.cast(stored)}

    def events(df: DataFrame, kind: int, shard, **given) -> DataFrame:
        return df.select(shard.alias("shard"), F.lit(kind).alias("kind"),
                         *[given.get(c, e).alias(c) for c, e in blank.items()])

    parts = []
    if index is not None:
        parts.append(events(index, 0, F.col("shard"), stored=F.struct(
            "buckets", "tags", "digests", "keep_ids", "keep_rows", "sizes")))
    if deleted is not None:
        parts.append(events(deleted.select("digest").distinct(), 1, _shard(F.col("digest"), shards), digest=F.col("digest")))
    if combined is not None:
        parts.append(events(combined, 2, _shard(F.col("digest"), shards),
                            **{c: F.col(c) for c in ("digest", "keep_id", "keep_row", "size")}))
    if not parts:
        raise ValueError("nothing to index")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = union.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_merge, INDEX)
    out = materialize(merged.withColumn("shards", F.lit(shards)))
    discard(combined)
    return out


def exact_groups(docs: DataFrame) -> DataFrame:
    """The group of equal texts of every document and the row of it that stays.

    Texts are equal when identical after lowering A-Z only; null counts as empty. The row with the largest
    doc_id stays, null being the least; of several rows with that doc_id and text exactly one. Only doc_id and text are
    read, whole; other columns may have any name. An empty table gives an empty result.

    Rows meet their group by digest; digests with more than a ten-thousandth of all rows (there are fewer than ten
    thousand) are broadcast, so that the rows of a hot text stay where they are.
    Returns doc_id, keep_id, group_size (long), kept (boolean), text_sha256.
    """
    rows = materialize(digests(docs).withColumn("row", F.monotonically_increasing_id()))
    index = update_index(None, inserted=rows)
    entries = materialize(index_entries(index))
    discard(index)
    return join_groups(rows, entries, "digest", "size").select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def op12_exact(spark, sf_dir) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
           AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
