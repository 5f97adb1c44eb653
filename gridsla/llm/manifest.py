"""Merkle manifest of a table: a digest tree per language under one root, and a proof for every row.

Time-forward processing: a node's label is its place in the order in which the tree is computed (level, then position),
and a priority queue ordered by label carries each digest forward in time to its parent; the sweep backwards takes the
queue in the opposite order and carries proof suffixes from the root to the leaves. The queue is external in blocks:
a block is a subtree of ``FAN ** BLOCK_LEVELS`` nodes at most, Spark's sorted shuffle delivers its messages in label
order, and inside a block a heap does. Blocks' roots are the nodes of the next round, so a tree of n leaves takes
log(n) / log(FAN ** BLOCK_LEVELS) rounds and no task holds more than one block.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import discard, materialize, table
from gridsla.llm.order import join_groups, numbered

FAN = 8
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.binary())]))
STEPS_DDL = "array<struct<at:int,siblings:binary>>"


def H(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256 of the parts joined."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def encoded(value) -> bytes:
    """A field of a leaf: ``-`` for null, else byte count, colon and value."""
    if value is None:
        return b"-"
    data = value if isinstance(value, bytes) else str(value).encode()
    return b"%d:%s" % (len(data), data)


def _leaves(tampered: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, forged = [], []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                head, text = b"".join(map(encoded, values[:-1])), values[-1]
                leaf.append(H(head, encoded(text)))
                doc_id = values[0]
                hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % tampered == 0
                forged.append(H(head, encoded(None if text is None else text.lower())) if hit else None)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(leaf, pa.binary()), pa.array(forged, pa.binary())],
                                  names=["doc_id", "lang", "leaf", "forged"])
    return work


def levels_of(n: int, fan: int = FAN) -> int:
    """Rounds of joining ``fan`` neighbours until one of ``n`` nodes remains."""
    levels = 0
    while n > 1:
        n = -(-n // fan)
        levels += 1
    return levels


def sweep_up(digests: list[bytes], levels: int, fan: int = FAN) -> list[list[bytes]]:
    """Digests of a block's levels, leaves first: messages (label, digest) leave a heap in label order."""
    out = [[] for _ in range(levels + 1)]
    queue = [((0, k), d) for k, d in enumerate(digests)]  # sorted, so a heap
    while queue:
        (level, k), digest = heapq.heappop(queue)
        out[level].append(digest)
        if level == levels:
            continue
        last = not queue or queue[0][0][0] != level
        if k % fan == fan - 1 or last:  # all of the parent's children have arrived
            heapq.heappush(queue, ((level + 1, k // fan), H(*out[level][k - k % fan:])))
    return out


def sweep_down(tree: list[list[bytes]], suffix: list[dict], fan: int = FAN) -> list[list[dict]]:
    """Proof of each leaf of a block, given that of its root; messages leave the heap by descending label."""
    queue = [((1 - len(tree), 0), suffix)]
    proofs = []
    while queue:
        (level, k), proof = heapq.heappop(queue)
        level = -level
        if level == 0:
            proofs.append(proof)
            continue
        run = tree[level - 1][k * fan:(k + 1) * fan]
        for j in range(len(run)):
            step = {"at": j, "siblings": b"".join(run[:j] + run[j + 1:])}
            heapq.heappush(queue, ((1 - level, k * fan + j), [step, *proof]))
    return proofs


def fold(leaf: bytes, proof: list[dict]) -> bytes:
    """The root that a leaf and its proof give."""
    for step in proof:
        cut = 64 * step["at"]
        leaf = H(step["siblings"][:cut], leaf, step["siblings"][cut:])
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows with the same (tree, block), which are neighbours."""
    at, held = None, []
    for b in batches:
        names = b.schema.names
        for values in zip(*(c.to_pylist() for c in b.columns)):
            if values[:2] != at:
                if held:
                    yield held
                at, held = values[:2], []
            held.append(dict(zip(names, values)))
    if held:
        yield held


def _block_levels(n: int, fan: int, block_levels: int) -> int:
    """Levels of a block in a tree that has n nodes left: all of them, or a full block's."""
    return min(block_levels, levels_of(n, fan))


def _roots(fan: int, block_levels: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            r = rows[0]
            top = sweep_up([x["digest"] for x in rows], _block_levels(r["n"], fan, block_levels), fan)[-1][0]
            yield pa.record_batch([pa.array([r["tree"]], pa.int64()), pa.array([r["block"]], pa.int64()),
                                   pa.array([-(-r["n"] // fan ** block_levels)], pa.int64()), pa.array([top], pa.binary())],
                                  names=["tree", "pos", "n", "digest"])
    return work


def _suffixes(fan: int, block_levels: int):
    """Proof of every node of a round, from blocks that begin with a row of their own proof (``_with_heads``)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            head, nodes = rows[0], rows[1:]
            tree = sweep_up([x["digest"] for x in nodes], _block_levels(nodes[0]["n"], fan, block_levels), fan)
            proofs = sweep_down(tree, head["proof"], fan)
            yield pa.record_batch([pa.array([x["tree"] for x in nodes], pa.int64()),
                                   pa.array([x["pos"] for x in nodes], pa.int64()), pa.array(proofs, STEPS),
                                   *[pa.array([head[c]] * len(nodes), pa.binary()) for c in ("lang", "subroot")]],
                                  names=["tree", "pos", "proof", "lang", "subroot"])
    return work


def _in_blocks(nodes: DataFrame, *more: str, size: int) -> DataFrame:
    return nodes.select("tree", F.shiftright("pos", size.bit_length() - 1).alias("block"), "pos", "n", "digest", *more)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _rounds(nodes: DataFrame, most: int, fan: int, block_levels: int) -> list[DataFrame]:
    """Written tables (tree, pos, n, digest) of each round; in the last one every tree has one node."""
    size, out = fan ** block_levels, [nodes]
    while most > 1:
        out.append(materialize(_by_block(_in_blocks(out[-1], size=size)).mapInArrow(
            _roots(fan, block_levels), "tree long, pos long, n long, digest binary")))
        most = -(-most // size)
    return out


def _with_heads(nodes: DataFrame, proofs: DataFrame, size: int, *more: str) -> DataFrame:
    """A round's nodes, and before each block a row of position -1 with the block's proof, language and subroot."""
    none = F.lit(None)
    heads = proofs.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), none.cast("long").alias("n"),
                          none.cast("binary").alias("digest"), *[none.cast(nodes.schema[c].dataType).alias(c) for c in more],
                          "proof", "lang", "subroot")
    rows = _in_blocks(nodes, *more, size=size).select(
        "*", none.cast(STEPS_DDL).alias("proof"), none.cast("binary").alias("lang"), none.cast("binary").alias("subroot"))
    return _by_block(rows.unionByName(heads))


def _proven(root: bytes, fan: int, block_levels: int, with_proof: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            head, leaves = rows[0], rows[1:]
            tree = sweep_up([x["digest"] for x in leaves], _block_levels(leaves[0]["n"], fan, block_levels), fan)
            proofs = sweep_down(tree, head["proof"], fan)
            folded = [fold(x["forged"] or x["digest"], p) for x, p in zip(leaves, proofs)]

            def text(values):
                return pa.array([v.decode() for v in values], pa.string())
            lang = None if head["lang"] is None else head["lang"].decode("utf-8", "replace")
            columns = {"doc_id": pa.array([x["doc_id"] for x in leaves], pa.int64()),
                       "lang": pa.array([lang] * len(leaves), pa.string()), "leaf": text(x["digest"] for x in leaves),
                       "subroot": text([head["subroot"]] * len(leaves)), "root": text([root] * len(leaves)),
                       "proof_sha256": text(H(*(s["siblings"] for s in p)) for p in proofs), "folded_root": text(folded),
                       "verified": pa.array([f == root for f in folded], pa.bool_())}
            if with_proof:
                columns["proof"] = pa.array(proofs, STEPS)
            yield pa.record_batch(list(columns.values()), names=list(columns))
    return work


def manifest(docs: DataFrame, tampered: int = 3, fan: int = FAN, block_levels: int = BLOCK_LEVELS,
             with_proof: bool = False) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs``, and what a check of a tampered copy finds.

    A leaf is H of doc_id, source, lang, n_chars and text (``encoded``; other columns are not read and may have any
    name). Per lang (null is one) the leaves ascend by doc_id, null first, ties by leaf; every ``fan`` neighbours
    become their H until one is left, the subroot; the subroots by lang (null first, bytewise) give the root likewise.
    Where ``tampered`` divides crc32 of the decimal doc_id (never for a null one) the folded root starts from the row
    with A-Z of its text lowered, else from the row itself. An empty table gives an empty result.

    ``fan`` is a power of two. Texts are read whole, once, and only digests are moved. A language may hold all rows.
    Returns doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified and, with ``with_proof``, proof: from leaf to
    root the place in its run and the other digests of the run, joined.
    """
    size = fan ** block_levels
    fields = [F.col("doc_id").cast("long"), F.col("source").cast("string").cast("binary"), F.col("lang").cast("string").cast("binary"),
              F.col("n_chars").cast("long"), F.col("text").cast("string").cast("binary")]
    hashed = docs.select(*[f.alias(n) for f, n in zip(fields, FIELDS)]).mapInArrow(
        _leaves(tampered), "doc_id long, lang binary, leaf binary, forged binary")
    leaves = materialize(hashed.withColumn("row", F.monotonically_increasing_id()))
    order = numbered(leaves, F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row"))
    discard(leaves)
    langs = materialize(order.groupBy("lang").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")))
    langs_n = langs.count()
    kind = ("doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
            "verified boolean" + (f", proof {STEPS_DDL}" if with_proof else ""))
    if not langs_n:
        return docs.sparkSession.createDataFrame([], kind)
    # languages in order: that of their first leaves; a null one has a key of its own
    key = F.coalesce(F.concat(F.lit(b"+"), F.col("lang")), F.lit(b"")).alias("key")
    trees = numbered(langs, F.asc("first"), name="tree")
    nodes = materialize(join_groups(order.select("doc_id", "leaf", "forged", "position", key),
                                    trees.select(key, "tree", "first", "n"), "key", "n").select(
        "tree", (F.col("position") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("digest"), "forged", "doc_id"))
    discard(order)

    # forward: to the subroots, then to the root
    rounds = _rounds(nodes, trees.agg(F.max("n")).first()[0], fan, block_levels)
    top = materialize(rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
                                        F.lit(langs_n).cast("long").alias("n"), "digest"))
    top_rounds = _rounds(top, langs_n, fan, block_levels)
    root = bytes(top_rounds[-1].first()["digest"])

    # backwards: proof suffixes from the root to the subroots, then to the leaves
    def down(over: list[DataFrame], proofs: DataFrame) -> DataFrame:
        for above in reversed(over):
            below = materialize(_with_heads(above, proofs, size).mapInArrow(
                _suffixes(fan, block_levels), f"tree long, pos long, proof {STEPS_DDL}, lang binary, subroot binary"))
            discard(proofs)
            proofs = below
        return proofs

    none = F.lit(None).cast("binary")
    proofs = down(top_rounds[:-1], top_rounds[-1].select(
        "tree", "pos", F.array().cast(STEPS_DDL).alias("proof"), none.alias("lang"), none.alias("subroot")))
    named = trees.select("tree", "lang").join(rounds[-1].select("tree", F.col("digest").alias("subroot")), "tree")
    proofs = materialize(proofs.select(F.col("pos").alias("tree"), "proof").join(named, "tree").select(
        "tree", F.lit(0).cast("long").alias("pos"), "proof", "lang", "subroot"))
    proofs = down(rounds[1:-1], proofs)
    for done in (langs, trees, top, *top_rounds[1:], *rounds[1:]):  # the leaves and the last proofs are read below
        discard(done)
    return _with_heads(nodes, proofs, size, "forged", "doc_id").mapInArrow(
        _proven(root, fan, block_levels, with_proof), kind)


def op13_manifest(spark, sf_dir) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP13_SQL = r"""
WITH RECURSIVE remainders AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r),
checked AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ord(c)::BIGINT)), lambda c, x: xor(c >> 8, r[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0 AS forged
    FROM documents, remainders),
encoded AS (SELECT doc_id, coalesce('+' || lang, '') AS lang, forged, text,
    strlen(doc_id::VARCHAR) || ':' || doc_id || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM checked),
leaves AS MATERIALIZED (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN forged THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM encoded),
tree(lang, level, pos, n, digest) AS (
    SELECT lang, 0, pos, n, leaf FROM leaves
    UNION ALL
    SELECT lang, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
    FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8),
subroots AS MATERIALIZED (SELECT lang, digest AS subroot, level AS height,
    row_number() OVER (ORDER BY lang) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, pos, n, digest) AS (
    SELECT 0, pos, n, subroot FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
    FROM top WHERE n > 1 GROUP BY level, pos // 8),
steps AS (
    SELECT l.doc_id, t.level AS step, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (8 ** t.level)::BIGINT), '') AS before,
           coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (8 ** t.level)::BIGINT), '') AS after
    FROM leaves l JOIN tree t ON t.lang = l.lang AND t.n > 1 AND t.pos // 8 = l.pos // (8 ** (t.level + 1))::BIGINT
    GROUP BY l.doc_id, t.level
    UNION ALL
    SELECT l.doc_id, s.height + t.level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (8 ** t.level)::BIGINT), ''),
           coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (8 ** t.level)::BIGINT), '')
    FROM leaves l JOIN subroots s ON s.lang = l.lang JOIN top t ON t.n > 1 AND t.pos // 8 = s.pos // (8 ** (t.level + 1))::BIGINT
    GROUP BY l.doc_id, s.height, t.level),
folded(doc_id, step, digest) AS (
    SELECT doc_id, 0, shown FROM leaves
    UNION ALL
    SELECT f.doc_id, f.step + 1, sha256(s.before || f.digest || s.after) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step),
ends AS (SELECT doc_id, arg_max(digest, step) AS folded_root FROM folded GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = r.digest AS verified
FROM leaves l JOIN subroots s ON s.lang = l.lang JOIN top r ON r.n = 1 JOIN ends e ON e.doc_id = l.doc_id
LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""
