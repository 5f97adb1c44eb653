"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells. Every vector is stored in the
cell of its nearest codeword pair. A query visits cells in the order of the multi-sequence traversal, by
the sum of its two half distances, as long as a cell can hold a vector near enough; what it finds is
verified by the cosine in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import connected_components, discard, materialize, table

COSINE = 0.98
SAMPLE = 10_000      # vectors that the codebooks are fitted on
CELL_ROWS = 500      # wanted vectors of one label in a cell
BLOCK = 1_000        # vectors of a cell that one task compares with a block of queries


def unit(packed: pd.Series | list) -> np.ndarray:
    """Unit vectors (double) of packed little-endian floats.

    A power of two brings each vector near 1 first, so squares neither overflow nor vanish.
    """
    v = np.stack([np.frombuffer(b, dtype="<f8") for b in packed])
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means with deterministic starts (farthest points)."""
    k = min(k, len(np.unique(x, axis=0)))
    c = [x[0]]
    far = ((x - c[0]) ** 2).sum(axis=1)
    while len(c) < k:
        c.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(axis=1))
    c = np.array(c)
    for _ in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * k < 4_000_000 else np.concatenate(
            [((b[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for b in np.array_split(x, 1 + len(x) * k // 4_000_000)])
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c


def half_bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and squared lower bounds of its distance to each codeword's region.

    A region lies beyond the bisector between its codeword and the row's nearest one.
    """
    d = ((x ** 2).sum(axis=1)[:, None] + (c ** 2).sum(axis=1)[None] - 2 * x @ c.T)
    near = d.argmin(axis=1)
    apart = np.sqrt(((c[near][:, None] - c[None]) ** 2).sum(axis=2))
    gap = np.where(apart > 0, (d - d[np.arange(len(x)), near][:, None]) / np.maximum(2 * apart, 1e-300), 0.0)
    return near, np.maximum(gap - 1e-9, 0.0) ** 2


def traverse(a: np.ndarray, b: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells by ascending a[i] + b[j] while that is at most ``reach`` (multi-sequence traversal)."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, []
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > reach:
            break
        out.append((int(oa[i]), int(ob[j])))
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[oa[n[0]]] + b[ob[n[1]]], *n))
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id",
                 sample: int = SAMPLE, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """Links and components of all vectors of equal label with cosine ``cosine`` or more.

    The codebooks are fitted on ``sample`` vectors chosen by a hash; every vector is indexed. Cells are visited
    until no other can hold a vector within reach, so the recall is 1 up to rounding. Equal vectors of
    a label are one class with a count. Cells and their queries are cut into blocks, so a crowded cell spreads
    over many tasks, and a task writes counts and a spanning forest instead of pairs. A null or zero vector, one with
    null or non-finite components, or with a null label links with nothing; vectors of different length never link;
    null ids are kept and link like others (a component of only such rows has a null id); repeated rows count as
    other vectors, so do different vectors of one id. Returns id, n_links, component_id, kept.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = (F.col("label").isNotNull() & F.col("v").isNotNull()
            & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))

    def pack(batches):
        for pdf in batches:
            pdf["v"] = [np.asarray(v, dtype="<f8").tobytes() for v in pdf["v"]]
            yield pdf[["id", "label", "v"]]

    label_type = rows.schema["label"].dataType.simpleString()
    good = materialize(rows.where(F.coalesce(fine, F.lit(False))).mapInPandas(pack, f"id long, label {label_type}, v binary"))
    # numbered classes (written once, so the numbers stay); the least id only names the component
    classes = materialize(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
                          .withColumn("key", F.monotonically_increasing_id()))
    picked = [unit([r.v])[0] for r in classes.orderBy(F.xxhash64("v"), "v", "label").limit(sample).select("v").collect()]
    n_classes, n_labels = classes.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    k = int(np.clip(np.sqrt(n_classes / max(1, n_labels) / cell_rows), 2, 256))
    for dim in {len(v) for v in picked}:
        x = np.array([v for v in picked if len(v) == dim])
        books[dim] = codebook(x[:, :(dim + 1) // 2], k), codebook(x[:, (dim + 1) // 2:], k)
    reach = 2 - 2 * cosine + 1e-9

    def cells(batches):
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy() // 8
            for dim in np.unique(dims):
                own = pdf[dims == dim]
                for at in range(0, len(own), 2_000):
                    part = own.iloc[at:at + 2_000]
                    u = unit(part["v"])
                    one, two = books.get(int(dim)) or (np.zeros((1, (dim + 1) // 2)), np.zeros((1, dim // 2)))
                    (i, a), (j, b) = half_bounds(u[:, :(dim + 1) // 2], one), half_bounds(u[:, (dim + 1) // 2:], two)
                    visits = [traverse(x, y, reach) for x, y in zip(a, b)]
                    count = [len(v) for v in visits]
                    grid = np.array([c for v in visits for c in v], dtype=np.int32).reshape(-1, 2)
                    head = part[["label", "key", "n", "v"]].assign(dim=int(dim))
                    yield head.assign(i=i, j=j, query=False)
                    yield head.iloc[np.repeat(np.arange(len(part)), count)].assign(i=grid[:, 0], j=grid[:, 1], query=True)

    schema = f"label {label_type}, key long, n long, v binary, dim int, i int, j int, query boolean"
    entries = materialize(classes.mapInPandas(cells, schema))
    cell = ["label", "dim", "i", "j"]
    sizes = materialize(entries.groupBy(*cell).agg(
        F.ceil(F.sum((~F.col("query")).cast("long")) / block).alias("data_blocks"),
        F.ceil(F.sum(F.col("query").cast("long")) / block).alias("query_blocks")).where("data_blocks > 0"))
    placed = entries.join(sizes, cell)
    own, other = (F.pmod(F.xxhash64("key"), F.col(c)) for c in ("data_blocks", "query_blocks"))

    def spread(c):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    data = placed.where("not query").withColumn("d", own).withColumn("q", spread("query_blocks"))
    query = placed.where("query").withColumn("q", other).withColumn("d", spread("data_blocks"))
    columns = [*cell, "d", "q", "key", "n", "v", "query"]

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        is_query = batch["query"].to_numpy()
        out = []
        if is_query.any() and not is_query.all():
            q, d = batch[is_query], batch[~is_query]
            q_id, d_id, d_n = q["key"].to_numpy(), d["key"].to_numpy(), d["n"].to_numpy()
            ud = unit(d["v"])
            for at in range(0, len(q), 2_000):
                ids = q_id[at:at + 2_000]
                near = (unit(q["v"].iloc[at:at + 2_000]) @ ud.T >= cosine) & (ids[:, None] != d_id[None])
                hit = near.any(axis=1)
                if not hit.any():
                    continue
                near, ids = near[hit], ids[hit]
                links = near @ d_n
                # components of this block: least labels go to and fro until nothing changes
                label, d_label = ids.copy(), d_id.copy()
                far = np.iinfo(np.int64).max
                while True:
                    d_new = np.minimum(d_label, np.where(near, label[:, None], far).min(axis=0))
                    new = np.minimum(label, np.where(near, d_new[None], far).min(axis=1))
                    if (new == label).all() and (d_new == d_label).all():
                        break
                    label, d_label = new, d_new
                used = near.any(axis=0)
                out.append(pd.DataFrame({"a": ids, "b": label, "links": links}))
                out.append(pd.DataFrame({"a": d_id[used], "b": d_label[used], "links": 0}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")

    found = materialize(data.select(columns).unionByName(query.select(columns)).groupBy(*cell, "d", "q").applyInPandas(
        compare, "a long, b long, links long"))
    for done in (entries, sizes):
        discard(done)
    components = connected_components(found.select("a", "b"))
    parts = components.select(F.col("id").alias("key"), "component")
    linked = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    whole = materialize(classes.join(linked, "key", "left").join(parts, "key", "left").select(
        "label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "key").alias("component")))
    for done in (classes, found, components):
        discard(done)
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    verdict = materialize(whole.join(least, "component").select("label", "v", "n_links", "component_id"))
    discard(whole)
    joined = good.join(verdict, ["label", "v"], "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_neighbours(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
