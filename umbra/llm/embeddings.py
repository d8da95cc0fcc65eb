"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest pivots and sent to the inverted list of each of them. Two vectors are
candidates if they share two of their nearest pivots at least: in the list of a pivot, they are counted where the next
shared pivot is the same too, and a pair only in the list of its two smallest shared pivots. What a list retrieves is
verified by cosine in double precision. The list of a pivot of more than BIG vectors is kept per pair of pivots
instead, and of these, lists of more than PART vectors are salted into parts; every pair of parts is a unit of its own.
Equal vectors are one class and are never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import shuffle_partitions, stage_table
from umbra.llm.components import connected_components, forest

#: Fitted on at most MAX_PIVOTS sampled vectors; every vector is indexed.
MAX_PIVOTS = 2048
NEAREST = 8
PART = 2000
BIG = 20_000


def pivot_count(n: int) -> int:
    return int(min(MAX_PIVOTS, max(32, n // 64)))


def _nearest(unit: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest pivots of each row, nearest first."""
    sims = unit @ pivots.T
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares of huge nor of tiny components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verify(batches, threshold: float):
    """Rows (a, b, n): a forest of a buffer's links as (a, b, 0), and links of each class as (a, null, n)."""
    names = ("key", "i", "j")
    held, size = [], 0

    def linked(l1, h1, l2, h2, x, row):
        small = (h1 - l1) * (h2 - l2) <= 4096
        n1, n2 = (h1 - l1)[small], (h2 - l2)[small]
        pairs = n1 * n2
        for part in np.array_split(np.arange(len(pairs)), max(1, int(pairs.sum()) >> 17)):
            p, wide = pairs[part], np.repeat(n2[part], pairs[part])
            at = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
            i, j = np.repeat(l1[small][part], p) + at // wide, np.repeat(l2[small][part], p) + at % wide
            once = np.repeat(l1[small][part] != l2[small][part], p) | (i < j)
            i, j = i[once], j[once]
            near = np.einsum("ij,ij->i", x[row[i]], x[row[j]]) >= threshold
            yield i[near], j[near]
        for a, b, c, d in zip(l1[~small], h1[~small], l2[~small], h2[~small]):
            for at in range(a, b, 512):
                i, j = np.nonzero(x[row[at : min(b, at + 512)]] @ x[row[c:d]].T >= threshold)
                i, j = i + at, j + c
                if a == c:
                    i, j = i[i < j], j[i < j]
                yield i, j

    def emit(t):
        cols = [t[c].to_numpy() for c in names]
        side, cid, mult = (t[c].to_numpy() for c in ("side", "cid", "mult"))
        x = _unit(_matrix(t["vec"]))
        near = np.sort(np.asarray(t["pivots"].combine_chunks().flatten(), np.int64).reshape(len(cid), -1), axis=1)
        unit = np.cumsum(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
        # a row stands in the list of its pivot and each larger one, or of the one pair it was sent for
        pivot, other = cols[0] >> 32, (cols[0] & 0xFFFFFFFF) - 1
        row, k = np.nonzero(np.where(other[:, None] < 0, near > pivot[:, None], near == other[:, None]))
        second_pivot = near[row, k]
        order = np.lexsort((side[row], second_pivot, unit[row]))
        row, second_pivot = row[order], second_pivot[order]
        list_key = pivot[row] << 32 | second_pivot
        starts = np.flatnonzero(np.concatenate([[True], (unit[row][1:] != unit[row][:-1]) | (second_pivot[1:] != second_pivot[:-1])])) if len(row) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(row)) if len(row) else starts
        ones = np.concatenate([[0], np.cumsum(side[row])])
        middle = ends - (ones[ends] - ones[starts])
        whole = cols[1][row[starts]] == cols[2][row[starts]]
        l1, h1, l2, h2 = starts, np.where(whole, ends, middle), np.where(whole, starts, middle), ends
        which: dict[str, list] = {"node": [], "n": [], "a": [], "b": []}
        for i, j in linked(l1, h1, l2, h2, x, row):
            for at in range(0, len(i), 1 << 17):
                where = list_key[i[at : at + (1 << 17)]]
                p, q = row[i[at : at + (1 << 17)]], row[j[at : at + (1 << 17)]]
                shared = (near[p][:, :, None] == near[q][:, None, :]).any(axis=2)
                rank = np.cumsum(shared, axis=1)
                first = near[p, np.argmax(rank == 1, axis=1)]
                second = near[p, np.argmax(rank == 2, axis=1)]
                mine = (first << 32 | second) == where
                p, q = p[mine], q[mine]
                which["node"] += [cid[p], cid[q]]
                which["n"] += [mult[q], mult[p]]
                a, b = forest(cid[p], cid[q])
                which["a"].append(a), which["b"].append(b)
        if which["node"]:
            node, where = np.unique(np.concatenate(which["node"]), return_inverse=True)
            links = np.bincount(where, np.concatenate(which["n"])).astype(np.int64)
            a, b = forest(np.concatenate(which["a"]), np.concatenate(which["b"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, a])), pa.array(np.concatenate([np.zeros(len(node), np.int64), b]), mask=np.arange(len(node) + len(a)) < len(node)), pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]))], ["a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size > 20_000:
            t = pa.Table.from_batches(held).combine_chunks()
            last = np.all([t[c].to_numpy() == t[c].to_numpy()[-1] for c in names], axis=0)
            cut = int(np.argmax(last))
            if cut:
                yield from emit(t.slice(0, cut))
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield from emit(pa.Table.from_batches(held).combine_chunks())


def _index(classes: DataFrame, n: int, dim: int, threshold: float, nearest: int) -> DataFrame:
    """(a, b, n) rows of _verify over the classes (cid, vec, mult) of one dimension."""
    picked = classes.orderBy(F.xxhash64("vec"), "cid").limit(pivot_count(n)).select("vec").toArrow()  # bounded: MAX_PIVOTS vectors
    pivots = _unit(_matrix(picked["vec"]))
    k = min(nearest, len(pivots))

    def describe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.concatenate([_nearest(part, pivots, k) for part in np.array_split(_unit(_matrix(batch.column("vec"))), max(1, batch.num_rows // 2000))])
            near.sort(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "vec", "mult")), pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * k, pa.int32()), pa.array(near.ravel().astype(np.int32)))], ["cid", "vec", "mult", "pivots"])

    indexed = stage_table(classes.select("cid", "vec", "mult").mapInArrow(describe, "cid long, vec array<float>, mult long, pivots array<int>"), "pivots")
    first = F.slice("pivots", 1, max(1, k - 1))  # ascending: the largest is nobody's smaller one
    sizes = indexed.select(F.explode(first).alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n"))
    big = [r["pivot"] for r in sizes.filter(F.col("n") > BIG).collect()]  # bounded: MAX_PIVOTS
    high = lambda p: F.shiftleft(p.cast("long"), 32)
    pairs = lambda p: F.transform(F.filter("pivots", lambda q: q > p), lambda q: high(p) + q + 1)
    keys = F.flatten(F.transform(first, lambda p: F.when(p.isin(big), pairs(p)).otherwise(F.array(high(p))))) if big else F.transform(first, high)
    postings = indexed.select("cid", F.explode(keys).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.when(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)) == 0, F.lit(1)).otherwise(F.ceil(F.col("n") / PART)).cast("int")
    units = postings.join(lists, "key").withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("key", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), (F.col("salt") > F.col("other")).cast("int").alias("side"), "cid")
    full = units.join(indexed.select("cid", "vec", "mult", "pivots"), "cid")
    placed = full.repartition(shuffle_partitions(classes.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cid")
    return placed.mapInArrow(lambda batches: _verify(batches, threshold), "a long, b long, n long")


def embedding_components(vectors: DataFrame, threshold: float = 0.95, nearest: int = NEAREST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding; others are ignored).

    Null, empty or zero vectors, vectors with a null or non-finite component and rows of null vec_id link
    with nothing: no links, their own component. Vectors link only with vectors of their own length. Each
    other row of an equal vector is a link. Repeated rows give a row each. No rows in, no rows out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"))
    fine = F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(fine, F.col("vec")))
    grouped = rows.filter("vec is not null").groupBy("vec").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low"))
    classes = stage_table(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "classes")
    found = None
    for dim, n in ((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).filter("n > 1").collect()):
        part = _index(classes.filter(F.col("dim") == dim), n, dim, threshold, nearest)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "a long, b long, n long")
    found = stage_table(found, "links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("far"))
    linked = connected_components(found.filter("b is not null").select("a", "b"))
    rooted = classes.join(linked, F.col("cid") == F.col("node"), "left").join(links, F.col("cid") == F.col("a"), "left").select("vec", "low", "mult", F.coalesce("far", F.lit(0)).alias("far"), F.coalesce("root", "cid").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(ids, "root").select("vec", (F.col("mult") - 1 + F.col("far")).alias("n_links"), "component_id")
    out = rows.join(known, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
