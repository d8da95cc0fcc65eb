"""SimHash near-duplicates: fingerprints, a binary-trie self-join on them, components.

The trie is cut into independent subtries. 64 bits fall into m blocks; two fingerprints at k or fewer
differing bits agree in at least m - k blocks. For each choice of m - k blocks the trie is built with these
blocks as its upper levels, where a pair may spend no errors, so each subtrie under them is joined with
itself: node pairs go down together, add up their differing bits, and are dropped when these exceed k. A
subtrie that holds too many fingerprints is salted into parts, and every pair of parts is a task of its own.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import release_slot, shuffle_partitions, slices, stage_table
from umbra.llm.components import connected_components, forest

BITS = 64
#: Fingerprints of one part of a subtrie, node pairs held at once, and leaf pairs that are compared outright.
PART = 60_000
FRONTIER = 400_000
LEAF = 48
#: Pairs held before they are replaced by a spanning forest.
PAIRS = 2_000_000


def shingle_hashes(text: bytes, width: int = 4):
    """Yield arrays of hashes of the text's word shingles, in order; nothing without words, fewer than width words: one shingle."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= width:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    starts = np.concatenate([[0], gaps + 1])[: n - width + 1].tolist()
    ends = np.append(gaps, len(joined))[width - 1 :].tolist()
    count = n - width + 1
    for at in range(0, count, 1 << 16):  # a very long text takes bounded memory
        stop = min(count, at + (1 << 16))
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts[at:stop], ends[at:stop])), repeat(42)), np.uint64, stop - at)


def fingerprint_of(parts) -> int:
    """SimHash of arrays of shingle hashes; 0 without any."""
    ones, count = np.zeros(BITS, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        count += len(h)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of the text's word shingles; 0 without words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, content (a hash of the text) and fp (64 bits as a signed long) of every row; null text counts as empty."""

    def run(batches):
        release_slot()
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint((t or "").encode(), width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(fps.view(np.int64))], ["doc_id", "content", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInArrow(run, "doc_id long, content long, fp long")


def split_bits(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block, from the highest bit down."""
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(BITS - b, b - a) for a, b in zip(bounds, bounds[1:])]


def choose_blocks(n: int, errors: int) -> int:
    """Blocks so that a subtrie holds about a thousand of n evenly spread fingerprints. Any choice is exact."""
    for m in range(errors + 1, errors + 6):
        if n / 2 ** (BITS * (m - errors) / m) <= 1000:
            return m
    return errors + 5


def trie_pairs(keys: np.ndarray, l1: np.ndarray, h1: np.ndarray, l2: np.ndarray, h2: np.ndarray, top: int, errors: int):
    """Yield (i, j) of fingerprints at errors or fewer differing bits, for the node pairs [l1,h1) x [l2,h2).

    keys: uint64, ascending within every node. top: the highest bit in which a node's keys may differ. A pair
    of a node with itself gives each pair of its keys once. Node pairs wait on a stack in bounded bundles.
    """
    stack = [(l1, h1, l2, h2, np.zeros(len(l1), np.int64), top)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        l1, h1, l2, h2, err, bit = stack.pop()
        if len(l1) > FRONTIER:
            half = len(l1) // 2
            stack += [(l1[half:], h1[half:], l2[half:], h2[half:], err[half:], bit), (l1[:half], h1[:half], l2[:half], h2[:half], err[:half], bit)]
            continue
        n1, n2 = h1 - l1, h2 - l2
        leaf = (n1 * n2 <= LEAF) if bit >= 0 else np.ones(len(l1), bool)
        if leaf.any():
            for part in np.array_split(np.flatnonzero(leaf), max(1, int((n1[leaf] * n2[leaf]).sum()) >> 21)):
                a, b = n1[part], n2[part]
                size = a * b
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                wide = np.repeat(b, size)
                i, j = np.repeat(l1[part], size) + at // wide, np.repeat(l2[part], size) + at % wide
                twin = np.repeat(l1[part] == l2[part], size)
                near = (np.bitwise_count(keys[i] ^ keys[j]) <= errors) & (~twin | (i < j))
                yield i[near], j[near]
        if bit < 0 or leaf.all():
            continue
        rest = ~leaf
        l1, h1, l2, h2, err = l1[rest], h1[rest], l2[rest], h2[rest], err[rest]
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        c = ones[bit]
        m1, m2 = h1 - (c[h1] - c[l1]), h2 - (c[h2] - c[l2])
        same = l1 == l2
        parts = [(l1, m1, l2, m2, err), (m1, h1, m2, h2, err), (l1, m1, m2, h2, err + 1)]
        cross = ~same
        parts.append((m1[cross], h1[cross], l2[cross], m2[cross], err[cross] + 1))
        nl1, nh1, nl2, nh2, ne = (np.concatenate(x) for x in zip(*parts))
        keep = (nh1 > nl1) & (nh2 > nl2) & (ne <= errors)
        if keep.any():
            stack.append((nl1[keep], nh1[keep], nl2[keep], nh2[keep], ne[keep], bit - 1))


def _arrange(fp: np.ndarray, chosen: tuple[int, ...], blocks: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Bits reordered with the chosen blocks on top; the number of bits below them. Keeps Hamming distances."""
    out, left = np.zeros_like(fp), BITS
    for k in [*chosen, *(x for x in range(len(blocks)) if x not in chosen)]:
        shift, width = blocks[k]
        left -= width
        out |= ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(left)
    return out, BITS - sum(blocks[k][1] for k in chosen)


def _join_units(batches, choices, blocks, errors):
    """Trie-join the units of a sorted stream, many at a time; emits a spanning forest of each buffer's links."""
    held, size = [], 0
    release_slot()

    def emit(t):
        fp = t["fp"].to_numpy().view(np.uint64)
        cols = [t[c].to_numpy() for c in ("choice", "key", "i", "j")]
        side = t["side"].to_numpy()
        for choice in np.unique(cols[0]):
            mine = np.flatnonzero(cols[0] == choice)
            keys, below = _arrange(fp[mine], choices[choice], blocks)
            unit = [c[mine] for c in cols[1:]]
            new = np.concatenate([[True], (unit[0][1:] != unit[0][:-1]) | (unit[1][1:] != unit[1][:-1]) | (unit[2][1:] != unit[2][:-1])])
            number = np.cumsum(new) - 1
            order = np.lexsort((keys, side[mine], number))
            keys, number, sides = keys[order], number[order], side[mine][order]
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            ends = np.append(starts[1:], len(keys))
            ones = np.concatenate([[0], np.cumsum(sides)])
            middle = ends - (ones[ends] - ones[starts])
            whole = (unit[1] == unit[2])[order][starts]
            l1, h1 = starts, np.where(whole, ends, middle)
            l2, h2 = np.where(whole, starts, middle), ends
            ok = (h1 > l1) & (h2 > l2)
            found, pairs = [], 0
            for i, j in trie_pairs(keys, l1[ok], h1[ok], l2[ok], h2[ok], below - 1, errors):
                found.append((i, j))
                pairs += len(i)
                if pairs > PAIRS:  # a dense group has far more pairs than fingerprints
                    found = [forest(*map(np.concatenate, zip(*found)))]
                    pairs = len(found[0][0])
            if pairs:
                back = fp[mine][order].view(np.int64)
                a, b = (back[np.concatenate(x)] for x in zip(*found))
                node, root = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size > 300_000:
            t = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(t.num_rows, bool)
            for c in ("choice", "key", "i", "j"):
                v = t[c].to_numpy()
                last &= v == v[-1]
            cut = int(np.argmax(last))
            if cut:
                yield from emit(t.slice(0, cut))
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield from emit(pa.Table.from_batches(held).combine_chunks())


def fingerprint_links(distinct: DataFrame, errors: int = 4, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), connecting all that lie at errors or fewer
    differing bits: a spanning forest of each task's links, so that a dense group doesn't give all its pairs."""
    spark = distinct.sparkSession
    m = blocks or choose_blocks(distinct.count(), errors)
    layout, choices = split_bits(m), list(combinations(range(m), m - errors))

    def key(chosen):
        k = F.lit(0).cast("long")
        for b in chosen:
            shift, width = layout[b]
            k = F.shiftleft(k, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        return k

    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), key(ch).alias("key")) for c, ch in enumerate(choices)])).alias("u")).select("fp", "u.choice", "u.key")
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    units = rows.join(sizes, ["choice", "key"]).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("choice", "key", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), (F.col("salt") > F.col("other")).cast("int").alias("side"), "fp")
    placed = units.repartition(shuffle_partitions(spark), "choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")
    return placed.mapInArrow(lambda batches: _join_units(batches, choices, layout, errors), "a long, b long")


def _rooted(docs: DataFrame, errors: int, width: int) -> DataFrame:
    """doc_id, content (hash of the text), fp and the root fingerprint of its component, of every row."""
    fps = stage_table(fingerprints(docs, width), "fingerprints")
    distinct = stage_table(fps.select("fp").distinct(), "distinct-fingerprints")
    linked = connected_components(fingerprint_links(distinct, errors))
    return fps.join(linked, F.col("fp") == F.col("node"), "left").select("doc_id", "content", "fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, errors: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text; others ignored).

    Null or empty text and text of white space alone: fingerprint zero, linked like any other. Fewer than
    width words: one shingle of them all. Equal texts meet as one fingerprint and are never paired. Repeated
    rows give a row each; a null doc_id never becomes a component's id, which is null only where a component
    has no other. No rows in, no rows out.
    """
    rows = stage_table(_rooted(docs, errors, width), "rooted")
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, errors: int = 4, width: int = 4) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, with all its columns.

    It is the row of the smallest doc_id (nulls last); among rows that share it, of the smallest text hash;
    of rows equal in both, any one.
    """
    return keep_smallest(docs, _rooted(docs, errors, width))


def keep_smallest(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of docs that keep_one_of_each() keeps; rooted: doc_id, content and root of every row."""
    same = rooted.groupBy("root", "doc_id", "content").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "content", "n")
    kept = stage_table(same.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.content").alias("kept_content"), F.col("k.n").alias("n")), "kept")
    keyed = docs.withColumns({"_key_id": F.col("doc_id").cast("long"), "_key_content": F.xxhash64("text")})

    def of(part: DataFrame) -> DataFrame:
        return keyed.join(part, keyed["_key_id"].eqNullSafe(part["kept_id"]) & (keyed["_key_content"] == part["kept_content"]), "left_semi")

    out = of(kept.filter("n = 1"))
    if kept.filter("n > 1").limit(1).count():
        out = out.unionByName(of(kept.filter("n > 1")).dropDuplicates(["_key_id", "_key_content"]))
    return out.drop("_key_id", "_key_content")
