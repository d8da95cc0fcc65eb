"""Near-duplicates by the Jaccard similarity of their word shingles, 0.8 or more: every pair found, every link checked.

SimHash alone can't give these: at similarity 0.8 fingerprints differ in 10 of 64 bits on average and in 20 at times,
where unrelated texts begin. So its trie join at SIMHASH_BITS only retrieves first: it ties most groups together, and
its pairs are checked. What it leaves apart is retrieved without loss by prefixes: with all shingles in one global
order, two sets of n and m that share the 4/9 (n + m) which 0.8 asks for share one among the first n - ceil(0.8 n) + 1
of theirs. Sets are paired in the list of each such shingle unless their sizes or places rule 0.8 out, or they are in one
group already. Pairs that bitmaps of the sets leave possible are checked on the whole sets. Any order is exact; ours puts what a sample shows to be common last.

Shingles are compared by 64-bit hashes, and rows of equal sets of shingles (a 64-bit hash of the set) are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.blocks import ASKED, answers_in_order, asked_rows, counted, exchange, level0_parts, no_rows
from umbra.llm.common import intermediates, ragged, release_slot, shuffle_partitions, slices, stage_table
from umbra.llm.components import connected_components
from umbra.llm.simhash import fingerprint_links, fingerprint_of, keep_smallest, shingle_hashes

SIMHASH_BITS = 6
#: One text in SAMPLE tells which shingles are common: those of COMMON_TEXTS sampled texts, COMMON of them at most.
SAMPLE, COMMON_TEXTS, COMMON = 32, 3, 200_000
#: Rows of 16 bytes up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Candidate pairs held at once in a task.
PAIRS = 1 << 20


LISTED = "key long, node long, n int, pos int"


def prefix_length(n):
    """How many first shingles of n are listed."""
    return n - (4 * n + 4) // 5 + 1


def alike(shared, n, m):
    """Whether the Jaccard similarity of sets of n and m with so many shared is 0.8 or more."""
    return 9 * shared >= 4 * (n + m)


def parity(h: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set where an odd number of them falls; as many bits as there are hashes
    or up to twice as many. Bitmaps of two sets differ in no more bits than the sets do in members."""
    size = 64
    while size < len(h):
        size *= 2
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def surely_apart(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether bitmaps alone show that sets of n and m aren't alike: those have at most (n + m) / 9 members apart."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    wide, size = max(len(x), len(y)) * 8, min(len(x), len(y)) * 8
    while wide > size:  # the wider one is folded: parities of a half add to those of the other
        wide //= 2
        mask = (1 << wide) - 1
        if len(x) > len(y):
            a = (a & mask) ^ (a >> wide)
        else:
            b = (b & mask) ^ (b >> wide)
    return 9 * (a ^ b).bit_count() > n + m


def _distinct(text: str | None, width: int) -> np.ndarray:
    parts = list(shingle_hashes((text or "").encode(), width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts hold, ascending, and in how many."""

    def run(batches):
        release_slot()
        for batch in slices(batches, "text"):
            found = [_distinct(t, width) for t in batch.column("text").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_TEXTS)
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()  # bounded by COMMON
    keys, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


BUNDLE = "src long, doc_id array<long>, content array<long>, node array<long>, n array<int>, fp array<long>, bits array<binary>, prefix binary"


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """BUNDLE rows of some documents each: doc_id, content (hash of the text), node (hash of the set), n (its size), fp
    (SimHash), bits (see parity), and the prefixes (first shingles) of all documents one after another."""
    keys, counts = _common(docs, width)

    def run(batches):
        release_slot()
        for batch in slices(batches, "text"):
            if not batch.num_rows:
                continue
            nodes, sizes, fps, bits, prefixes = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                parts = list(shingle_hashes((t or "").encode(), width))
                fps.append(fingerprint_of(parts))
                h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                sizes.append(len(h))
                bits.append(parity(h))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    h = h[np.argsort(np.where(keys[at] == h, counts[at], 0), kind="stable")]
                prefixes.append(h[: prefix_length(len(h)) if len(h) else 0].tobytes())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), x)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *map(one, (batch.column("doc_id"), batch.column("content"), longs[0], pa.array(sizes, pa.int32()), longs[1], pa.array(bits, pa.binary()))), pa.array([b"".join(prefixes)], pa.binary())], ["src", "doc_id", "content", "node", "n", "fp", "bits", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInArrow(run, BUNDLE)
    return rows.withColumn("src", F.monotonically_increasing_id())


class _Prefixes:
    """A bundle's prefix entries, each set once: key, node, n and pos."""

    def __init__(self, bundle: pa.Table | pa.RecordBatch):
        nodes, sizes = (np.asarray(bundle[c][0].values, np.int64) for c in ("node", "n"))
        lengths = np.where(sizes > 0, prefix_length(sizes), 0)
        keys = np.frombuffer(bundle["prefix"][0].as_py(), np.uint64)
        _, first = np.unique(nodes, return_index=True)
        starts = (np.cumsum(lengths) - lengths)[first]
        lengths = lengths[first]
        self.key = keys[ragged(starts, lengths)]
        self.node, self.n = np.repeat(nodes[first], lengths), np.repeat(sizes[first], lengths)
        self.pos = ragged(np.zeros(len(lengths), np.int64), lengths)


def _listed(bundles: DataFrame) -> DataFrame:
    """key, node, n, pos of the prefix entries whose key another entry may have: keys are counted first, by 48 bits,
    packed, so that the many that stand alone don't travel as rows."""
    spark = bundles.sparkSession
    partitions, sources = shuffle_partitions(spark), bundles.count()
    parts = level0_parts(sources, partitions)
    kind = counted(16, lambda n: (n > 1).astype(np.uint8), np.uint8)
    cut = ~np.uint64(0xFFFF)

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                names = np.unique(_Prefixes(one).key & cut, return_counts=True)
                yield from asked_rows(kind, names, 0, one["src"][0].as_py(), 0, parts).to_batches()

    def emit(bundle: pa.Table, found: pa.Table) -> pa.Table:
        if not bundle.num_rows or not found.num_rows:
            return no_rows(LISTED)
        p = _Prefixes(bundle)
        names, where = np.unique(p.key & cut, return_inverse=True)
        keep = answers_in_order(found, kind)[where] > 0
        return pa.table({"key": p.key[keep].view(np.int64), "node": p.node[keep], "n": p.n[keep].astype(np.int32), "pos": p.pos[keep].astype(np.int32)})

    answers = exchange(bundles.select("src", "node", "n", "prefix").mapInArrow(ask, ASKED), kind, sources).repartition(partitions, "src")
    placed = bundles.select("src", "node", "n", "prefix").repartition(partitions, "src")
    return placed.groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(emit, LISTED)


def _lists(batches, columns):
    """Columns of a stream in the order of its first column, key, cut where the key changes, a bounded buffer at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size > 300_000:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t["key"].to_numpy()
            cut = int(np.argmax(key == key[-1]))
            if cut:
                yield [t.slice(0, cut)[c].to_numpy() for c in columns]
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        t = pa.Table.from_batches(held)
        yield [t[c].to_numpy() for c in columns]


def _shared(batches):
    """The rows whose shingle another set lists too; of rows of one set, which copies in several bundles give, one."""
    release_slot()
    names = ["key", "node", "n", "pos"]
    for cols in _lists(batches, names):
        fresh = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        cols = [c[fresh] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        # the smaller neighbour in the list is 0.8 as large at least, or the larger one isn't larger than that
        close = same & (5 * cols[2][:-1].astype(np.int64) >= 4 * cols[2][1:].astype(np.int64))
        keep &= np.concatenate([[False], close]) | np.concatenate([close, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)


def _candidates(batches):
    """Pairs of sets of one list that sizes and places leave possible and that aren't in one group."""
    release_slot()
    for key, node, n, pos, root in _lists(batches, ["key", "node", "n", "pos", "root"]):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new) - 1
        begin = np.flatnonzero(new)[number]
        # within a list sizes ascend: partners of i are those before it from 0.8 of its size on
        scaled = number * (np.int64(1) << 36) + n
        low = np.maximum(begin, np.searchsorted(scaled, number * (np.int64(1) << 36) + (4 * n + 4) // 5))
        many = np.arange(len(n)) - low
        ends = np.cumsum(many)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            i = np.repeat(np.arange(at, stop), many[at:stop])
            j = ragged(low[at:stop], many[at:stop])
            at = stop
            ok = (root[i] != root[j]) & alike(np.minimum(n[i] - pos[i], n[j] - pos[j]), n[i], n[j])
            if ok.any():
                a, b = node[i[ok]], node[j[ok]]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, h: ascending shingles) are alike."""

    def run(batches):
        release_slot()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(alike(shared, len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("h").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _hashed(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and h (its shingles) of the wanted sets (node, content: a text that has it)."""

    def run(batches):
        release_slot()
        for batch in slices(batches, "text"):
            found = [_distinct(t, width) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in found])])
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], ["node", "h"])

    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.xxhash64("text").alias("content"), "text").join(F.broadcast(wanted) if few else wanted, "content").select("node", "text")
    return texts.dropDuplicates(["node"]).mapInArrow(run, "node long, h array<long>")


def _near(batches):
    """The pairs whose bitmaps don't rule them out."""
    for batch in batches:
        keep = [not surely_apart(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, pairs: DataFrame, active: DataFrame, width: int) -> DataFrame:
    """Of pairs (a, b) those whose sets are alike. Bitmaps rule out most others without loss; only for the rest are the
    sets themselves made from their texts and compared."""
    with intermediates(docs.sparkSession):
        left = active.select(F.col("node").alias("a"), F.col("bits").alias("x"), "n")
        right = active.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
        pairs = stage_table(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_near, "a long, b long"), "near-pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = stage_table(active.join(ends, "node").select("node", "content"), "wanted")
        return stage_table(_checked(pairs, stage_table(_hashed(docs, wanted, width), "pair-shingles")), "alike", keep=True)


def similar_roots(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, content (hash of the text) and root (a node of its group) of every row; null text counts as empty."""
    spark = docs.sparkSession
    bundles = stage_table(shingle_sets(docs, width), "shingle-sets")
    columns = ("doc_id", "content", "node", "n", "fp", "bits")
    rows = bundles.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")
    placed = _listed(bundles).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "n", "node")
    lists = stage_table(placed.mapInArrow(_shared, LISTED), "shared-shingles")
    active = stage_table(rows.join(lists.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("content").alias("content"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bits").alias("bits")), "active-sets")

    near = connected_components(fingerprint_links(active.select("fp").distinct(), SIMHASH_BITS))
    tied = active.join(near, F.col("fp") == near["node"], "left").select(active["node"], F.coalesce("root", "fp").alias("tie"))
    heads = tied.groupBy("tie").agg(F.min("node").alias("a"))
    pairs = tied.join(heads, "tie").filter("node <> a").select("a", F.col("node").alias("b"))
    first = _verified(docs, stage_table(pairs, "simhash-pairs"), active, width)
    roots = connected_components(first)

    grouped = lists.join(roots, "node", "left").select("key", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    placed = grouped.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "n")
    pairs = stage_table(placed.mapInArrow(_candidates, "a long, b long").distinct(), "prefix-pairs")
    second = _verified(docs, pairs, active, width)
    roots = connected_components(first.unionByName(second))
    return rows.join(roots, "node", "left").select("doc_id", "content", F.coalesce("root", "node").alias("root"))


def keep_one_of_similar(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs without near-duplicates of similarity 0.8: one row of each group stays, with all its columns.

    Groups are the components over pairs of 0.8 or more. Which row stays: see simhash.keep_one_of_each().
    """
    with intermediates(docs.sparkSession):
        rooted = stage_table(similar_roots(docs, width), "similar", keep=True)
    return keep_smallest(docs, rooted)
