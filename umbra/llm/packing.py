"""Sum-of-squares packing of token sequences into bins of a fixed capacity.

A bin's state is its residual gap alone. N(g) counts the open bins of gap g; a piece of length L goes where
the sum of N(g)^2 over gaps becomes smallest: into a bin of some gap g >= L, or into a new bin. Pieces are
packed in bounded groups, longest first; each group's emptiest bins are dissolved and their pieces go to the
next round's fewer groups, so that what is left open doesn't grow with the number of groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import slices, small_batches, stage_table
from umbra.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs at a time, and the share of a group's bins that may be dissolved for the next round.
GROUP_PIECES = 40_000
#: Bytes of documents that are sent to a worker, and encoded, at a time.
BATCH, SLICE = 5 << 19, 3 << 20
DISSOLVE = 0.02


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, in the order given. Ties go to the smallest gap, then to an old bin."""
    n_open = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    big = np.int64(1) << 60
    for i, length in enumerate(lengths.tolist()):
        best, at = 2 * n_open[capacity - length] + 1 if length < capacity else 0, -1
        if length < capacity:
            gaps = n_open[length:capacity]
            change = np.where(gaps > 0, 2 * (n_open[: capacity - length] - gaps) + 2, big)
            if gaps[0] > 0:
                change[0] = 1 - 2 * gaps[0]
            k = int(change.argmin())
            if change[k] <= best:
                at = length + k
        if at < 0:
            b, at = made, capacity
            made += 1
        else:
            b = bins[at].pop()
            n_open[at] -= 1
        where[i], offset[i] = b, capacity - at
        left = at - length
        if left:
            bins[left].append(b)
            n_open[left] += 1
    return where, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """A row per piece: each document's ids and end_id, cut at every capacity ids only if longer."""

    def cut(batches):
        enc = encoder(tokenizer_path)
        for batch in slices(batches, "text", SLICE):
            docs_, pieces, starts, lengths, crcs = [], [], [], [], []
            ids_, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            del batch  # else two batches are held when the next one comes
            for doc, ids in zip(ids_, enc.ids(texts)):
                raw = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4")).cast("B")
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    docs_.append(doc), pieces.append(piece), starts.append(start), lengths.append(stop - start)
                    crcs.append(zlib.crc32(raw[4 * start : 4 * stop]))
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _round(pieces: DataFrame, groups: int, level: int, last: bool, capacity: int) -> DataFrame:
    """Pack each group; sequence_id is null for pieces of dissolved bins, unless this is the last round."""

    def pack(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        whole = pa.Table.from_batches(tables)
        length = whole["length"].to_numpy()
        order = np.argsort(-length, kind="stable")
        group = whole["pack_group"].to_numpy()
        seq, off, keep = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.ones(len(length), bool)
        for g in np.unique(group):
            rows = order[group[order] == g]
            where, at = sum_of_squares(length[rows], capacity)
            fill = np.bincount(where, length[rows]).astype(np.int64)
            seq[rows], off[rows] = (np.int64(level) << 56) + (np.int64(g) << 32) + where, at
            if not last:
                emptiest = np.argsort(fill, kind="stable")[: max(8, int(len(fill) * DISSOLVE))]
                dissolved = np.zeros(len(fill), bool)
                dissolved[emptiest[fill[emptiest] < capacity]] = True
                keep[rows] = ~dissolved[where]
        out = whole.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(seq, pa.int64(), mask=~keep)).append_column("offset", pa.array(off, pa.int64()))
        yield from out.combine_chunks().to_batches()

    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)).cast("long"))  # by place, not content: equal rows spread
    return grouped.repartition(groups, "pack_group").mapInArrow(pack, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Null or empty text is the single id end_id. Repeated rows and null ids are packed as rows of their own;
    an empty table gives none. A document of more than capacity ids is cut into full pieces and a last,
    possibly shorter one. Offsets within a sequence are gapless from 0. A group takes the memory of its
    rows' five numbers.
    """
    with small_batches(docs.sparkSession, BATCH):
        pieces = stage_table(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    done: list[DataFrame] = []
    level = 0
    while True:
        last = groups == 1
        packed = stage_table(_round(pieces, groups, level, last, capacity), f"packed-{level}")
        done.append(packed.filter("sequence_id is not null"))
        if last:
            break
        pieces = packed.filter("sequence_id is null").drop("sequence_id", "offset")
        groups, level = max(1, groups // 16), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
