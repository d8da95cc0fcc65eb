"""Documents in packed blocks, and an exchange by which blocks ask what the whole corpus knows of something of theirs.

Each block sends what it asks about, cut by hash into buckets; a bucket merges what it gets from all blocks and
answers each of them. So that rows stay in proportion to the blocks (and not to blocks times buckets), no block
is cut into more than FAN parts and no group merges more than about FAN rows: beyond FAN blocks, groups of FAN
of them are merged part by part first, what they hold together is cut into FAN finer parts and asked in their
place, level by level, and answers come back the same way. A thing asked about by very many blocks is therefore
aggregated before it meets the rest, and no task ever holds more than its part of FAN blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.common import block_count, release_slot, shuffle_partitions, slices

#: Parts of a block, and rows that a group merges.
FAN = 256
ASKED = "path long, src long, bucket int, data binary, own binary"
ANSWERED = "path long, src long, bucket int, own binary, answer binary"


def squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unsqueeze(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True) if size else b""


def put_numbers(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: planes of small numbers are zeros."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def get_numbers(data: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data, n * width), np.uint8).reshape(width, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype)


def put_names(names: np.ndarray, drop_bits: int = 0) -> bytes:
    """Ascending uint64 names, whose low drop_bits are zero, as deltas."""
    return put_numbers(np.diff(names >> np.uint64(drop_bits), prepend=np.uint64(0)))


def get_names(data: bytes, n: int, drop_bits: int = 0) -> np.ndarray:
    return np.cumsum(get_numbers(data, n, np.uint64)) << np.uint64(drop_bits)


def frame(n: int, *parts: bytes) -> bytes:
    """A number and some byte strings in one."""
    return np.array([n, *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unframe(data: bytes, parts: int) -> list:
    """The number and the byte strings that frame() got."""
    n, *sizes = np.frombuffer(data, np.int64, parts + 1).tolist()
    ends = np.cumsum([8 * (parts + 1), *sizes])
    return [n, *(data[a:b] for a, b in zip(ends, ends[1:]))]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit polynomial hashes of any substring of a byte array, from one prefix sum. Strings built for it can
    have equal hashes, so equality of strings must not rest on them where a wrong one would change results."""

    _base = np.uint64(0x9E3779B97F4A7C15)
    _table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    _power = _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Rolling._power) <= len(data):
            size = max(1 << 20, len(data) + 1)
            for name, base in (("_power", int(self._base)), ("_inverse", pow(int(self._base), -1, 1 << 64))):
                powers = np.full(size, np.uint64(base), np.uint64)
                powers[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(powers))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._table[data] * self._power[: len(data)], out=self.sums[1:])

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self._inverse[starts])

    def names_of_width(self, width: int) -> np.ndarray:
        """Of the substring of width at every start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self._inverse[:n])


def pack_rows(batch: pa.RecordBatch, key: np.ndarray, columns: int) -> pa.RecordBatch:
    """src, rows, lens, size, payload: the rows of each run of equal keys as one row, texts joined and compressed."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
    ends = np.append(starts[1:], len(key))
    raw = [None if x is None else x.encode() for x in batch.column("text").to_pylist()]
    lens = pa.array([-1 if x is None else len(x) for x in raw], pa.int64())
    rows = pa.StructArray.from_arrays([batch.column(f"c{k}") for k in range(columns)], [f"c{k}" for k in range(columns)])
    offsets = pa.array(np.append(starts, len(key)), pa.int32())
    joined = [b"".join(x or b"" for x in raw[a:b]) for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(key[starts], pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.ListArray.from_arrays(offsets, lens), pa.array([len(j) for j in joined], pa.int64()), pa.array([squeeze(j) for j in joined], pa.binary())],
        ["src", "rows", "lens", "size", "payload"],
    )


def _packed_schema(docs: DataFrame, columns: list[str]) -> T.StructType:
    inner = T.StructType([T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(columns)])
    return T.StructType([T.StructField("src", T.LongType()), T.StructField("rows", T.ArrayType(inner)), T.StructField("lens", T.ArrayType(T.LongType())), T.StructField("size", T.LongType()), T.StructField("payload", T.BinaryType())])


def packed_blocks(docs: DataFrame, columns: list[str], block_bytes: int = 12 << 20) -> tuple[DataFrame, int]:
    """Rows (src, rows array<struct of columns>, lens array<long>, size, payload) placed by src, and the number
    of blocks. lens has -1 for a null text. A row's block is chosen by its hash and its input partition, so that
    neither a source nor equal rows fill one block; which rows share a packed row may differ between attempts."""
    blocks = block_count(docs, "text", block_bytes)
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).alias("blk"), "text", *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])

    def pack(batches):
        release_slot()
        for batch in batches:
            if batch.num_rows:
                blk = batch.column("blk").to_numpy()
                order = np.argsort(blk, kind="stable")
                yield pack_rows(batch.take(pa.array(order)), blk[order], len(columns))

    return keyed.mapInArrow(pack, _packed_schema(docs, columns)).repartition(min(blocks, 4 * shuffle_partitions(docs.sparkSession)), "src"), blocks


def packed_bundles(docs: DataFrame, columns: list[str], bundle_bytes: int = 4 << 20) -> DataFrame:
    """Rows as of packed_blocks(), of consecutive documents of about bundle_bytes; a longer document comes alone.
    src numbers them; write the table before use, so that numbers and contents are the same to all who read it."""
    keyed = docs.select("text", *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])

    def pack(batches):
        release_slot()
        for batch in slices(batches, "text", bundle_bytes):
            if batch.num_rows:
                yield pack_rows(batch, np.zeros(batch.num_rows, np.int64), len(columns))

    return keyed.mapInArrow(pack, _packed_schema(docs, columns)).withColumn("src", F.monotonically_increasing_id())


def unpacked(table: pa.Table | pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, offsets, is_null, rows) of runs of documents of about limit bytes; a longer document comes alone."""
    release_slot()
    for k in range(table.num_rows):
        lens = np.asarray(table["lens"][k].values, np.int64)
        rows = table["rows"][k].values
        data = np.frombuffer(unsqueeze(table["payload"][k].as_py(), table["size"][k].as_py()), np.uint8)
        ends = np.cumsum(np.maximum(lens, 0))
        a = 0
        while a < len(lens):
            base = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield data[base : ends[b - 1]], np.concatenate([[0], ends[a:b] - base]), lens[a:b] < 0, rows.slice(a, b - a)
            a = b


def bucket_of(keys: np.ndarray, level: int, parts: int, fan: int) -> np.ndarray:
    """The bucket of keys at a level. Ascending keys of one bucket of the level above have ascending buckets."""
    x = keys >> np.uint64(32)
    for _ in range(level):
        x = (x * np.uint64(fan)) & np.uint64(0xFFFFFFFF)
    return ((x * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Kind:
    """What is asked about. Data is what one row holds, encoded; things are ordered by their uint64 keys.

    merge(list of data) -> things together; keys(things) -> their keys, ascending; cut(things, a, b) -> data of
    some; solve(things) -> their answers; pick(things, answers, data) -> encoded answers of one row that was
    merged, in its order; join(list of encoded answers) -> answers.
    """

    merge: Callable[[list[bytes]], Any]
    keys: Callable[[Any], np.ndarray]
    cut: Callable[[Any, int, int], bytes]
    solve: Callable[[Any], Any]
    pick: Callable[[Any, Any, bytes], bytes]
    join: Callable[[list[bytes]], Any]


def level0_parts(sources: int, partitions: int, fan: int = FAN) -> int:
    return fan if sources > fan else min(fan, max(sources, partitions))


def asked_rows(kind: Kind, things: Any, path: int, src: int, level: int, parts: int, own: Callable[[int, int], bytes] | None = None, fan: int = FAN) -> pa.Table:
    """The rows by which src asks about things. own(a, b): what comes back with the answers to things a to b."""
    bucket = bucket_of(kind.keys(things), level, parts, fan)
    cuts = np.searchsorted(bucket, np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cuts))
    spans = [(int(cuts[k]), int(cuts[k + 1])) for k in used]
    same = np.ones(len(used), np.int64)
    return pa.table(
        {
            "path": pa.array(same * path), "src": pa.array(same * src), "bucket": pa.array(used, pa.int32()),
            "data": pa.array([kind.cut(things, a, b) for a, b in spans], pa.binary()),
            "own": pa.array([own(a, b) if own else None for a, b in spans], pa.binary()),
        }
    )


def no_rows(ddl: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl)).empty_table()


def exchange(asked: DataFrame, kind: Kind, sources: int, fan: int = FAN, level: int = 0) -> DataFrame:
    """The answers to asked rows (of level 0, path 0): path, src, bucket, own, answer."""
    spark = asked.sparkSession
    partitions = shuffle_partitions(spark)

    def reply(table: pa.Table, things: Any, answers: Any) -> pa.Table:
        found = [kind.pick(things, answers, d) for d in table["data"].to_pylist()]
        return pa.table({"path": table["path"], "src": table["src"], "bucket": table["bucket"], "own": table["own"], "answer": pa.array(found, pa.binary())})

    if sources <= fan:

        def top(table: pa.Table) -> pa.Table:
            release_slot()
            things = kind.merge(table["data"].to_pylist())
            return reply(table, things, kind.solve(things))

        return asked.repartition(partitions, "path", "bucket").groupBy("path", "bucket").applyInArrow(top, ANSWERED)

    groups = -(-sources // fan)
    keyed = asked.withColumn("up", F.col("path") * fan + F.col("bucket")).withColumn("grp", F.pmod(F.xxhash64("src"), F.lit(groups))).repartition(partitions, "up", "grp")

    def raise_(table: pa.Table) -> pa.Table:
        release_slot()
        return asked_rows(kind, kind.merge(table["data"].to_pylist()), table["up"][0].as_py(), table["grp"][0].as_py(), level + 1, fan, fan=fan)

    def lower(table: pa.Table, found: pa.Table) -> pa.Table:
        release_slot()
        things = kind.merge(table["data"].to_pylist())
        parts = sorted(zip(found["bucket"].to_pylist(), found["answer"].to_pylist()))
        return reply(table, things, kind.join([x for _, x in parts]))

    upper = exchange(keyed.groupBy("up", "grp").applyInArrow(raise_, ASKED), kind, groups, fan, level + 1)
    return keyed.groupBy("up", "grp").cogroup(upper.repartition(partitions, "path", "src").groupBy("path", "src")).applyInArrow(lower, ANSWERED)


def counted(drop_bits: int, of: Callable[[np.ndarray], np.ndarray], dtype) -> Kind:
    """Names (uint64) with counts: the answer is of(total count), of dtype, for every name."""

    def put(names: np.ndarray, counts: np.ndarray) -> bytes:
        return frame(len(names), put_names(names, drop_bits), put_numbers(counts.astype(np.int64)))

    def get(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, names, counts = unframe(data, 2)
        return get_names(names, n, drop_bits), get_numbers(counts, n, np.int64)

    def merge(rows: list[bytes]):
        parts = [get(x) for x in rows]
        names, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(names)
        names = names[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        return names[first], np.add.reduceat(counts[order], first) if len(first) else counts

    def pick(things, answers, data: bytes) -> bytes:
        names = get(data)[0]
        return frame(len(names), put_numbers(answers[np.searchsorted(things[0], names)]))

    def join(rows: list[bytes]) -> np.ndarray:
        parts = [unframe(x, 1) for x in rows]
        return np.concatenate([get_numbers(x, n, dtype) for n, x in parts]) if parts else np.zeros(0, dtype)

    return Kind(merge, lambda things: things[0], lambda things, a, b: put(things[0][a:b], things[1][a:b]), lambda things: of(things[1]).astype(dtype), pick, join)


def answers_in_order(found: pa.Table, kind: Kind) -> Any:
    """A source's answers in the order of its ascending keys."""
    return kind.join([x for _, x in sorted(zip(found["bucket"].to_pylist(), found["answer"].to_pylist()))])
