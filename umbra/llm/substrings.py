"""Exact substring dedup by blockwise suffix sorting over a difference cover.

A suffix here is a place where a string of LENGTH bytes begins. Suffixes are put into buckets by the SEED bytes of
smallest hash among their first LENGTH (the leftmost of them): a choice by content alone, so equal strings meet in one
bucket, and runs of suffixes with one seed travel as one piece of text. Three passes over bundles of documents:

1. the seeds of all documents are counted; a suffix whose seed stands nowhere else can't be repeated,
2. the pieces of the others go to their buckets, equal pieces of a bundle once, where they are sorted one bucket at
   a time, long ties by ranks of a difference cover computed before (umbra.llm.suffixes), and neighbours in the order
   are compared byte by byte,
3. the places found come back to the bundles.

Hashes only choose seeds and buckets; which strings are equal is decided by their bytes. Seeds that more than HOT
pieces share are told apart further by a second seed, so that a common phrase doesn't make one bucket of all texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.blocks import (
    ASKED, FAN, Kind, Rolling, answers_in_order, asked_rows, counted, exchange, frame, get_names, get_numbers, level0_parts, mix, no_rows, packed_bundles, put_names,
    put_numbers, squeeze, unframe, unpacked, unsqueeze,
)
from umbra.llm.common import ragged, shuffle_partitions, stage_table
from umbra.llm.suffixes import Texts, repeated

SEED = 32
#: Pieces of one seed beyond which a second seed tells them apart.
HOT = 20_000
#: Bytes of documents packed together.
BUNDLE = 4 << 20
#: Bytes of text whose seeds are chosen at a time, so few that eight bytes for each stay in a core's cache, and bytes of pieces that are sorted at a time (more for one seed's).
CHUNK, SORTED = 1 << 16, 2 << 20
#: Places of pieces that are marked at a time.
MARKED = 1 << 17
_PLACE = np.uint64(21)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _seed_kind(hot: int) -> Kind:
    """Seeds: 0 stands once, 1 repeatedly, 2 in more than hot places."""
    return counted(0, lambda n: (n > 1).astype(np.uint8) + (n > hot), np.uint8)


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of every width values, the leftmost of equals (by all bits but the lowest 21)."""
    x = (values >> _PLACE << _PLACE) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
    return (x & np.uint64((1 << 21) - 1)).astype(np.int64)


class _Chunk:
    """Runs of suffixes with one seed in some documents: base (place of data in the bundle), data, begins, sizes, keys."""

    def __init__(self, base: int, data: np.ndarray, offsets: np.ndarray, length: int):
        self.base, self.data, self.length = base, data, length
        self.begins = self.sizes = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        size = np.diff(offsets)
        self.hashes = Rolling(data).names_of_width(SEED)
        self.at = _leftmost(self.hashes, length - SEED + 1)
        left = np.repeat(offsets[1:], size)[: len(self.at)] - np.arange(len(self.at))
        self.valid = left >= length
        fresh = self.valid.copy()
        fresh[1:] &= (self.at[1:] != self.at[:-1]) | ~self.valid[:-1]
        self._cut(fresh)

    def _cut(self, fresh: np.ndarray) -> None:
        self.begins = np.flatnonzero(fresh)
        run = np.cumsum(fresh)[self.valid] - 1
        self.sizes = np.bincount(run, minlength=len(self.begins))
        self.keys = mix(self.hashes[self.at[self.begins]] ^ _SECOND)  # the smallest hashes are all small: spread them over buckets

    def split(self, hot: np.ndarray) -> None:
        """Runs whose seed is hot (ascending) are cut and keyed by a second seed too."""
        if not len(hot) or not len(self.keys):
            return
        where = np.minimum(np.searchsorted(hot, self.keys), len(hot) - 1)
        is_hot = hot[where] == self.keys
        if not is_hot.any():
            return
        second = _leftmost(mix(self.hashes ^ _SECOND), self.length - SEED + 1)
        fresh = np.zeros(len(self.at), bool)
        fresh[self.begins] = True
        within = np.zeros(len(self.at), bool)
        within[ragged(self.begins[is_hot], self.sizes[is_hot])] = True
        turn = np.concatenate([[False], second[1:] != second[:-1]])
        self._cut(fresh | (within & turn))
        inner = within[self.begins]
        self.keys[inner] = mix(self.keys[inner] + mix(self.hashes[second[self.begins[inner]]] ^ _SECOND))


def _chunks(bundle: pa.Table | pa.RecordBatch, length: int, chunk: int) -> Iterator[_Chunk]:
    base = 0
    for data, offsets, _, _ in unpacked(bundle, chunk):
        if len(data) <= chunk:
            yield _Chunk(base, data, offsets, length)
        else:  # one long document
            for a in range(0, len(data) - length + 1, chunk):
                part = data[a : a + chunk + length - 1]
                yield _Chunk(base + a, part, np.array([0, len(part)]), length)
        base += len(data)


def _runs(chunk: _Chunk) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """base, data, begins, sizes and keys of a chunk: without its hashes, which take 17 times its bytes."""
    return chunk.base, chunk.data, chunk.begins, chunk.sizes, chunk.keys


def _seed_counts(bundle: pa.Table | pa.RecordBatch, length: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    found = [c.keys for c in _chunks(bundle, length, chunk)]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def _within(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some, which ascend."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


class Pieces:
    """Distinct pieces (key, text), ascending, and in how many places each stands."""

    def __init__(self, keys: np.ndarray, texts: list[bytes], counts: np.ndarray):
        self.keys, self.texts, self.counts = keys, texts, counts

    def put(self, a: int, b: int) -> bytes:
        texts = self.texts[a:b]
        joined = b"".join(texts)
        return frame(b - a, put_names(self.keys[a:b]), put_numbers(self.counts[a:b]), put_numbers(np.array([len(t) for t in texts], np.int64)), np.array([len(joined)], np.int64).tobytes(), squeeze(joined))

    @staticmethod
    def get(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        n, keys, counts, sizes, total, joined = unframe(data, 5)
        joined = unsqueeze(joined, int(np.frombuffer(total, np.int64)[0]))
        ends = np.concatenate([[0], np.cumsum(get_numbers(sizes, n, np.int64))]).tolist()
        return get_names(keys, n), get_numbers(counts, n, np.int64), [joined[a:b] for a, b in zip(ends, ends[1:])]

    @staticmethod
    def merge(rows: list[bytes]) -> Pieces:
        number: dict[tuple[int, bytes], int] = {}
        counts: list[int] = []
        for data in rows:
            keys, many, texts = Pieces.get(data)
            for k, c, t in zip(keys.tolist(), many.tolist(), texts):
                at = number.setdefault((k, t), len(counts))
                if at == len(counts):
                    counts.append(c)
                else:
                    counts[at] += c
        order = sorted(number)
        keys = np.array([k for k, _ in order], np.uint64)
        return Pieces(keys, [t for _, t in order], np.array([counts[number[x]] for x in order], np.int64))


class Places:
    """Runs of repeated suffixes within pieces: of how many runs each piece has, and where they begin and end."""

    def __init__(self, many: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        self.many, self.begins, self.ends = many, begins, ends

    def of(self, which: np.ndarray) -> Places:
        first = np.cumsum(self.many) - self.many
        at = ragged(first[which], self.many[which])
        return Places(self.many[which], self.begins[at], self.ends[at])

    def put(self) -> bytes:
        return frame(len(self.many), put_numbers(self.many), put_numbers(self.begins), put_numbers(self.ends))

    @staticmethod
    def join(rows: list[bytes]) -> Places:
        parts = []
        for data in rows:
            n, many, begins, ends = unframe(data, 3)
            many = get_numbers(many, n, np.int64)
            parts.append((many, *(get_numbers(x, int(many.sum()), np.int64) for x in (begins, ends))))
        return Places(*(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)))


def _solve(pieces: Pieces, length: int) -> Places:
    """Where suffixes of pieces are repeated. A piece's own suffixes all differ, since their seeds stand apart."""
    n = len(pieces.keys)
    sizes = np.array([len(t) for t in pieces.texts], np.int64) - length + 1
    again = pieces.counts > 1
    number, begins, ends = [np.flatnonzero(again)], [np.zeros(int(again.sum()), np.int64)], [sizes[again]]
    same = pieces.keys[1:] == pieces.keys[:-1]
    shared = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if n else np.zeros(0, np.int64)
    cost = np.cumsum(sizes[shared] + length)
    a = 0
    while a < len(shared):  # whole seeds at a time
        b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + SORTED, "right")))
        while b < len(shared) and pieces.keys[shared[b]] == pieces.keys[shared[b - 1]]:
            b += 1
        some = shared[a:b]
        a = b
        texts = Texts([pieces.texts[k] for k in some])
        hit = repeated(texts, ragged(texts.begins, sizes[some]), length)
        first = np.concatenate([[True], hit[1:] != hit[:-1] + 1]) if len(hit) else np.zeros(0, bool)
        last = np.concatenate([first[1:], [True]]) if len(hit) else first
        local = np.searchsorted(texts.begins, hit[first], "right") - 1
        keep = ~again[some[local]]
        number.append(some[local][keep])
        begins.append((hit[first] - texts.begins[local])[keep])
        ends.append((hit[last] + 1 - texts.begins[local])[keep])
    number, begins, ends = (np.concatenate(x) for x in (number, begins, ends))
    order = np.argsort(number, kind="stable")
    return Places(np.bincount(number, minlength=n), begins[order], ends[order])


def _piece_kind(length: int) -> Kind:
    def pick(pieces: Pieces, places: Places, data: bytes) -> bytes:
        keys, _, texts = Pieces.get(data)
        which = np.empty(len(texts), np.int64)
        low, high = (np.searchsorted(pieces.keys, keys, side).tolist() for side in ("left", "right"))
        for k, (t, a, b) in enumerate(zip(texts, low, high)):
            while b - a > 1:
                m = (a + b) // 2
                if pieces.texts[m] <= t:
                    a = m
                else:
                    b = m
            which[k] = a
        return places.of(which).put()

    return Kind(Pieces.merge, lambda p: p.keys, Pieces.put, lambda p: _solve(p, length), pick, Places.join)


def _pieces(bundle: pa.Table, found: pa.Table, length: int, chunk: int) -> tuple[Pieces, list[array]]:
    """A bundle's pieces whose seeds are repeated, and the places of each."""
    if not found.num_rows:
        return Pieces(np.zeros(0, np.uint64), [], np.zeros(0, np.int64)), []
    runs = [_runs(c) for c in _chunks(bundle, length, chunk)]
    seeds = np.unique(np.concatenate([keys for *_, keys in runs]) if runs else np.zeros(0, np.uint64))
    answer = answers_in_order(found, _seed_kind(0))
    wanted, hot = seeds[answer > 0], seeds[answer > 1]
    again = _chunks(bundle, length, chunk) if len(hot) else None
    places: dict[tuple[int, bytes], array] = {}  # eight bytes a place: one repeated character has a place at each byte
    for base, raw, begins, sizes, keys in runs:
        c = next(again) if again else None
        keep = _within(keys, wanted)
        if c and _within(keys, hot).any():
            within = np.zeros(len(c.at), bool)
            within[ragged(begins[keep], sizes[keep])] = True
            c.split(hot)
            begins, sizes, keys = c.begins, c.sizes, c.keys
            keep = within[begins]
        data = raw.tobytes()
        for k, a, m in zip(keys[keep].tolist(), begins[keep].tolist(), sizes[keep].tolist()):
            piece = (k, data[a : a + m + length - 1])
            if piece in places:
                places[piece].append(base + a)
            else:
                places[piece] = array("q", (base + a,))
    order = sorted(places)
    return Pieces(np.array([k for k, _ in order], np.uint64), [t for _, t in order], np.array([len(places[x]) for x in order], np.int64)), [places[x] for x in order]


def _own_places(places: list[array]) -> bytes:
    return frame(len(places), put_numbers(np.array([len(p) for p in places], np.int64)), put_numbers(np.frombuffer(b"".join(places), np.int64)))


def _covered(size: int, owns: list[bytes], answers: list[bytes], length: int) -> np.ndarray:
    """Which bytes of a bundle are covered by repeated strings, from its pieces' places and the answers to them."""
    change = np.zeros(size + 1, np.int32)
    for own, answer in zip(owns, answers):
        n, many, flat = unframe(own, 2)
        many = get_numbers(many, n, np.int64)
        flat = get_numbers(flat, int(many.sum()), np.int64)
        answered = Places.join([answer])
        which = np.repeat(np.arange(n, dtype=np.int32), many)
        for a in range(0, len(flat), MARKED):
            runs = answered.of(which[a : a + MARKED])
            base = np.repeat(flat[a : a + MARKED], runs.many)
            np.add.at(change, base + runs.begins, 1)
            np.add.at(change, base + runs.ends + length - 1, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _removals(docs: DataFrame, columns: list[str], length: int, schema: T.StructType, finish) -> DataFrame:
    if length < 2 * SEED:
        raise ValueError(f"length must be {2 * SEED} at least")
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    bundles = stage_table(packed_bundles(docs, columns, BUNDLE), "bundles")
    sources = bundles.count()
    fan, chunk = FAN, CHUNK
    parts = level0_parts(sources, partitions, fan)
    seed_kind, kind = _seed_kind(HOT), _piece_kind(length)

    def ask_seeds(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                asked = asked_rows(seed_kind, _seed_counts(one, length, chunk), 0, one["src"][0].as_py(), 0, parts, fan=fan)
                yield from asked.to_batches()

    def ask_pieces(bundle: pa.Table, found: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            return no_rows(ASKED)
        pieces, places = _pieces(bundle, found, length, chunk)
        return asked_rows(kind, pieces, 0, bundle["src"][0].as_py(), 0, parts, lambda a, b: _own_places(places[a:b]), fan)

    def remove(bundle: pa.Table, found: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            return schema_table(schema)
        gone = _covered(int(bundle["size"][0].as_py()), found["own"].to_pylist(), found["answer"].to_pylist(), length)
        out, base = [], 0
        for data, offsets, null, rows in unpacked(bundle):
            out.append(finish(data, offsets, null, rows, gone[base : base + len(data)]))
            base += len(data)
        return pa.concat_tables(out) if out else schema_table(schema)

    placed = bundles.repartition(partitions, "src").groupBy("src")
    seeds = exchange(bundles.mapInArrow(ask_seeds, ASKED), seed_kind, sources, fan).repartition(partitions, "src")
    asked = placed.cogroup(seeds.groupBy("src")).applyInArrow(ask_pieces, ASKED)
    answers = exchange(asked, kind, sources, fan).repartition(partitions, "src")
    return placed.cogroup(answers.groupBy("src")).applyInArrow(remove, schema)


def schema_table(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def _starts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where removed runs begin; a run never goes on from one document into the next."""
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = mask[edges]
    return begins


def _per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)


def substring_removals(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text; others ignored).

    A byte goes if a length-byte string that covers it starts anywhere else too, in any document or its own;
    strings are judged on the input. Null and empty text: no bytes. A repeated row is another place where its
    strings start. Null doc_ids are rows like others; no rows in, no rows out. A document is handled by one
    task, which takes about 10 times the bytes of its longest document, of 4 MB at least, and about 40 times where one
    character is repeated (measured on 4 MB); its suffixes are sorted elsewhere, in parts.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def digest(data, offsets, null, rows, mask):
        kept = data[~mask].tobytes()
        n, gone = np.diff(offsets), _per_document(mask, offsets)
        ends = np.concatenate([[0], np.cumsum(n - gone)])
        view = memoryview(kept)
        return pa.table({"doc_id": rows.field("c0"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone), "n_spans": pa.array(_per_document(_starts(mask, offsets), offsets)), "kept_sha256": [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]})

    return _removals(cols, ["doc_id"], length, schema, digest)


def remove_substrings(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with repeated strings taken out of text, every column and row kept; n_chars, if there, follows.

    The rule is that of substring_removals(), widened to whole characters: a character goes if any of its
    bytes does. Null text stays null.
    """
    others = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("text", T.StringType())])

    def cut(data, offsets, null, rows, mask):
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        gone = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
        gone[char[mask]] = True
        mask = gone[char] if len(char) else mask
        kept = data[~mask].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - _per_document(mask, offsets))])
        texts = [None if x else kept[a:b].decode() for a, b, x in zip(ends, ends[1:], null)]
        made = {c: rows.field(f"c{k}") for k, c in enumerate(others)}
        if "n_chars" in made:
            made["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(made["n_chars"].type)
        return pa.table(made | {"text": pa.array(texts, pa.string())})

    return _removals(docs, others, length, schema, cut).select(docs.columns)
