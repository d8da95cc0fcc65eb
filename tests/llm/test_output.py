import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from umbra.llm import chat, packing, queries
from umbra.llm.common import small_batches
from umbra.llm.sharding import CommitConflict, ShardStore
from umbra.llm.tokens import Encoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b", "ä["]), st.text(alphabet="ab\\[]<>/sINST \n\té", max_size=25)), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=4))
def test_chat_round_trip(convs):
    conv = np.concatenate([np.full(len(c), k) for k, c in enumerate(convs)])
    roles, texts = (pa.array([t[k] for c in convs for t in c], pa.large_string()) for k in (0, 1))
    strings, first, lo, hi = chat.assemble(conv, roles, texts)
    at = 0
    for c, s in zip(convs, strings.to_pylist()):
        assert [(r, t) for r, t, _, _ in chat.parse(s)] == c
        for _, t in c:
            assert chat.unescape(s.encode()[lo[at] : hi[at]].decode()) == t
            at += 1


def test_chat_cases(spark):
    rows = [(1, 1, "assistant", "b", 9), (1, 0, "user", None, 9), (None, 0, "user", "x", 9), (2, 0, "user", "é" * 100_000, 9), (2, None, None, "first", 9), (3, 0, "assistant", "same", 9), (3, 0, "assistant", "same", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    for limit in (32 << 20, 1):
        got = {r["conv_id"]: r for r in chat.format_conversations(df, limit).collect()}
        assert [(r, t) for r, t, _, _ in chat.parse(got[1]["formatted"])] == [("user", ""), ("assistant", "b")]
        assert [t for _, t, _, _ in chat.parse(got[2]["formatted"])] == ["first", "é" * 100_000] and got[2]["loss_spans"] == []
        assert got[3]["n_turns"] == 2 and len(got[3]["loss_spans"]) == 2 and set(got) == {1, 2, 3, None}
        a, b = got[1]["loss_spans"][0]
        assert got[1]["formatted"][a:b] == "b"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_queries_with_sql(spark, sf, same_as_sql):
    for name, sql in queries.ORACLE_SQL.items():
        same_as_sql(queries.QUERIES[name](spark, sf), sql)


def check_packing(rows, texts, ids, capacity):
    enc = Encoder(WORD_BPE, word_path=False)
    want = []
    for i, t in zip(ids, texts):
        tokens = np.append(np.array(enc._library([t or ""])[0], "<u4"), np.uint32(1)).astype("<u4")
        want += [(i, p, s, len(tokens[s : s + capacity]), zlib.crc32(tokens[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(tokens), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(["the"] * int(n)) for n in rng.integers(0, 40, 150)] + [None, "", "the " * 63, "the " * 200, "x"]
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts)], "doc_id long, text string, piece int")
    for group in (packing.GROUP_PIECES, 20):
        monkeypatch.setattr(packing, "GROUP_PIECES", group)
        rows = packing.pack_documents(df, WORD_BPE, 64).collect()
        n = check_packing(rows, texts, ids, 64)
        assert n <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.pack_documents(df.limit(0), WORD_BPE, 64).count() == 0
    assert check_packing(packing.pack_documents(df.unionByName(df), WORD_BPE, 64).collect(), texts * 2, ids * 2, 64)


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 11, 300)
    where, offset = packing.sum_of_squares(lengths, 10)
    gaps = {}
    for length, b, at in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        counts = np.bincount([g for g in gaps.values() if g], minlength=11)

        def cost(old, new):
            c = counts.copy()
            if old is not None:
                c[old] -= 1
            if new:
                c[new] += 1
            return int((c**2).sum())

        options = [cost(g, g - length) for g in set(gaps.values()) if g >= length] + [cost(None, 10 - length)]
        before = gaps.get(b)
        assert at == (10 - before if before is not None else 0) and cost(before, (10 if before is None else before) - length) == min(options)
        gaps[b] = (10 if before is None else before) - length


def test_shards(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fanout=3, smallest_bytes=1 << 10)
    schema = "doc_id long, text string, shard string, _x int"
    part = lambda a, b: spark.createDataFrame([(k if k % 7 else None, None if k % 5 == 0 else "é" * (k % 50), "clash", k) for k in range(a, b)], schema).coalesce(2)
    assert store.append(part(0, 0)) == 1 and store.read().count() == 0
    for k in range(5):
        assert store.append(part(k * 100, k * 100 + 100)) == k + 2
    before = store.shards()
    assert len(before) == 10 and store.read().count() == 500
    after = store.compact()
    assert after == 7 and len(store.shards()) == 1 and store.read(6).count() == 500
    rows = store.read()
    assert rows.count() == 500 == rows.select("_x").distinct().count() and rows.filter("_shard_rows <> 500 or _version <> 7").count() == 0
    want = part(0, 500)
    assert rows.select(want.columns).exceptAll(want).count() == 0 and want.exceptAll(rows.select(want.columns)).count() == 0
    assert store.compact() == 7
    with pytest.raises(CommitConflict):
        store._replace({before[0].shard}, [])
    assert not store._commit(7, []) and store.vacuum() == 11 and store.read().count() == 500
    assert not [f for f in os.listdir(tmp_path / "s" / "_manifest") if f.startswith(".tmp")]


def test_shards_of_clashing_columns(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/c")
    mine = spark.createDataFrame([(1, "a", 2, "x" * 3_000_000), (1, "a", 2, None)], "_shard int, _Version string, version long, text string")
    assert store.append(mine) == 1
    got = store.read()
    assert {"__shard", "__shard_bytes", "__shard_rows", "__version"} <= set(got.columns)
    assert got.select(mine.columns).exceptAll(mine).count() == 0 and got.count() == 2 and store.read(0).count() == 0


def test_sharding_runs_no_python(spark, sf):
    out = queries.op10_sharding(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    assert out.select("doc_id", "text_sha256").exceptAll(docs).count() == 0 and out.count() == docs.count()


def test_packing_sends_small_batches(spark, monkeypatch):
    name, staged = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    was, stage = spark.conf.get(name), packing.stage_table

    def watched(df, label):
        staged[label] = int(spark.conf.get(name).rstrip("b"))
        return stage(df, label)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    monkeypatch.setattr(packing, "stage_table", watched)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 500)").alias("text"))
    assert packing.pack_documents(docs, WORD_BPE, 4096).count() == 3000
    assert staged["pieces"] == packing.BATCH <= packing.SLICE and spark.conf.get(name) == was
    with small_batches(spark, packing.BATCH):
        got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 7_500_000 and max(got) <= packing.SLICE
