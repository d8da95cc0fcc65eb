"""The registered queries and the pipeline's stages over a whole small set of tables, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
import xxhash

import corpus_pipeline
from umbra.llm import contamination, queries
from umbra.llm.common import stage_table

WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in WHITE else c for c in low).split(" ") if w]


def shingles(text, width):
    w = words_of(text)
    n = max(1, len(w) - width + 1) if w else 0
    return [" ".join(w[k : k + width]) for k in range(n)]


def roots(n, links):
    parent = list(range(n))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def removed(texts, length):
    """For each text as bytes: which bytes lie in a repeated string of length bytes."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return data, out


def leaks(texts, items, similarity=0.8):
    """(text, item) of every item that some run of words of a text holds within its edits, by the full table."""
    import pyarrow as pa

    said = [contamination.normalized(pa.array([t])).to_pylist()[0] for t in texts]
    asked = [contamination.normalized(pa.array([t])).to_pylist()[0] for t in items]
    numbers: dict = defaultdict(lambda: len(numbers) + 1)
    codes = [[numbers[w] for w in x] for x in asked]
    known = [np.array([numbers.get(w, 0) for w in x] or [0]) for x in said]
    found = set()
    for i, code in enumerate(codes):
        m, edits = len(code), int((1 - similarity) * len(code) + 1e-9)
        able = [t for t, x in enumerate(known) if m and np.isin(code, x).sum() >= m - edits]
        if able:
            wide = max(len(known[t]) for t in able)
            regions = np.zeros((len(able), wide), np.int64)
            for k, t in enumerate(able):
                regions[k, : len(known[t])] = known[t]
            found |= {(able[k], i) for k in np.flatnonzero(contamination.passage_distances(regions, np.tile(code, (len(able), 1))) <= edits)}
    return found


def test_op1(spark, sf, docs):
    fps = []
    for _, text, _ in docs:
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 4)]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    n = len(docs)
    root = roots(n, [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    want = [(d, f"{f:016x}", docs[r][0]) for (d, _, _), f, r in zip(docs, fps, root)]
    assert sorted(tuple(r) for r in queries.op1_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()) == sorted(want)


def test_op2(spark, sf, docs):
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    want = {(docs[t][0], items[i][0]) for t, i in leaks([t for _, t, _ in docs], [t for _, t in items])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_contamination(spark, sf).collect()}
    assert want and got <= want and len(got) >= 0.95 * len(want)


def test_op5(spark, sf, same_as_sql, docs):
    same_as_sql(queries.op5_substrings(spark, sf), queries.OP5_SQL)
    data, gone = removed([t for _, t, _ in docs], 200)
    want = sorted((d, len(b), int(g.sum()), int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()) for (d, _, _), b, g in zip(docs, data, gone))
    assert sorted(tuple(r) for r in queries.op5_substrings(spark, sf).collect()) == want


def test_op7(spark, sf, docs):
    lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    lib.no_truncation(), lib.no_padding()
    counts = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _ in docs]
    want = sorted((d, len((t or "").encode()), n, n > 2048) for (d, t, _), n in zip(docs, counts))
    assert sorted(tuple(r) for r in queries.op7_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_op8(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op8_language(spark, sf).collect()}
    assert sorted(got) == sorted(d for d, _, _ in docs)
    right = 0
    held = 0
    for d, text, lang in docs:
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"] and lang is not None and r["lang_pred"] != "und":
            held, right = held + 1, right + (r["lang_pred"] == lang)
    assert right >= 0.95 * held > 20


def packed_well(rows, texts, capacity=4096):
    """Pieces of texts (doc_id -> text) as the library cuts them, gapless sequences, close to as few as can be."""
    lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    lib.no_truncation(), lib.no_padding()
    want = {}
    for d, t in texts.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want[d, piece] = (a, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(n for _, n, _ in want.values()) // capacity)
    assert len(bins) <= 1.03 * least + 2


def test_op9(spark, sf, docs):
    packed_well(queries.op9_packing(spark, sf).collect(), {d: t for d, t, _ in docs})


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against brute force on what the stage before it kept."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        was, docs = docs, stage_table(stage(spark, docs, sf), name)
        out[name] = ({r["doc_id"]: r for r in was.collect()}, docs.collect())
        assert docs.columns == was.columns or name == "pack"

    was, now = out["language"]
    assert {r["doc_id"] for r in now} == {d for d, r in was.items() if any(c.isalpha() for c in r["text"] or "")}

    was, now = out["near_duplicates"]
    ids = sorted(was)
    sets = [set(shingles(was[d]["text"], 5)) for d in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert sorted(r["doc_id"] for r in now) == sorted({ids[r] for r in roots(len(ids), near)})

    was, now = out["repeated_substrings"]
    ids = sorted(was)
    data, gone = removed([was[d]["text"] for d in ids], 200)
    got = {r["doc_id"]: r for r in now}
    assert sorted(got) == ids
    for d, b, g in zip(ids, data, gone):
        at, kept = 0, []
        for c in b.decode():
            size = len(c.encode())
            kept += [] if g[at : at + size].any() else [c]
            at += size
        assert got[d]["text"] == "".join(kept) and got[d]["n_chars"] == len(kept)

    was, now = out["decontaminate"]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = sorted(was)
    bad = {ids[t] for t, _ in leaks([was[d]["text"] for d in ids], items)}
    dropped = set(ids) - {r["doc_id"] for r in now}
    assert dropped <= bad and len(dropped) >= 0.95 * len(bad)

    was, now = out["pack"]
    packed_well(now, {d: r["text"] for d, r in was.items()})
