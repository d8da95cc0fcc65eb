import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from umbra.llm import blocks, embeddings, simhash, similar, substrings, suffixes
from umbra.llm.components import connected_components, forest

DOCS = "doc_id long, text string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "s", 0) for k, t in enumerate(texts)], DOCS)


def slow_fingerprint(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(near):
    comp = np.arange(len(near))
    while True:
        new = np.array([comp[row].min() for row in near])
        if (new == comp).all():
            return comp
        comp = new


def test_components_and_forest(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    chain = np.arange(1000, 1040)
    a, b = np.concatenate([a, chain[:-1]]), np.concatenate([b, chain[1:]])
    node, root = forest(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")).collect()}
    want = dict(zip(node.tolist(), root.tolist()))
    assert all(got[k] == v for k, v in want.items()) and {got[k] for k in chain.tolist()} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("m", [5, 6, 7])
def test_trie_join_finds_every_pair(m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    near = base.copy()
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    keys = np.unique(np.concatenate([base, near, base ^ np.uint64(0b11111), np.zeros(1, np.uint64)]))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4, 1)))}
    zero, all_ = np.array([0]), np.array([len(keys)])
    assert {(min(i, j), max(i, j)) for a, b in simhash.trie_pairs(keys, zero, all_, zero, all_, 63, 4) for i, j in zip(a.tolist(), b.tolist())} == want
    half = np.array([len(keys) // 2])
    got = {(i, j) for a, b in simhash.trie_pairs(keys, zero, half, half, all_, 63, 4) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i, j in want if i < half[0] <= j}
    blocks = simhash.split_bits(m)
    arranged, below = simhash._arrange(keys, tuple(range(m - 4)), blocks)
    assert (np.bitwise_count(arranged ^ arranged[0]) == np.bitwise_count(keys ^ keys[0])).all() and below == 64 - sum(w for _, w in blocks[: m - 4])


def test_links_are_split_when_a_subtrie_is_hot(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 40).astype(np.int64)
    fps = np.unique(np.concatenate([centre, centre ^ 5, centre ^ 96, rng.integers(0, 1 << 62, 100)]))
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 4
    want = dict(zip(fps.tolist(), fps[slow_components(near)].tolist()))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    for part in (simhash.PART, 2):
        monkeypatch.setattr(simhash, "PART", part)
        found = {r["node"]: r["root"] for r in connected_components(simhash.fingerprint_links(df, 4)).collect()}
        groups = {}
        for x in fps.tolist():
            groups.setdefault(found.get(x, x), set()).add(want[x])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


TEXTS = [
    "the quick brown fox jumps over the lazy dog again and again", "THE quick brown fox\tjumps over the lazy dog  again and again", "", None, " \n\t", "one two", "One\x0btwo", "!!! ???",
    "Straße É é one two three four", "straße É é one two three four", "word " * 3000, "word " * 3000, "word " * 2999 + "end", "a b c d e",
]


def test_simhash_edges_against_brute_force(spark):
    df = frame(spark, TEXTS + TEXTS[:2], list(range(len(TEXTS))) + [0, None]).withColumns({c: F.lit("mine") for c in ("fingerprint", "component_id", "fp", "root", "node", "content")})
    rows = simhash.simhash_components(df).collect()
    texts, ids = TEXTS + TEXTS[:2], list(range(len(TEXTS))) + [0, None]
    fps = np.array([slow_fingerprint(t, 4) for t in texts], np.uint64)
    comp = slow_components(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    low = {c: min((i for i, k in zip(ids, comp) if k == c and i is not None), default=None) for c in comp}
    want = sorted(((i, f"{int(f):016x}", low[c]) for i, f, c in zip(ids, fps, comp)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=repr) == want
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_dense_groups_do_not_hold_their_pairs(spark, monkeypatch):
    """All fingerprints within two bits of one: far more pairs than fingerprints, contracted as they come."""
    base = 0x0123456789ABCDEF
    near = [base] + [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    far = [base ^ 0xFFFF0000FFFF0000, base ^ 0xFFFF0000FFFF0001]
    monkeypatch.setattr(simhash, "PAIRS", 1000)
    keys = np.sort(np.array(near + far, np.uint64))
    both = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), keys.view(np.int64))], ["choice", "key", "i", "j", "side", "fp"])
    made = pa.Table.from_batches(list(simhash._join_units(iter([both]), [()], simhash.split_bits(4), 4)))
    assert made.num_rows < len(keys)
    root = dict(zip(made["a"].to_pylist(), made["b"].to_pylist()))
    top = {root.get(int(np.uint64(k).view(np.int64)), int(np.uint64(k).view(np.int64))) for k in near}
    assert len(top) == 1


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one_of_each(frame(spark, [TEXTS[0], TEXTS[1], "other words stand here now", TEXTS[0], None, ""], [7, 3, 9, 3, 5, 5]), width=5)
    assert kept.columns == ["doc_id", "text", "source", "n_chars"]
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"])
    assert len(rows) == 2 and rows[0][0] == 3 and rows[1] == (9, "other words stand here now") and kept.count() == 3
    again = simhash.keep_one_of_each(frame(spark, ["same text of five words here"] * 3, [1, 1, 1]))
    assert again.count() == 1


def test_every_pair_of_similarity_08_is_linked_and_no_other(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choice(vocab, 60))
    texts = [" ".join(rng.choice(vocab, rng.integers(20, 400))) for _ in range(60)]
    texts += [t + " " + line for t in texts[:20]] + [line] * 2
    for t in texts[:60]:
        for rate in (0.005, 0.01, 0.02, 0.03):
            words = t.split()
            for _ in range(max(1, round(rate * len(words)))):
                at, what = rng.integers(len(words)), rng.integers(3)
                words[at : at + 1] = [["zz"], [words[at], "yy"], []][what]
            texts.append(" ".join(words))
    texts += ["", None, "one two", "One  two", "a b c d e"]
    sets = [set(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in ((t or "").lower().split() for t in texts)]
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    fps = np.array([slow_fingerprint(t, 5) for t in texts], np.uint64)
    far = near & (np.bitwise_count(fps[:, None] ^ fps[None, :]) > 6)
    assert np.triu(far, 1).sum() > 50  # what six bits leave in
    comp = slow_components(near)
    ids = [k * 3 for k in range(len(texts))]
    kept = similar.keep_one_of_similar(frame(spark, texts, ids))
    assert kept.columns == ["doc_id", "text", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({ids[c] for c in comp})
    assert similar.keep_one_of_similar(frame(spark, [])).count() == 0


def slow_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_bitmaps_never_rule_out_what_is_alike():
    rng = np.random.default_rng(12)
    ruled_out = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64)])) for _ in range(2))
        shared = len(np.intersect1d(x, y))
        apart = similar.surely_apart(similar.parity(x), similar.parity(y), len(x), len(y))
        assert not (apart and similar.alike(shared, len(x), len(y)))
        ruled_out += apart
    assert ruled_out > 100
    none = similar.parity(np.zeros(0, np.uint64))
    assert not similar.surely_apart(none, none, 0, 0)


def awkward_texts():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared, long_run = word(260), word(199)
    texts = [
        word(300) + shared + word(50), shared, word(10) + shared[30:230] + word(10), shared[:199], long_run + word(40), word(3) + long_run,
        "x" * 450, "xy" * 120, "", None, "é" * 150, word(900), word(400) + "z" * 205, "z" * 201 + word(9), "z" * 200,
    ]
    texts += [texts[11], texts[11]]
    edited = [word(500)]
    for k in range(6):
        at = int(rng.integers(0, 480))
        edited.append(edited[-1][:at] + "#" * (k % 3) + edited[-1][at + 1 :])
    return texts + edited


def removed(spark, texts, ids=None, length=200):
    got = substrings.substring_removals(frame(spark, texts, ids), length).collect()
    return sorted((tuple(r) for r in got), key=repr)


def expected(texts, ids, length=200):
    return sorted(((i, *r) for i, r in zip(ids, slow_removal(texts, length))), key=repr)


@pytest.mark.parametrize("fan, hot, bundle, chunk", [(256, 20_000, 4 << 20, 1 << 20), (2, 1, 1500, 700), (3, 2, 4000, 1 << 20)])
def test_substrings_against_brute_force(spark, monkeypatch, fan, hot, bundle, chunk):
    """Also with so few parts a block that the exchange has several levels, with seeds that count as hot, and with
    documents longer than a bundle and a chunk."""
    for name, value in (("FAN", fan), ("HOT", hot), ("BUNDLE", bundle), ("CHUNK", chunk)):
        monkeypatch.setattr(substrings, name, value)
    texts = awkward_texts()
    ids = [*range(len(texts) - 1), None]
    assert removed(spark, texts, ids) == expected(texts, ids)
    assert removed(spark, []) == []


def test_strings_of_equal_polynomial_hash_stay(spark):
    """Thue-Morse strings collide under any polynomial hash modulo 2^64; equality goes by bytes here."""

    def thue(n, a, b):
        return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))

    pairs = [(chr(42), chr(64)), (chr(102), chr(89)), (chr(102), chr(75))]
    for flips in range(8):
        x = "".join(thue(64, *(p[::-1] if flips >> k & 1 else p)) for k, p in enumerate(pairs)) + "12345678"
        y = "".join(thue(64, *(p if flips >> k & 1 else p[::-1])) for k, p in enumerate(pairs)) + "12345678"
        texts = [x, y, x[:199], y[:199]]
        assert [r[2] for r in removed(spark, texts)] == [0, 0, 0, 0]
    long = [thue(2048, "a", "b"), thue(2048, "b", "a"), "q" + thue(1024, "a", "b")]
    assert removed(spark, long) == expected(long, range(3))


def test_rows_of_the_exchange_are_in_proportion_to_blocks(spark):
    kind = blocks.counted(0, lambda n: n, np.int64)
    rng = np.random.default_rng(2)
    names = blocks.mix(np.arange(3000, dtype=np.uint64))
    sent = {k: np.unique(rng.choice(names, 400)) for k in range(70)}
    rows = [blocks.asked_rows(kind, (n, np.ones(len(n), np.int64)), 0, k, 0, 4, fan=4) for k, n in sent.items()]
    table = spark.createDataFrame(pa.concat_tables(rows).to_pandas(), blocks.ASKED)
    assert table.count() <= 4 * len(sent)
    total = Counter(x for n in sent.values() for x in n.tolist())
    found = blocks.exchange(table, kind, len(sent), 4).toArrow()
    assert found.num_rows == table.count()
    for k, n in sent.items():
        mine = found.filter(pc.equal(found["src"], k))
        assert blocks.answers_in_order(mine, kind).tolist() == [total[x] for x in n.tolist()]


def test_long_text_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    word = "".join(rng.choice(list("abcdefgh "), 1_500_000))
    passage = "".join(rng.choice(list("ijkl"), 300))
    texts = [word[:1_400_000] + "#" + passage + word[1_400_000:] + "%" + passage[:250], passage[5:] + "m" * 199]
    docs = frame(spark, texts).withColumns({c: F.lit("mine") for c in ("n_bytes", "src", "rows", "payload", "kept_sha256", "c0")})
    got = [tuple(r) for r in substrings.substring_removals(docs, 200).orderBy("doc_id").collect()]
    assert [r[:4] for r in got] == [(0, len(texts[0]), 550, 2), (1, len(texts[1]), 295, 1)]
    assert got[0][4] == hashlib.sha256((word[:1_400_000] + "#" + word[1_400_000:] + "%").encode()).hexdigest()
    kept = substrings.remove_substrings(docs, 200)
    assert kept.columns == docs.columns
    assert {(r["n_bytes"], r["src"]) for r in kept.collect()} == {("mine", "mine")}


def test_suffix_order(monkeypatch):
    rng = np.random.default_rng(1)
    assert sorted({(a - b) % suffixes.COVER for a in suffixes.MARKS.tolist() for b in suffixes.MARKS.tolist()}) == list(range(suffixes.COVER))
    for bucket in (1 << 18, 50):
        monkeypatch.setattr(suffixes, "BUCKET", bucket)
        for trial in range(20):
            letters = int(rng.integers(1, 4))
            texts = [bytes(rng.integers(0, letters, int(rng.integers(0, 400))).astype(np.uint8)) for _ in range(int(rng.integers(0, 8)))]
            texts += [t[int(rng.integers(0, 50)) :] for t in texts[:3]]
            texts += [b"ab" * 100, b"ba" * 120, bytes(300)] if trial % 3 == 0 else []
            got = suffixes.suffix_order(texts)
            want = sorted((t[k:] for t in texts for k in range(max(0, len(t) - 30))))
            assert [texts[n][k:] for n, k in got] == want
            assert len(set(got)) == len(got)


def test_removal_keeps_characters(spark):
    shared = "é" * 120
    got = {r["doc_id"]: r for r in substrings.remove_substrings(frame(spark, ["ab" + shared + "c", "q" + shared, None, "kept"]), 200).collect()}
    assert got[0]["text"] == "abc" and got[0]["n_chars"] == 3 and got[1]["text"] == "q" and got[2]["text"] is None and got[3]["text"] == "kept" and got[3]["source"] == "s"


def slow_embeddings(rows, threshold):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) and i is not None for i, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (i, j))
                near[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    comp = slow_components(near | np.eye(n, dtype=bool))
    low = {c: min((rows[k][0] for k in range(n) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return sorted(((rows[k][0], int(near[k].sum()), low[comp[k]]) for k in range(n)), key=repr)


@pytest.mark.parametrize("part, big", [(embeddings.PART, embeddings.BIG), (3, 4), (embeddings.PART, 10)])
def test_embeddings_against_brute_force(spark, monkeypatch, part, big):
    monkeypatch.setattr(embeddings, "PART", part)
    monkeypatch.setattr(embeddings, "BIG", big)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    near = base[:25] + rng.normal(size=(25, 16)) * 0.06
    rows = [v.tolist() for v in np.concatenate([base, near, base[:10], base[:3] * 2.5])]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e-30] * 16, [1e30] * 16]
    rows = [([None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for v in rows]
    rows = list(enumerate(rows, 100)) + [(100, rows[0]), (None, rows[0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = embeddings.embedding_components(df, 0.95).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == slow_embeddings(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_just_above_the_threshold_of_20000_vectors(spark):
    """Pairs planted at cosine 0.951 among 20,000 vectors, the hardest that count; nothing below 0.95 links."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rest, a = unit(rng.normal(size=(16_000, 64))), unit(rng.normal(size=(2000, 64)))
    off = rng.normal(size=a.shape)
    off = unit(off - (off * a).sum(axis=1, keepdims=True) * a)
    x = np.concatenate([rest, a, 0.951 * a + np.sqrt(1 - 0.951**2) * off]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}))
    links = embeddings.embedding_components(df, 0.95).toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    want = np.zeros(20_000, np.int64)
    wide = unit(x.astype(np.float64))
    for at in range(0, 20_000, 2000):
        want[at : at + 2000] = (wide[at : at + 2000] @ wide.T >= 0.95).sum(axis=1) - 1
    assert want.sum() >= 4000 and (links <= want).all() and links.sum() >= 0.98 * want.sum()


def test_no_embeddings(spark):
    assert embeddings.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_seeds_are_chosen_once_for_the_pieces(monkeypatch, hot):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh "), 3000)) for _ in range(20)]
    texts = [t + texts[k // 2][:900] for k, t in enumerate(texts)]
    bundle = blocks.pack_rows(pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(20))], ["text", "c0"]), np.zeros(20, np.int64), 1)
    seeds, n = substrings._seed_counts(bundle, 200, 4096)
    answer = (n > 1).astype(np.uint8)
    if hot:
        answer[np.flatnonzero(n > 1)[:1]] = 2
    found = pa.table({"bucket": [0], "answer": pa.array([blocks.frame(len(n), blocks.put_numbers(answer))], pa.binary())})
    made, chunk = [], substrings._Chunk
    monkeypatch.setattr(substrings, "_Chunk", lambda *a: made.append(a[0]) or chunk(*a))
    pieces, places = substrings._pieces(bundle, found, 200, 4096)
    assert len(made) <= len(set(made)) * (1 + hot) and len(set(made)) > 10
    whole = "".join(texts).encode()
    assert all(whole[p : p + len(t)] == t for t, at in zip(pieces.texts, places) for p in at)
    covered = {p + k for t, at in zip(pieces.texts, places) for p in at for k in range(len(t) - 199)}
    starts = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    base = np.cumsum([0, *map(len, texts)])
    assert all(int(b) + k in covered for b, t in zip(base, texts) for k in range(len(t) - 199) if starts[t[k : k + 200]] > 1)


def one_bundle(texts):
    """A bundle of texts, and what the corpus, which is it alone, answers about its seeds."""
    table = blocks.pack_rows(pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "c0"]), np.zeros(len(texts), np.int64), 1)
    _, n = substrings._seed_counts(table, 200, substrings.CHUNK)
    return table, pa.table({"bucket": [0], "answer": pa.array([blocks.frame(len(n), blocks.put_numbers((n > 1).astype(np.uint8)))], pa.binary())})


def test_places_of_one_repeated_character_take_little_memory():
    """Each byte of such a text is a place of the same piece: 44 bytes of Python memory a place once, beside what cutting takes."""
    size = 1 << 20
    table, found = one_bundle(["x" * size])
    tracemalloc.start()
    try:
        pieces, places = substrings._pieces(table, found, 200, substrings.CHUNK)
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert pieces.counts.tolist() == [size - 199] and list(places[0]) == list(range(size - 199))
    assert held < 16 * size


@pytest.mark.parametrize("marked", [1, 7, 1 << 17])
def test_bytes_covered_are_marked_in_slices(monkeypatch, marked):
    monkeypatch.setattr(substrings, "MARKED", marked)
    texts = [t for t in awkward_texts() if t]
    table, found = one_bundle(texts)
    pieces, places = substrings._pieces(table, found, 200, substrings.CHUNK)
    kind = substrings._piece_kind(200)
    rows = blocks.asked_rows(kind, pieces, 0, 0, 0, 4, lambda a, b: substrings._own_places(places[a:b]))
    answers = []
    for data in rows["data"].to_pylist():
        things = kind.merge([data])
        answers.append(kind.pick(things, kind.solve(things), data))
    gone = substrings._covered(int(table["size"][0].as_py()), rows["own"].to_pylist(), answers, 200)
    starts = Counter(b[k : k + 200] for b in map(str.encode, texts) for k in range(len(b) - 199))
    want = []
    for b in map(str.encode, texts):
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            mask[k : k + 200] |= starts[b[k : k + 200]] > 1
        want.append(mask)
    assert gone.any() and (gone == np.concatenate(want)).all()
