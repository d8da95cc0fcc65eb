import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from umbra.llm import contamination, langid, ngram_lm, tokens

DOCS = "doc_id long, text string, lang string, edits string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, ids=None, lang="en"):
    return spark.createDataFrame([(k if ids is None else ids[k], t, lang, "clash") for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def encoders():
    return tokens.Encoder(WORD_BPE), tokens.Encoder(WORD_BPE, word_path=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "don't", "A<|startoftext|>b", "Σ", "ΑΣ ", "é", "K", "\x1c", "\x85", " ", "\x0b", "½", "İ"])), max_size=6))
def test_word_path_equals_the_library(encoders, parts):
    text = pa.array(["".join(parts), None, ""])
    fast, slow = (list(e.ids(text)) for e in encoders)
    assert [x.tolist() for x in fast] == [x.tolist() for x in slow]
    assert encoders[0].counts(text).tolist() == [len(x) for x in slow]


def test_counts_and_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    texts = ["Hello there", None, "", "Hello there", "x " * 5000, "É<|endoftext|>é"]
    want = [(k, len((t or "").encode()), len(tokens.Encoder(WORD_BPE, False)._library([t or ""])[0])) for k, t in enumerate(texts)]
    for docs in (texts[:3], texts, texts):
        got = tokens.count_tokens(frame(spark, docs), WORD_BPE, cache).orderBy("doc_id").collect()
        assert [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got] == want[: len(docs)]
        assert [r["over_limit"] for r in got] == [n > 2048 for _, _, n in want[: len(docs)]]
    stored = spark.read.option("recursiveFileLookup", "true").parquet(cache)
    assert len(os.listdir(cache)) == 3 and all(n.startswith("run-") for n in os.listdir(cache))
    assert stored.count() == stored.select("digest").distinct().count() == 4
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert not tokens.word_wise(model) and not tokens.word_wise(public_tokenizers.path("byte_bpe_50k.json"))
    other = tokens.count_tokens(frame(spark, texts[:1]), model, cache).first()
    assert other["n_tokens"] == len(tokens.Encoder(model)._library(["Hello there"])[0])
    assert tokens.count_tokens(frame(spark, []), WORD_BPE).count() == 0


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    enc, lib = tokens.Encoder(WORD_BPE), tokens.Encoder(WORD_BPE, False)
    for k in range(8):
        text = pa.array([" ".join(f"w{k * 30 + j} the of" for j in range(40))])
        assert [x.tolist() for x in enc.ids(text)] == [x.tolist() for x in lib.ids(text)]
    assert len(enc.memo) < 150


def slow_scores(texts, alpha, least):
    lists = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for t in texts]
    c = [Counter(tuple(w[k : k + n]) for w in lists for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, out = sum(c[0].values()), []
    for w in lists:
        lines, s = [0, 0, 0], 0.0
        for k in range(len(w)):
            g = [tuple(w[k - n : k + 1]) if k >= n else None for n in range(3)]
            if g[2] and c[2][g[2]] >= least:
                lines[0] += 1
                s += math.log(c[2][g[2]] / c[1][g[2][:2]])
            elif g[1] and c[1][g[1]] >= least:
                lines[1] += 1
                s += math.log(c[1][g[1]] / c[0][g[1][:1]]) + (math.log(alpha) if k > 1 else 0)
            else:
                lines[2] += 1
                s += math.log(c[0][g[0]] / total) + min(k, 2) * math.log(alpha)
        out.append((len(w), *lines, s))
    return out


def test_lm_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 60))) for _ in range(30)] + ["", None, " \t", "a", "a b", "A\x0bB c", "é é", "a b " * 4000]
    ids = [*range(len(texts) - 1), None]
    got = {r["doc_id"]: r for r in ngram_lm.lm_scores(frame(spark, texts, ids)).collect()}
    for i, (n, t, b, u, s) in zip(ids, slow_scores(texts, 0.4, 2)):
        r = got[i]
        assert (r["n_words"], r["n_trigram"], r["n_bigram"], r["n_unigram"]) == (n, t, b, u)
        assert r["log_score"] == pytest.approx(s, rel=1e-9, abs=1e-9) and (r["mean_log_score"] is None if n == 0 else r["mean_log_score"] == pytest.approx(s / n))
    assert ngram_lm.lm_scores(frame(spark, [])).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (60, 9)), rng.integers(0, 4, (60, 9))
    assert contamination.edit_distances(a, b).tolist() == [edit(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_decontamination_recall_against_brute_force():
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, rng.choice(vocab, rng.integers(8, 40)).tolist()) for k in range(80)]
    searcher = contamination.Searcher(items, 0.8, 5)
    texts = []
    for _, words in items:
        w = list(words)
        for _ in range(rng.integers(0, len(w) // 5 + 1)):
            at, what = rng.integers(len(w)), rng.integers(3)
            w[at : at + 1] = [["zz"], [w[at], "yy"], []][what]
        texts.append([*rng.choice(vocab, 25), *w, *rng.choice(vocab, 25)])
    found = {(r, i): d for r, i, d, _, _ in searcher.search(pa.array([" ".join(t) for t in texts]))}
    want = {}
    for r, t in enumerate(texts):
        for i, w in items:
            best = min((edit(t[k : k + len(w)], w) for k in range(len(t) - len(w) + 1)) if i == r else [99], default=99)
            if best <= int(0.2 * len(w) + 1e-9):
                want[r, i] = best
    assert len(want) > 60 and len(want.keys() & found.keys()) >= 0.95 * len(want)
    assert all(found[k] >= want[k] for k in want if k in found)


def edit_within(item, text):
    """Least edit distance of item from any run of words of text."""
    row = [0] * (len(text) + 1)
    for k, x in enumerate(item, 1):
        new = [k]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_passage_distance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (60, 14)), rng.integers(0, 4, (60, 9))
    want = [edit_within(y, x) for x, y in zip(a.tolist(), b.tolist())]
    assert contamination.passage_distances(a, b).tolist() == want
    for x, y, d in zip(a, b, want):
        edits, first, words = contamination.passage(x, y)
        assert edits == d == edit(x[first : first + words].tolist(), y.tolist())


@pytest.mark.parametrize("what", ["insert", "delete", "mixed"])
@pytest.mark.parametrize("around", [0, 25])
def test_decontamination_finds_passages_longer_or_shorter_than_the_item(what, around):
    rng = np.random.default_rng(6)
    vocab = [f"w{k}" for k in range(2000)]
    items = [(k, rng.choice(vocab, m).tolist()) for k, m in enumerate([20] * 40 + [40] * 40)]
    searcher = contamination.Searcher(items, 0.8, 5)
    texts = []
    for _, words in items:
        w = list(words)
        for _ in range(len(words) // 5):
            at, how = rng.integers(1, len(w) - 1), what if what != "mixed" else ["insert", "delete", "change"][rng.integers(3)]
            w[at : at + 1] = {"insert": [w[at], "yy"], "delete": [], "change": ["zz"]}[how]
        texts.append([*rng.choice(vocab, around), *w, *rng.choice(vocab, around)])
    want = {(r, r) for r, (_, w) in enumerate(items) if edit_within(w, texts[r]) <= len(w) // 5}
    got = searcher.search(pa.array([" ".join(t) for t in texts]))
    assert len(want) == len(items) and {(r, i) for r, i, *_ in got} <= want
    assert all(edit(texts[r][f : f + n], items[i][1]) == d <= len(items[i][1]) // 5 for r, i, d, f, n in got)
    assert len(got) >= 0.95 * len(want), len(got) / len(want)


@pytest.mark.parametrize("m", [1, 2, 4, 150, 300])
def test_decontamination_of_very_short_and_long_items(m):
    """Short items are found word for word, long ones at their full budget of edits."""
    rng = np.random.default_rng(m)
    vocab = [f"w{k}" for k in range(4000)]
    items = [(k, rng.choice(vocab, m, replace=False).tolist()) for k in range(30)]
    texts = []
    for _, words in items:
        w = list(words)
        for at in rng.choice(m, int(0.2 * m + 1e-9), replace=False):
            w[at] = "zz"
        texts.append([*["aa"] * 30, *w, *["bb"] * 30])
    found = {(r, i): d for r, i, d, _, _ in contamination.Searcher(items, 0.8).search(pa.array([" ".join(t) for t in texts]))}
    assert sum((k, k) in found for k in range(30)) >= 29
    for (r, i), d in found.items():
        assert edit_within(items[i][1], texts[r]) <= d <= int(0.2 * m + 1e-9)


def test_decontamination_cases(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item, 0), (2, "tiny one", 0), (3, None, 0), (None, item, 0), (4, item.upper(), 0), (5, "", 0)], "item_id long, text string, doc_id int")
    texts = [f"some words, {item}. and more", item, item.replace("gamma", "x"), "alpha beta gamma", None, "", "tiny one", ("filler " * 20000) + item, "alpha beta x y z epsilon zeta w v u"]
    for size in (contamination.PASS_ITEMS, 2):
        monkeypatch.setattr(contamination, "PASS_ITEMS", size)
        got = sorted((r["doc_id"], r["item_id"], r["edits"], r["first_word"]) for r in contamination.contaminated(frame(spark, texts), bench, min_words=5).collect())
        assert got == [(d, i, e, f) for d, e, f in ((0, 0, 2), (1, 0, 0), (2, 1, 0), (7, 0, 20000)) for i in (1, 4)]
        assert sorted(r["doc_id"] for r in contamination.drop_contaminated(frame(spark, texts), bench, min_words=5).collect()) == [3, 4, 5, 6, 8]
        short = contamination.contaminated(frame(spark, texts), bench).filter("item_id = 2").collect()
        assert [tuple(r) for r in short] == [(6, 2, 0, 0, 2)]
        assert sorted(r["doc_id"] for r in contamination.drop_contaminated(frame(spark, texts), bench).collect()) == [3, 4, 5, 8]
    assert contamination.contaminated(frame(spark, []), bench).count() == 0 and contamination.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_gradients_by_differences():
    net = langid.Network(["a", "b", "c"], hidden=3, dtype=np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (5, 4)), rng.integers(0, 3, 4)
    _, grads = net.gradients(x, y)
    for name, p in net.params.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape) if not name.startswith("x") else (int(rng.choice(x.ravel())), int(rng.integers(0, p.shape[1])))
            old = p[at]
            p[at] = old + 1e-6
            up = net.gradients(x, y)[0]
            p[at] = old - 1e-6
            down = net.gradients(x, y)[0]
            p[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8), name


def test_language_cases_and_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.fit(docs, documents=100, windows=500, epochs=6)
    found = langid.predict_languages(docs, net).withColumn("held", langid.held_out(F.col("doc_id"))).filter("held and lang is not null")
    rows = found.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 20
    texts = [None, "", "123 !!! ...", "é", "the " * 50000, "x" * 5000, "the and of with"]
    got = langid.predict_languages(frame(spark, texts), net).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, False, False, False] and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == 0
    own = frame(spark, texts, lang=None).withColumns({"lang_pred": F.lit("mine"), "score": F.lit(7)})
    kept = langid.keep_known_languages(own, net)
    assert kept.columns == own.columns and {(r["lang_pred"], r["score"], r["lang"] is None) for r in kept.collect()} == {("mine", 7, False)} and kept.count() == 4
    assert langid.keep_known_languages(frame(spark, texts), net, margin=1.0).count() == 0
    nothing = langid.fit(frame(spark, ["a b"], lang=None))
    assert langid.predict_languages(frame(spark, ["a b"]), nothing).first()["lang_pred"] == "und"
    assert [r["text"] for r in langid.keep_known_languages(frame(spark, ["a b", "1", None]), nothing).collect()] == ["a b"]
    assert langid.predict_languages(frame(spark, []), net).count() == 0


def test_windows_are_read_across_words_and_pooled():
    net = langid.Network(["a", "b", "c"], seed=3)
    texts = ["Ab c\n" * 30, None, "é" * 100, "x", ""]
    langs, scores = langid.predict(net, pa.array(texts))

    def read(window):
        x = np.frombuffer(window.ljust(langid.WINDOW), np.uint8)[:, None]
        states = np.concatenate([net._pass(x, "f", False)[0], net._pass(x, "b", False)[0]], axis=2)
        return net._softmax(states @ net.params["w"] + net.params["c"])[: len(window), 0]

    for text, lang, score in zip(texts, langs, scores):
        raw = (text or "").encode().lower().replace(b"\n", b" ")
        if not raw:
            assert (lang, score) == ("und", 0)
            continue
        p = np.concatenate([read(raw[k : k + langid.WINDOW]) for k in range(0, len(raw), langid.WINDOW)]).mean(axis=0)
        assert lang == net.langs[p.argmax()] and score == pytest.approx(p.max(), abs=1e-5)


def test_plain_words_are_cut_here_and_equal_the_library(monkeypatch):
    enc, lib = tokens.Encoder(WORD_BPE), tokens.Encoder(WORD_BPE, False)
    latin = [chr(c) for c in range(0xC0, 0x180) if tokens._PLAIN.fullmatch(chr(c))]
    ascii_ = [chr(c) for c in range(0x21, 0x7F)]
    words = [f"{a}x{a}'s{a}{b}" for a in latin for b in "é9'!"] + [f"{a}{b}'re{a}'lle" for a in ascii_ for b in ascii_] + ["''s", "'s's", "!'s", "9's", "ŉa", "İb", "ǆ", "éa", "ſ", "a b", "½x", "日本's"]
    went: list[str] = []
    whole = enc._library
    monkeypatch.setattr(enc, "_library", lambda texts: went.extend(texts) or whole(texts))
    text = pa.array([" ".join(words[k : k + 50]) for k in range(0, len(words), 50)])
    assert [x.tolist() for x in enc.ids(text)] == [x.tolist() for x in lib.ids(text)]
    assert all(not tokens._PLAIN.fullmatch(w) for w in went) and 6 <= len(went) <= 20


@pytest.mark.parametrize("run", [1, 7])
def test_ids_are_put_together_some_words_at_a_time(monkeypatch, run):
    monkeypatch.setattr(tokens, "RUN_WORDS", run)
    text = pa.array(["", "a b c d e f g h i j", None, "k", " ", "<|endoftext|> l", "m n o p", "q r s"])
    assert [x.tolist() for x in tokens.Encoder(WORD_BPE).ids(text)] == [x.tolist() for x in tokens.Encoder(WORD_BPE, False).ids(text)]


def test_an_encoder_at_rest_holds_no_words():
    enc, lib = tokens.Encoder(WORD_BPE), tokens.Encoder(WORD_BPE, False)
    text = pa.array([" ".join(f"w{k} the" for k in range(20_000))])
    for _ in range(2):
        assert [x.tolist() for x in enc.ids(text)] == [x.tolist() for x in lib.ids(text)]
        assert len(enc.memo) > 20_000
        enc.rest()
        assert len(enc.memo) == 1 and max(len(x) for x in (enc.flat, enc.starts, enc.lens, enc.met)) <= 1 << 16
