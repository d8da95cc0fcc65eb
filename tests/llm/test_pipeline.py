import numpy as np

import corpus_pipeline
from umbra.llm.common import stage_table


def test_stages_in_turn(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    item, passage = word(30), word(60)
    texts = [word(80), word(90), "12345 !!!", None, word(40) + " " + item + " " + word(10), word(30) + " " + passage, passage + " " + word(30)]
    texts += [texts[0], texts[0] + " ", texts[1]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_substrings", "decontaminate", "pack"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage_table(stage(spark, docs, str(tmp_path)), name)
        if name != "pack":
            assert out.columns == docs.columns
            kept.append(sorted(r["doc_id"] for r in out.collect()))
        docs = out
    assert kept == [[0, 1, 4, 5, 6, 7, 8, 9], [0, 1, 4, 5, 6], [0, 1, 4, 5, 6], [0, 1, 5, 6]]
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, 5, 6}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, fingerprint string, src long"


def piped(spark, rows, folder, bench=()):
    """What run() gives for documents of these (doc_id, text), with columns of clashing names."""
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None, None, "own", "own", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_no_documents_and_nothing_that_stays(spark, tmp_path):
    none = piped(spark, [], tmp_path / "a")
    assert none.count() == 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(none.columns)
    assert piped(spark, [(1, None), (2, ""), (3, "1 2 3")], tmp_path / "b", [(1, None), (None, "x")]).count() == 0


def test_repeated_rows_ties_and_null_ids(spark, tmp_path):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    a, b, c, long = word(50), word(50), word(3), word(12_000)
    rows = [(5, a), (5, a), (5, a), (4, b), (4, b + " "), (None, a), (None, c), (7, c), (8, long), (9, "é" * 30), (10, word(6))]
    got = sorted((r["doc_id"], r["piece"]) for r in piped(spark, rows, tmp_path, [(1, "none of these words")]).collect())
    pieces = [x for x in got if x[0] == 8]
    assert len(pieces) > 2 and [x for x in got if x[0] != 8] == [(4, 0), (5, 0), (7, 0), (9, 0), (10, 0)]
