import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.operators import converters, images, pictures
from umbra.operators.providers import accept_json, boxes_from_json, check_options, detector, join_parts, new_separator, strict_boxes, text_prompt


def test_png_round_trip():
    pixels = np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(pixels)) == pixels).all()
    with pytest.raises(ValueError):
        images.decode_png(b"nothing")


def test_blackout_margin_and_edges():
    white = np.full((100, 100, 3), 255, np.uint8)
    black = (images.black_out(white, [(10, 10, 20, 20)], 0.10) == 0).all(axis=2)
    want = np.zeros((100, 100), bool)
    want[9:22, 9:22] = True
    assert (black == want).all()
    edge = (images.black_out(white, [(300, 300, 400, 400)], 0.25) == 0).all(axis=2)
    assert edge[99, 99] and edge.sum() == 1


def pictures_of(spark, *rows):
    return spark.createDataFrame([(n, 0, mime, None, None, bytearray(data), None, boxes) for n, mime, data, boxes in rows], f"{pictures.PICTURES}, boxes array<{images.BOX}>")


def test_blackout_of_files(spark):
    png = images.encode_png(np.full((30, 30, 3), 255, np.uint8))
    rows = [("a.png", "image/png", png, [(1.0, 1.0, 5.0, 5.0, "w")]), ("b.jpg", "image/jpeg", b"x", []), ("c.png", "image/png", b"x", None)]
    rows += [(f"cut{n}", "image/png", png[:n], None) for n in (8, 12, 20, 40, len(png) - 20)]
    got = {r["relative_path"]: r for r in pictures.paint(pictures_of(spark, *rows), converters.installed(), 0.1).collect()}
    assert got["a.png"]["error"] is None and images.decode_png(bytes(got["a.png"]["content"]))[2, 2].sum() == 0
    assert "no codec" in got["b.jpg"]["error"]
    assert all(got[n]["content"] is None and got[n]["error"] for n in ("c.png", "cut8", "cut12", "cut20", "cut40"))


def test_fit():
    assert converters.fit(np.full((2048, 512, 3), 7, np.uint8)).shape == (1024, 256, 3)
    assert converters.fit(np.full((10, 20, 3), 9, np.uint8)).shape == (512, 1024, 3)
    same = np.random.default_rng(0).integers(0, 256, (1024, 3, 3)).astype(np.uint8)
    assert converters.fit(same) is same
    flat = converters.fit(np.full((100, 100, 3), 200, np.uint8), 30)
    assert flat.shape == (30, 30, 3) and (flat == 200).all()
    ramp = converters.fit(np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 3, 2).repeat(100, 0), 50)
    assert (np.diff(ramp[:, :, 0].astype(int), axis=1) >= 0).all() and abs(int(ramp[0, 25, 0]) - 101) < 3


def words(spark, said, drop_last=False):
    chars = spark.createDataFrame([(1, 0, k, c, float(k), 0.0, k + 0.5, 1.0) for k, c in enumerate(said)], "page int, line int, pos int, char string, x1 double, y1 double, x2 double, y2 double")
    return [r["text"] for r in images.ocr_words(chars, drop_last=drop_last).orderBy("word").collect()]


def test_ocr_words(spark):
    assert words(spark, "ab cd") == ["ab", "cd"]
    assert words(spark, "ab cd", drop_last=True) == ["ab"]
    assert words(spark, "ab  cd e") == ["ab", " cd", "e"]
    assert words(spark, " a b") == [" a", "b"]


def test_gone_words_of_long_pages(spark):
    """All of 30,000 words gone, and a few of them: a look-up a pair of words would take far longer."""
    said = [f"w{k % 20_000}" for k in range(30_000)]
    pages = spark.createDataFrame([(1, " ".join(said), "nothing stays"), (2, " ".join(said), " ".join(w for w in said if w not in ("w7", "w19999"))), (3, "a b a", "a b a"), (4, "é a é", "a"), (5, "a", None)], "page int, said string, redacted string").repartition(1)
    zero = F.lit(0).cast("float")
    boxes = F.transform(F.split("said", " "), lambda w: F.struct(*[zero.alias(c) for c in ("x1", "y1", "x2", "y2")], w.alias("text")))
    began = time.monotonic()
    got = {r[0]: r[1] for r in pages.select("page", images.gone_words(boxes, F.col("redacted"))["text"]).collect()}
    assert got == {1: said, 2: [w for w in said if w in ("w7", "w19999")], 3: [], 4: ["é", "é"], 5: []}
    assert time.monotonic() - began < 60


def test_gone_words(spark):
    rows = [([(0.0, 0.0, 1.0, 1.0, w) for w in ("call", "John", "now")] + [(0.0, 0.0, 1.0, 1.0, None)],)]
    df = spark.createDataFrame(rows, f"b array<{images.BOX}>")
    assert [b["text"] for b in df.select(images.gone_words(F.col("b"), F.lit("call [REDACTED] now"))).first()[0]] == ["John"]
    assert df.select(images.ocr_text(F.col("b"))).first()[0] == "call John now"


def test_remote_contracts(spark):
    assert accept_json(200, "application/json", "[1]") == [1]
    for bad in ((500, "application/json"), (200, "application/json; charset=utf-8")):
        with pytest.raises(ValueError):
            accept_json(*bad, "{}")
    got = spark.createDataFrame([('[{"x1":1,"y1":2,"x2":3,"y2":4}]',), ('[{"x1":1,"y1":2,"x2":3}]',)], "a string").select(boxes_from_json(F.col("a")).alias("b")).collect()
    assert got[0]["b"][0]["y2"] == 4.0 and got[1]["b"] is None
    assert "---7" in text_prompt("hi", "---7")
    with pytest.raises(ValueError):
        text_prompt("a ---7", "---7")
    assert new_separator("x").startswith("---")
    assert strict_boxes('[{"x1":1,"y1":2.5,"x2":3,"y2":4,"text":"w"}]') == [(1, 2.5, 3, 4)] and strict_boxes("[]") == []
    for bad in ("{}", '[{"x1":1}]', '[{"x1":true,"y1":2,"x2":3,"y2":4}]', "[1]", "no"):
        with pytest.raises(ValueError):
            strict_boxes(bad)
    text, error = join_parts(F.col("p"))
    parts = spark.createDataFrame([(["a", None, "b"],), ([None],), (None,)], "p array<string>").select(text, error).collect()
    assert [tuple(r) for r in parts] == [("ab", None), (None, "the answer holds no text"), (None, "the answer holds no text")]
    with pytest.raises(ValueError):
        detector("gcp-dlp")
    with pytest.raises(ValueError):
        check_options("ms-presidio", {})
