"""Images and PDF pages through a plan: recognised, redacted, blacked out and put together again.

A row is a picture: PICTURES, page 0 for an image file, and whatever other columns it came with, which are carried
along. What fails becomes the row's error; nothing is swallowed, and no failure ends a job. Only the pages of a
document are shuffled, to be put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.operators.converters import Converters, Page
from umbra.operators.images import BOX, MARGINS, black_out, gone_words, ocr_text

PICTURES = "relative_path string, page int, media_type string, width double, height double, content binary, error string"
_NAMES = [c.split()[0] for c in PICTURES.split(", ")]
_PNG = "image/png"


def _rows(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns))


def _with(df: DataFrame, extra: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(extra).fields])


def split_pages(files: DataFrame, converters: Converters) -> DataFrame:
    """PICTURES of PDF files (relative_path, content, others): their pages as PNG, in order. A file that can't be
    rendered is one row with its error; a page at a time is sent on."""
    split, encode = converters.split_pdf, converters.codecs[_PNG][1]
    others = files.drop("content")

    def run(batches):
        for batch in batches:
            for row, content in enumerate(batch.column("content").to_pylist()):
                try:
                    pages = [(k, _PNG, p.width, p.height, encode(p.pixels), None) for k, p in enumerate(split(content or b""))]
                except Exception as e:
                    pages = [(0, _PNG, None, None, None, f"not rendered: {e}")]
                for page in pages:
                    made = [pa.array([x], t) for x, t in zip(page, (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.string()))]
                    kept = [n for n in batch.schema.names if n != "content"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(row, 1) for n in kept), *made], [*kept, *_NAMES[1:]])

    pages = files.select(*others.columns, "content").mapInArrow(run, _with(others, PICTURES.split(", ", 1)[1]))
    return pages.select(*_NAMES, *[c for c in others.columns if c != "relative_path"])


def as_pictures(files: DataFrame, *others: str) -> DataFrame:
    """PICTURES of image files (relative_path, effective_media_type, content), with others."""
    none = F.lit(None)
    return files.select("relative_path", F.lit(0).alias("page"), F.col("effective_media_type").alias("media_type"), none.cast("double").alias("width"), none.cast("double").alias("height"), "content", none.cast("string").alias("error"), *others)


def merge_pages(pictures: DataFrame, converters: Converters) -> DataFrame:
    """relative_path, content, error and others of documents put together from their pages in order. A page without
    content and error is one that a provider answered without an image: it is left out. Any page's error is the file's."""
    decode, merge = converters.codecs[_PNG][0], converters.merge_pdf
    others = [c for c in pictures.columns if c not in _NAMES]
    rows = pictures.groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("page", "width", "height", "content", "error"))).alias("pages"), *[F.first(c).alias(c) for c in others])

    def run(batches):
        for batch in batches:
            out, errors = [], []
            for pages in batch.column("pages").to_pylist():
                bad = [r["error"] for r in pages if r["error"] is not None]
                try:
                    if bad:
                        raise ValueError(bad[0])
                    out.append(merge([Page(decode(r["content"]), r["width"], r["height"]) for r in pages if r["content"] is not None]))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(str(e))
            kept = [n for n in batch.schema.names if n != "pages"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [*kept, "content", "error"])

    return rows.mapInArrow(run, _with(rows.drop("pages"), "content binary, error string"))


def recognise(pictures: DataFrame, converters: Converters) -> DataFrame:
    """Pictures with words, an array of BOX; unknown image types are an error."""
    codecs, ocr = converters.codecs, converters.ocr
    box = pa.list_(pa.struct([(c, pa.float32()) for c in ("x1", "y1", "x2", "y2")] + [("text", pa.string())]))

    def run(batches):
        for batch in batches:
            found, errors = [], batch.column("error").to_pylist()
            for k, (mime, content) in enumerate(_rows(batch, ("media_type", "content"))):
                try:
                    if errors[k] is not None:
                        raise ValueError(errors[k])
                    if mime not in codecs:
                        raise ValueError(f"no codec for {mime}")
                    found.append([dict(zip(("x1", "y1", "x2", "y2", "text"), w)) for w in ocr(codecs[mime][0](content))])
                except Exception as e:
                    found.append(None)
                    errors[k] = str(e)
            columns = [pa.array(errors, pa.string()) if c == "error" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, box)], [*batch.schema.names, "words"])

    return pictures.mapInArrow(run, _with(pictures, f"words array<{BOX}>"))


def paint(pictures: DataFrame, converters: Converters, factor: float) -> DataFrame:
    """Pictures with their boxes (array of BOX, a column that goes) blacked out, encoded as they were."""
    codecs = converters.codecs

    def run(batches):
        for batch in batches:
            out, errors = batch.column("content").to_pylist(), batch.column("error").to_pylist()
            for k, (mime, boxes) in enumerate(_rows(batch, ("media_type", "boxes"))):
                try:
                    if errors[k] is not None:
                        raise ValueError(errors[k])
                    if mime not in codecs:
                        raise ValueError(f"no codec for {mime}")
                    decode, encode = codecs[mime]
                    out[k] = encode(black_out(decode(out[k]), [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes or []], factor))
                except Exception as e:
                    out[k], errors[k] = None, str(e)
            made = {"content": pa.array(out, pa.binary()), "error": pa.array(errors, pa.string())}
            kept = [n for n in batch.schema.names if n != "boxes"]
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in kept], kept)

    return pictures.mapInArrow(run, pictures.drop("boxes").schema)


def redact_by_text(pictures: DataFrame, detectors: Sequence, converters: Converters) -> DataFrame:
    """Recognised words are redacted as one text by each detector in turn; words that are gone are blacked out."""
    seen = recognise(pictures, converters).withColumn("_text", ocr_text(F.col("words")))
    for d in detectors:
        seen = d.redact(seen, "_text")
    boxes = F.when(F.col("_text").isNotNull(), gone_words(F.col("words"), F.col("_text")))
    return paint(seen.withColumn("boxes", boxes).drop("words", "_text"), converters, MARGINS["ocr"])


def redact_by_image(pictures: DataFrame, detectors: Sequence, converters: Converters) -> DataFrame:
    """Each detector's own work on images, one after another."""
    for d in detectors:
        pictures = d.redact_pictures(pictures, converters)
    return pictures
