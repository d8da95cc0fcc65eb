"""Box blackout, OCR words and OCR difference. Images are PNG, coded with zlib; other codecs, OCR engines and
PDF renderers are plug-ins (operators/converters.py)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.detect import let

BOX = "struct<x1:float,y1:float,x2:float,y2:float,text:string>"
#: Margin by which a box grows, as a share of its coordinates.
MARGINS = {"open-ai-llm": 0.25, "gemini-llm": 0.25, "gcp-vertex-ai": 0.20, "ocr": 0.10}
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of an 8-bit grey, RGB or alpha PNG without interlace; alpha is dropped.
    Anything else, cut or broken data too, is a ValueError."""
    try:
        return _decode_png(data)
    except (struct.error, TypeError, IndexError, zlib.error) as e:
        raise ValueError(f"broken PNG: {e}") from e


def _decode_png(data: bytes) -> np.ndarray:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or color not in _CHANNELS or interlace:
        raise ValueError("only 8-bit grey or colour PNG without interlace or palette")
    n = _CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * n + 1)
    out = np.zeros((height, width * n), np.int32)
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int32), out[y - 1] if y else np.zeros(width * n, np.int32)
        if kind in (0, 2):
            out[y] = (line + (up if kind else 0)) & 255
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(width, n), axis=0) & 255).ravel()
        else:
            row = out[y]
            for k in range(width * n):
                left = row[k - n] if k >= n else 0
                if kind == 3:
                    row[k] = (line[k] + (left + up[k]) // 2) & 255
                else:
                    corner = up[k - n] if k >= n else 0
                    p = left + up[k] - corner
                    pick = min((abs(p - left), 0, left), (abs(p - up[k]), 1, up[k]), (abs(p - corner), 2, corner))[2]
                    row[k] = (line[k] + pick) & 255
    pixels = out.astype(np.uint8).reshape(height, width, n)
    return pixels[:, :, :3] if n >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def pixel_range(low: Column, high: Column, factor: float) -> tuple[Column, Column]:
    """Half-open pixel range of one side of a box, in FLOAT arithmetic; below 0 is 0."""
    f = F.lit(factor).cast("float")
    cut = lambda c: F.greatest(c, F.lit(0).cast("float")).cast("int")
    low, high = low.cast("float"), high.cast("float")
    return cut((low - (low * f).cast("float")).cast("float")), cut((high + (high * f).cast("float")).cast("float"))


def black_out(pixels: np.ndarray, boxes: Sequence[Sequence[float]], factor: float) -> np.ndarray:
    """Boxes (x1, y1, x2, y2) painted black. A range beyond the image paints its last column or row."""
    out = pixels.copy()
    height, width, _ = out.shape
    f = np.float32(factor)
    for box in boxes:
        x1, y1, x2, y2 = (np.float32(v) for v in box[:4])
        span = [int(max(0, v)) for v in (x1 - x1 * f, x2 + x2 * f, y1 - y1 * f, y2 + y2 * f)]
        if span[1] > span[0] and span[3] > span[2]:
            xs, ys = slice(min(span[0], width - 1), min(span[1], width)), slice(min(span[2], height - 1), min(span[3], height))
            out[ys, xs] = 0
    return out


def ocr_words(chars: DataFrame, page: Sequence[str] = ("page",), drop_last: bool = False) -> DataFrame:
    """Words of recognised characters: page columns, line, pos, char, x1, y1, x2, y2 -> line, word, text and box.

    Within a line, characters are joined until a blank; the last word of a line is emitted too unless drop_last.
    A blank where a word should begin becomes the word's first character.
    """
    line = Window.partitionBy(*page, "line").orderBy("pos")
    # a blank ends a word only if one is open: of a run of blanks every second one does
    blank = F.col("char") == " "
    runs = chars.withColumn("_blank", blank).withColumn("_g", F.sum((~blank).cast("int")).over(line))
    nth = Window.partitionBy(*page, "line", "_g", "_blank").orderBy("pos")
    first = Window.partitionBy(*page, "line")
    runs = runs.withColumn("_n", F.row_number().over(nth)).withColumn("_open", F.when(F.col("_g") > 0, 1).otherwise(0))
    ends = F.col("_blank") & (F.pmod(F.col("_n") + F.col("_open"), F.lit(2)) == 0)
    marked = runs.withColumn("_end", ends).withColumn("_word", F.coalesce(F.sum(F.col("_end").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marked = marked.withColumn("_last", F.max(F.when(F.col("_end"), F.col("_word"))).over(first))
    words = marked.filter(~F.col("_end") & ((F.col("_word") <= F.col("_last")) if drop_last else F.lit(True)))
    grouped = words.groupBy(*page, "line", F.col("_word").alias("word")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda s: s["char"]), "").alias("text"), *[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")]
    )
    return grouped


def _among(steps: Column, ordered: Column, word: Column) -> Column:
    """Whether word is in a sorted array, by halving; steps: powers of two below its size, falling."""
    at = F.aggregate(steps, F.lit(0), lambda lo, p: F.when((lo + p < F.size(ordered)) & (F.get(ordered, lo + p) <= word), lo + p).otherwise(lo))
    return F.get(ordered, at) == word


def gone_words(words: Column, redacted: Column) -> Column:
    """Of an array of boxes (BOX) those whose text is no longer among the blank-separated words of redacted.
    A word that stands anywhere in redacted shields all its boxes; boxes without text stay as they are.

    The words that are gone are found by hash and sorted, once a page, and each box looks its own up by halving: a page
    takes n log n steps, however many of its words are gone.
    """
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def of(boxes: Column) -> Column:
        said = F.transform(F.filter(boxes, lambda b: b["text"].isNotNull()), lambda b: b["text"])
        gone = F.sort_array(F.array_except(said, F.split(redacted, " ")))
        return let(gone, lambda g: let(F.filter(powers, lambda p: p < F.size(g)), lambda steps: F.filter(boxes, lambda b: b["text"].isNotNull() & _among(steps, g, b["text"]))))

    return let(words, of)


def ocr_text(words: Column) -> Column:
    return F.array_join(F.transform(F.filter(words, lambda b: b["text"].isNotNull()), lambda b: b["text"]), " ")


def gone_words_join(words: DataFrame, redacted_words: DataFrame, page: str = "page") -> DataFrame:
    """The same relationally: rows of words (page, text, ...) without a row of equal page and text."""
    return words.filter("text is not null").join(redacted_words.select(page, "text").distinct(), [page, "text"], "left_anti")
