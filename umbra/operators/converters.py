"""Plug-ins for what needs a codec, a recogniser or a renderer: images, OCR and PDF.

Each is a plain function, registered on the driver and sent to the executors with the work. PNG is built in;
what isn't registered is missing, and the plan knows it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np

from umbra.operators.images import decode_png, encode_png

#: Box of recognised text: x1, y1, x2, y2, text.
Words = list[tuple[float, float, float, float, str | None]]


@dataclass(frozen=True)
class Page:
    """A rendered PDF page: RGB pixels, and the size it has in the document."""

    pixels: np.ndarray
    width: float
    height: float


@dataclass(frozen=True)
class Converters:
    """codecs: media type -> (decode to RGB pixels, encode); ocr: pixels -> words; split and merge: PDF <-> pages."""

    codecs: dict[str, tuple[Callable[[bytes], np.ndarray], Callable[[np.ndarray], bytes]]]
    ocr: Callable[[np.ndarray], Words] | None = None
    split_pdf: Callable[[bytes], list[Page]] | None = None
    merge_pdf: Callable[[list[Page]], bytes] | None = None

    @property
    def has_pdf(self) -> bool:
        return self.split_pdf is not None and self.merge_pdf is not None


_INSTALLED = Converters({"image/png": (decode_png, encode_png)})


def installed() -> Converters:
    return _INSTALLED


def install(codecs: dict | None = None, **parts: Callable) -> Converters:
    """Add image codecs, or set ocr, split_pdf, merge_pdf (None takes one away); what is installed now."""
    global _INSTALLED
    _INSTALLED = replace(_INSTALLED, codecs=_INSTALLED.codecs | (codecs or {}), **parts)
    return _INSTALLED


def locate(name: str, places: Sequence[str]) -> str | None:
    """The first of the places (folders) that holds name: how a plug-in finds its models or its library, beside the
    program, in a shared folder or in a cache, before it leaves it to the system."""
    found = (os.path.join(os.path.expanduser(p), name) for p in places)
    return next((f for f in found if os.path.exists(f)), None)


def _weights(new: int, old: int) -> np.ndarray:
    """Rows of Gaussian weights (deviation half a pixel of the smaller image, cut at 3 pixels)."""
    ratio = old / new
    scale = max(ratio, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * ratio
    at = np.arange(old)[None, :]
    inside = (at >= np.maximum(np.floor(centre - 3 * scale), 0)) & (at < np.minimum(np.ceil(centre + 3 * scale), old))
    w = np.where(inside, np.exp(-(((at + 0.5 - centre) / scale) ** 2) / 0.5), 0)
    return w / w.sum(axis=1, keepdims=True)


def fit(pixels: np.ndarray, most: int = 1024) -> np.ndarray:
    """The image scaled to fit most x most, its proportions kept; a smaller one grows. The result keeps its new size."""
    height, width, _ = pixels.shape
    ratio = min(most / width, most / height)
    new_w, new_h = max(round(width * ratio), 1), max(round(height * ratio), 1)
    if (new_w, new_h) == (width, height):
        return pixels
    tall = np.einsum("nh,hwc->nwc", _weights(new_h, height), pixels.astype(np.float64), optimize=True)
    wide = np.einsum("nw,hwc->hnc", _weights(new_w, width), tall, optimize=True)
    return np.clip(np.rint(wide), 0, 255).astype(np.uint8)
