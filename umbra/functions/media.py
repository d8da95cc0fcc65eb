"""Names and media types: glob patterns, guesses by extension, overrides and classes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own table: an extension's first candidate. Unknown extensions have no media type.
BY_EXTENSION = {
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "html": "text/html", "htm": "text/html", "css": "text/css", "xml": "text/xml", "yaml": "text/x-yaml", "yml": "text/x-yaml",
    "toml": "text/x-toml", "js": "text/javascript", "json": "application/json", "pdf": "application/pdf", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp",
    "zip": "application/zip", "bin": "application/octet-stream", "parquet": "application/vnd.apache.parquet",
}
TEXT_PATTERN = r"^(text/(plain|html|xml|css|yaml|markdown|x-.*)|application/(xml|json|yaml|x-yaml))$"
IMAGE_TYPES = tuple(sorted({t for t in BY_EXTENSION.values() if t.startswith("image/")} | {"image/jpg", "image/jpe"}))
DLP_IMAGES = ("image/png", "image/jpeg", "image/jpg", "image/jpe", "image/gif", "image/bmp")


def glob_pattern(glob: str) -> str:
    """An anchored pattern for a glob over whole relative paths: * and ** cross /, ? is one character,
    [..] and [!..] are classes, {a,b} alternatives."""
    out, depth, k = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            while k + 1 < len(glob) and glob[k + 1] == "*":
                k += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^")) + "]")
            k = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        k += 1
    return "^(?s:" + "".join(out) + ")$" if depth == 0 else "^" + re.escape(glob) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def guess(path: Column) -> Column:
    """Media type by extension, null where there is none or it isn't known."""
    table = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    extension = F.lower(F.regexp_extract(filename(path), r".\.([^.]+)$", 1))
    return F.element_at(table, extension)


def parse_override(option: str) -> tuple[str, str]:
    """mime=glob, cut at the first =."""
    mime, found, glob = option.partition("=")
    if not found or "/" not in mime or not glob:
        raise ValueError(f"expected type/subtype=glob, got {option!r}")
    return mime, glob


def override(path: Column, media_type: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The media type of the first rule (type, glob) whose glob matches, else what it was."""
    return F.coalesce(*[F.when(matches_glob(path, glob), F.lit(mime)) for mime, glob in rules], media_type)


def is_text(media_type: Column) -> Column:
    return F.coalesce(media_type.rlike(TEXT_PATTERN), F.lit(False))


def is_table(media_type: Column) -> Column:
    return F.coalesce(media_type == "text/csv", F.lit(False))


def is_image(media_type: Column) -> Column:
    return F.coalesce(media_type.startswith("image/"), F.lit(False))


def is_pdf(media_type: Column) -> Column:
    return F.coalesce(media_type == "application/pdf", F.lit(False))


def media_class(media_type: Column) -> Column:
    """text, table, image, pdf, or null for what nothing can be done with."""
    return F.when(is_text(media_type), "text").when(is_table(media_type), "table").when(is_image(media_type), "image").when(is_pdf(media_type), "pdf")
