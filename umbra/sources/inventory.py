"""The inventory: a row per file, from any Hadoop file system, without reading content."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from umbra.functions import media
from umbra.plans.planning import verdict

INVENTORY = "relative_path string, media_type string, file_size bigint"
#: A file's status as Hadoop prints it; a path may hold anything, so the last match counts.
_STATUS = re.compile(r"\w+\{path=(.*); isDirectory=false; length=(\d+); ", re.DOTALL)
SCHEMES = {"": "file", "file": "file", "gs": "gs", "s3": "s3a", "s3a": "s3a", "hdfs": "hdfs", "zip": "zip", "clipboard": "clipboard", "noop": "noop"}


@dataclass
class Clipboard:
    """What clipboard:// stands for: a value that the caller hands in, or takes out after the copy."""

    content: bytes | str | None = None
    media_type: str = "text/plain"

    def take(self, row: Row | None) -> list[str]:
        """Keep what a copy sends here. Needs a media type; text is decoded with replacement characters."""
        if row is None:
            return []
        if row["outcome"] != "Skipped":
            if row["media_type"] is None:
                raise ValueError("the clipboard takes only what has a media type")
            data = bytes(row["content"] or b"")
            self.media_type = row["media_type"]
            self.content = data if self.media_type.startswith("image/") else data.decode(errors="replace")
        return [row["outcome"]]


def clipboard_file(spark: SparkSession, clipboard: Clipboard | None) -> DataFrame:
    """The clipboard as one file, named by the second; an empty one can't be read."""
    if clipboard is None or clipboard.content is None:
        raise ValueError("the clipboard is empty")
    data = clipboard.content.encode() if isinstance(clipboard.content, str) else bytes(clipboard.content)
    return spark.createDataFrame([(str(int(time.time())), clipboard.media_type, len(data), data)], INVENTORY + ", content binary")


class UnknownSource(ValueError):
    """No source goes by this scheme."""


def resolve(path: str) -> tuple[str, str]:
    """(scheme, path for Spark). A path without a scheme is local; s3:// is read through s3a."""
    scheme = urlparse(path).scheme if "://" in path else ""
    if scheme not in SCHEMES:
        raise UnknownSource(path)
    kind, rest = SCHEMES[scheme], path.split("://", 1)[-1]
    if kind in ("s3a", "gs") and "/" not in rest:
        if kind == "s3a":
            raise ValueError(f"{path}: a bucket needs a key or a closing /")
        rest += "/"
    return kind, rest if kind in ("zip", "clipboard", "noop") else rest if kind == "file" else f"{kind}://{rest}"


def root_of(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path to strip from files, and whether it is a folder: by a closing / or by what is there."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = path.endswith("/") or (fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory())
    return fs.makeQualified(jpath).toString().rstrip("/"), folder


def _empty_files(files: DataFrame) -> list[str]:
    """Paths of the files of length 0 in a file scan's listing; Spark lists them, and reads none of them."""
    listed = files._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().allFiles()
    step, found = 10_000, []
    for k in range(0, listed.size(), step):
        found += [m for status in listed.slice(k, k + step).mkString("\0").split("\0") if (m := _STATUS.match(status)) and m[2] == "0"]
    return [m[1] for m in found]


def scan(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """relative_path, media_type, file_size of the files under a folder, or of the one file, empty ones too; content if
    asked. Names that begin with . or _ are hidden to Spark and left out.

    Only the folder's own prefix is stripped from paths. Without content the scan reads names and sizes alone.
    """
    _, where = resolve(path)
    root, folder = root_of(spark, where)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    empty = _empty_files(files)
    files = files.select("path", "length", *(["content"] if content else []))
    if empty:
        none = spark.createDataFrame([(p,) for p in empty], "path string").withColumn("length", F.lit(0).cast("bigint"))
        files = files.unionByName(none.withColumn("content", F.unhex(F.lit(""))) if content else none)
    plain = lambda c: F.regexp_replace(c, r"^([a-z0-9]+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one
    prefix = plain(F.lit(root if folder else root.rsplit("/", 1)[0]))
    relative = F.substring(plain(F.col("path")), F.length(prefix) + 2, F.length("path"))
    out = files.select(relative.alias("relative_path"), "length", *(["content"] if content else []))
    return out.select("relative_path", media.guess(F.col("relative_path")).alias("media_type"), F.col("length").alias("file_size"), *(["content"] if content else []))


def with_verdict(files: DataFrame, max_size: int | None = None, name_glob: str | None = None, overrides: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Adds verdict and effective_media_type; media_type stays what it was, for the written file."""
    path, kind = F.col("relative_path"), F.col("media_type")
    return files.withColumns({"verdict": verdict(path, F.col("file_size"), max_size, name_glob), "effective_media_type": media.override(path, kind, overrides)})


def first_files(files: DataFrame, limit: int | None) -> DataFrame:
    """The first matched files by path; a top-k, so the same on every run."""
    return files if limit is None else files.orderBy("relative_path").limit(limit)


def decode_text(content: Column) -> tuple[Column, Column]:
    """(text, error): strict UTF-8; bytes that aren't are an error and no text."""
    good = F.is_valid_utf8(content.cast("string"))
    return F.when(good, content.cast("string")), F.when(~good, F.lit("content is not UTF-8"))
