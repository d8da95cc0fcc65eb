"""One contract for every place that files come from or go to, chosen by the scheme of a path."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.sources import sinks
from umbra.sources.archive import read_zip, write_zip
from umbra.sources.inventory import INVENTORY, Clipboard, clipboard_file, resolve, root_of, scan, with_verdict


class Connection(ABC):
    """has_many: the path names a set of files. accepts_many: several files can go there."""

    has_many = False
    accepts_many = False

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @abstractmethod
    def read(self) -> DataFrame:
        """relative_path, media_type, file_size, content of all files."""

    @abstractmethod
    def write(self, files: DataFrame) -> DataFrame | list[str]:
        """Write the rows (relative_path, media_type, content, outcome) that aren't Skipped; the outcomes of all of
        them: a DataFrame with a column outcome that writes when it is evaluated, or a list."""

    def names(self) -> DataFrame:
        """relative_path, media_type, file_size of what can be listed; a single file lists nothing."""
        return self.spark.createDataFrame([], INVENTORY)

    def list(self, max_size: int | None = None, name_glob: str | None = None, overrides: Sequence[tuple[str, str]] = ()) -> DataFrame:
        """names() with a verdict each."""
        return with_verdict(self.names(), max_size, name_glob, overrides)

    def resolve(self, relative_path: str) -> str:
        """Where a file of this name lies."""
        return sinks.destination(self.path, relative_path, not self.accepts_many)


class Files(Connection):
    """A folder or a file of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, resolve(path)[1])
        self.url = path
        self.has_many = self.accepts_many = root_of(spark, self.path)[1]

    def read(self) -> DataFrame:
        return scan(self.spark, self.url, content=True)

    def names(self) -> DataFrame:
        return scan(self.spark, self.url) if self.has_many else super().names()

    def write(self, files: DataFrame) -> DataFrame:
        return sinks.write_files(files, self.path, not self.accepts_many)


class Zip(Connection):
    """An archive; one that is written must not exist."""

    has_many = accepts_many = True

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, resolve(path)[1])

    def read(self) -> DataFrame:
        return read_zip(self.spark, self.path)

    def names(self) -> DataFrame:
        return self.read().drop("content")

    def write(self, files: DataFrame) -> list[str]:
        return write_zip(files, self.path)

    def resolve(self, relative_path: str) -> str:
        return f"{self.path}:{relative_path}"


class Board(Connection):
    """The clipboard: one value, in the caller's hands. It lists nothing."""

    def __init__(self, spark: SparkSession, path: str, clipboard: Clipboard | None = None):
        super().__init__(spark, path)
        self.clipboard = clipboard

    def read(self) -> DataFrame:
        return clipboard_file(self.spark, self.clipboard)

    def write(self, files: DataFrame) -> list[str]:
        if self.clipboard is None:
            raise ValueError("there is no clipboard to write to")
        return self.clipboard.take(files.first())

    def resolve(self, relative_path: str) -> str:
        return self.path


class Nothing(Connection):
    """Lists nothing, and can neither be read from nor written to."""

    def read(self) -> DataFrame:
        raise ValueError("noop can't be read from")

    def write(self, files: DataFrame) -> DataFrame:
        raise ValueError("noop can't be written to")


def connect(spark: SparkSession, path: str, clipboard: Clipboard | None = None) -> Connection:
    """The connection of a path: local where it has no scheme; an unknown scheme is an error."""
    kind, _ = resolve(path)
    if kind == "zip":
        return Zip(spark, path)
    if kind == "clipboard":
        return Board(spark, path, clipboard)
    return Nothing(spark, path) if kind == "noop" else Files(spark, path)


def check_cardinality(source: Connection, destination: Connection) -> None:
    if source.has_many and not destination.accepts_many:
        raise ValueError("several files can't go to a single destination file")


def counted(outcomes: DataFrame | list[str]) -> dict[str, int]:
    """files_copied (redacted ones included), files_redacted, files_skipped of what write() gave."""
    if isinstance(outcomes, list):
        return {"files_copied": len([o for o in outcomes if o != "Skipped"]), "files_redacted": outcomes.count("Redacted"), "files_skipped": outcomes.count("Skipped")}
    return outcomes.agg(*[F.count_if(c).alias(n) for n, c in (("files_copied", F.col("outcome") != "Skipped"), ("files_redacted", F.col("outcome") == "Redacted"), ("files_skipped", F.col("outcome") == "Skipped"))]).first().asDict()
