"""Detectors behind one contract: local rules, and remote services as far as they can be stated offline."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import detect
from umbra.operators.converters import Converters, fit
from umbra.operators.images import MARGINS, black_out
from umbra.plans.planning import PROVIDERS, Provider

BOXES_SCHEMA = "array<struct<x1:float,y1:float,x2:float,y2:float,text:string>>"


class Detector(Protocol):
    """Anything that redacts: a text column, parsed tables (umbra.sources.tables), or pictures (operators/pictures.py).
    What a detector can't take fails the row, never passes it on unredacted."""

    provider: Provider

    def redact(self, df: DataFrame, column: str) -> DataFrame: ...

    def redact_tables(self, tables: DataFrame) -> DataFrame: ...

    def redact_pictures(self, pictures: DataFrame, converters: Converters) -> DataFrame: ...


def refuse(df: DataFrame, why: str, *columns: str) -> DataFrame:
    """df whose rows all have an error (the first one stays) and nothing in columns."""
    return df.withColumns({"error": F.coalesce("error", F.lit(why))} | {c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


@dataclass(frozen=True)
class RuleDetector:
    """Local patterns. mode: replace by a token, or mask by as many X. Types in denied are left alone."""

    rules: Sequence[detect.Rule] = detect.DEFAULT_RULES
    mode: str = "replace"
    denied: Sequence[str] = detect.DENIED
    provider: Provider = field(default=PROVIDERS["rules"])

    def expression(self, text: Column) -> Column:
        rules = [r for r in self.rules if r.entity not in self.denied]
        if not rules:
            return text
        return detect.replace(text, rules) if self.mode == "replace" else detect.mask(text, rules)

    def redact(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, self.expression(F.col(column)))

    def redact_tables(self, tables: DataFrame) -> DataFrame:
        return tables.withColumns({"headers": F.transform("headers", self.expression), "rows": F.transform("rows", lambda r: F.transform(r, self.expression))})

    def redact_pictures(self, pictures: DataFrame, converters: Converters) -> DataFrame:
        return refuse(pictures, "rules take no images", "content")


@dataclass(frozen=True)
class RemoteDetector:
    """A service behind calls that are made once per partition by connect functions. Failures are data: an exception
    goes to the column `error`, and what was to be redacted becomes null.

    connect() -> call(text) -> text. connect_table() -> call(headers, rows) -> (headers, rows); without it each header
    and cell is a text. connect_boxes() -> call(PNG) -> JSON list of boxes, which are blacked out with margin.
    connect_image() -> call(image, media type) -> image, or None if the answer holds none. resize: images are first
    fitted to resize x resize pixels, and keep that size.
    """

    provider: Provider
    connect: Callable[[], Callable[[str], str]] | None = None
    connect_table: Callable[[], Callable] | None = None
    connect_boxes: Callable[[], Callable[[bytes], str]] | None = None
    connect_image: Callable[[], Callable[[bytes, str], bytes | None]] | None = None
    margin: float | None = None
    resize: int | None = None

    def _each(self, df: DataFrame, columns: Sequence[str], make: Callable[[], Callable[..., tuple]]) -> DataFrame:
        """columns of every row without an error through make()'s function."""
        base = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
        at, err = [base.columns.index(c) for c in columns], base.columns.index("error")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            call = make()
            for batch in batches:
                errors = batch.column(err).to_pylist()
                values = [list(v) for v in zip(*(batch.column(k).to_pylist() for k in at))]
                for k, row in enumerate(values):
                    if errors[k] is not None or row[0] is None:
                        continue
                    try:
                        values[k] = list(call(*row))
                    except Exception as e:
                        values[k], errors[k] = [None] * len(at), str(e) or type(e).__name__
                cols = list(batch.columns)
                for n, k in enumerate(at):
                    cols[k] = pa.array([v[n] for v in values], batch.schema.field(k).type)
                cols[err] = pa.array(errors, pa.string())
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

        return base.mapInArrow(run, base.schema)

    def redact(self, df: DataFrame, column: str) -> DataFrame:
        connect = self.connect
        if connect is None:
            return refuse(df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string")), f"{self.provider.name} takes no text", column)

        def make():
            call = connect()
            return lambda text: (call(text),)

        return self._each(df, [column], make)

    def redact_tables(self, tables: DataFrame) -> DataFrame:
        connect, connect_table, name = self.connect, self.connect_table, self.provider.name
        if connect is None and connect_table is None:
            return refuse(tables, f"{name} takes no tables", "headers", "rows")

        def make():
            if connect_table is not None:
                return connect_table()
            call = connect()
            cell = lambda c: c if c is None else call(c)
            return lambda headers, rows: ([cell(h) for h in headers], [[cell(c) for c in r] for r in rows])

        return self._each(tables, ["headers", "rows"], make)

    def redact_pictures(self, pictures: DataFrame, converters: Converters) -> DataFrame:
        boxes, image, size, codecs = self.connect_boxes, self.connect_image, self.resize, converters.codecs
        factor = MARGINS.get(self.provider.name, 0.0) if self.margin is None else self.margin
        if boxes is None and image is None:
            return refuse(pictures, f"{self.provider.name} takes no images", "content")

        def make():
            ask, edit = boxes and boxes(), image and image()

            def call(content: bytes, mime: str) -> tuple:
                if edit is not None:
                    return edit(content, mime), mime
                if mime not in codecs:
                    raise ValueError(f"no codec for {mime}")
                decode, encode = codecs[mime]
                pixels = decode(content)
                pixels = fit(pixels, size) if size else pixels
                found = strict_boxes(ask(codecs["image/png"][1](pixels)))
                return encode(black_out(pixels, found, factor)), mime

            return call

        return self._each(pictures, ["content", "media_type"], make)


def strict_boxes(answer: str) -> list[tuple[float, float, float, float]]:
    """A model's JSON list of boxes; all four coordinates of each must be numbers."""
    found = json.loads(answer)
    if not isinstance(found, list):
        raise ValueError("the answer is no list of boxes")
    out = []
    for box in found:
        values = [box.get(c) if isinstance(box, dict) else None for c in ("x1", "y1", "x2", "y2")]
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            raise ValueError("a box lacks a coordinate")
        out.append(tuple(values))
    return out


def accept_json(status: int, content_type: str, body: str) -> object:
    """A service's answer, if it is a success and says it is JSON."""
    if not 200 <= status < 300:
        raise ValueError(f"service answered {status}")
    if content_type != "application/json":
        raise ValueError(f"service answered {content_type}")
    return json.loads(body)


def new_separator(text: str) -> str:
    """A line that doesn't stand in the text."""
    while (line := f"---{secrets.randbits(64)}") in text:
        pass
    return line


def text_prompt(text: str, separator: str) -> str:
    """What a language model is asked for. separator must not stand in the text."""
    if separator in text:
        raise ValueError("the separator stands in the text")
    return f"Rewrite the text between the lines {separator}. Put {detect.REPLACEMENT} in place of anything personal, and change nothing else.\n{separator}\n{text}\n{separator}\n"


def join_parts(parts: Column) -> tuple[Column, Column]:
    """(text, error) of a model's answer: its text parts in order; an answer without any is an error, and data."""
    found = F.filter(parts, lambda p: p.isNotNull())
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    return F.when(some, F.array_join(found, "")), F.when(~some, "the answer holds no text")


def boxes_from_json(answer: Column) -> Column:
    """Image boxes of a model's JSON answer; null unless all four coordinates of every box are there."""
    boxes = F.from_json(answer, BOXES_SCHEMA)
    whole = F.forall(boxes, lambda b: b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull())
    return F.when(whole, boxes)


_REGISTRY: dict[str, Callable[..., Detector]] = {"rules": RuleDetector}


def register(name: str, factory: Callable[..., Detector]) -> None:
    _REGISTRY[name] = factory


def registered(name: str) -> bool:
    return name in _REGISTRY


def detector(name: str, **options: object) -> Detector:
    """A registered detector. A remote provider is registered with a transport: see services.install()."""
    if name in _REGISTRY:
        return _REGISTRY[name](**options)
    if name in PROVIDERS:
        raise ValueError(f"{name} is a remote service; install() it with a transport that may speak to it")
    raise ValueError(f"no detector named {name!r}")


def check_options(name: str, options: dict[str, object]) -> None:
    """What a remote provider can't do without."""
    needs = {"gcp-dlp": ["gcp_project_id"], "gemini-llm": ["gcp_project_id"], "gcp-vertex-ai": ["gcp_project_id", "gcp_region"], "open-ai-llm": ["open_ai_api_key"]}
    missing = [o for o in needs.get(name, []) if not options.get(o)]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    if name == "ms-presidio" and not (options.get("ms_presidio_text_analyze_url") or options.get("ms_presidio_image_redact_url")):
        raise ValueError("ms-presidio needs a text or an image URL at least")
