"""copy and list: the inventory, the plan, the redaction and the account of a run, as one DataFrame program."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from umbra.functions import media
from umbra.functions.detect import sample
from umbra.functions.throttle import Bucket, Limit, share
from umbra.operators import converters as plugins
from umbra.operators import pictures
from umbra.operators.providers import Detector
from umbra.plans.planning import outcome, redact_plan
from umbra.sources import sinks
from umbra.sources.connection import check_cardinality, connect, counted
from umbra.sources.inventory import Clipboard, decode_text, first_files, with_verdict
from umbra.sources.tables import read_tables, with_made_headers, write_tables


@dataclass(frozen=True)
class CopyOptions:
    max_size: int | None = None
    max_files: int | None = None
    name_glob: str | None = None
    mime_override: Sequence[tuple[str, str]] = ()
    detectors: Sequence[Detector] | None = None
    allow_unsupported_copies: bool = False
    csv_header: bool = True
    csv_sep: str = ","
    sample_chars: int | None = None
    limit: Limit | None = None
    match_name_again: bool = False
    csv_empty_header: bool = False
    csv_synthetic_header: bool = False
    clipboard: Clipboard | None = None


def throttled(files: DataFrame, limit: Limit, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """files, each with a plan held back until its turn: once a file, not a request. The tasks that can run at a time
    share the limit, so all of them together keep it."""
    mine = share(limit, files.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = lambda: time.time_ns() // 1_000_000
        bucket = Bucket(mine, now())
        for batch in batches:
            for k, passes in enumerate(batch.column("n_passes").to_pylist()):
                if passes and (wait := bucket.delay(now())) > 0:
                    sleep(wait / 1000)
                yield batch.slice(k, 1)

    return files.mapInArrow(run, files.schema)


def redact_files(files: DataFrame, options: CopyOptions) -> DataFrame:
    """relative_path, media_type, content, outcome, error, n_passes of matched files (with content).

    Each kind goes its own way through the detectors of its plan, in their order, and all are united again. A file
    that fails is Skipped with its error, and so is one that a detector of the plan can't take; the run goes on.
    n_passes are the detectors that ran over a file.
    """
    detectors, able = list(options.detectors or ()), plugins.installed()
    plan = redact_plan(F.col("effective_media_type"), [d.provider for d in detectors], pdf=able.has_pdf, ocr=able.ocr is not None)
    planned = files.withColumn("plan", plan).withColumn("n_passes", F.size("plan.providers")).withColumn("error", F.lit(None).cast("string"))
    if options.limit is not None and detectors:
        planned = throttled(planned, options.limit)
    kind = media.media_class(F.col("effective_media_type"))
    planned = planned.withColumn("_kind", F.when(F.col("n_passes") == 0, "none").when((kind == "table") & F.col("plan.table_as_text"), "text").otherwise(kind))
    out_cols = ["relative_path", "media_type", "content", "outcome", "error", "n_passes"]

    def finish(df: DataFrame) -> DataFrame:
        ran = df.withColumn("n_passes", F.when(F.col("error").isNull(), F.col("n_passes")).otherwise(0))
        done = ran.withColumn("outcome", outcome(F.col("verdict"), options.detectors is not None, F.col("n_passes"), F.col("error"), options.allow_unsupported_copies))
        return done.withColumn("content", F.when(F.col("outcome") != "Skipped", F.col("content"))).select(out_cols)

    def returned(redacted: DataFrame) -> DataFrame:
        """Files that come back as relative_path, content and error, with what was known of them in _file."""
        lost = F.when(F.col("content").isNull(), F.coalesce("error", F.lit("nothing came back")))
        return finish(redacted.select("relative_path", "content", F.coalesce("error", lost).alias("error"), "_file.*"))

    known = F.struct("verdict", "media_type", "n_passes").alias("_file")
    text, bad = decode_text(F.col("content"))
    texts = planned.filter("_kind = 'text'").withColumn("error", bad).withColumn("_text", text)
    if options.sample_chars is not None:
        texts = texts.withColumn("_text", sample(F.col("_text"), options.sample_chars))
    for d in (d for d in detectors if d.provider.text):
        texts = d.redact(texts, "_text")
    parts = [finish(planned.filter("_kind = 'none'")), finish(texts.withColumn("content", F.encode("_text", "UTF-8")))]

    by_table = [d for d in detectors if d.provider.table]
    if by_table:
        tables = planned.filter("_kind = 'table'").select("relative_path", "content", known)
        parsed = read_tables(tables, options.csv_sep, options.csv_header)
        if options.csv_synthetic_header:
            parsed = with_made_headers(parsed)
        for d in by_table:
            parsed = d.redact_tables(parsed)
        parts.append(returned(write_tables(parsed, options.csv_sep, options.csv_empty_header)))

    by_text, by_png = [d for d in detectors if d.provider.text], [d for d in detectors if d.provider.takes_png()]
    if any(d.provider.images for d in detectors) or (able.ocr and by_text):
        shots = planned.filter("_kind = 'image'").withColumn("_file", known)
        done = []
        # a type that only some providers take goes through those alone
        for names in {tuple(d.provider.name for d in detectors if d.provider.images is True or mime in (d.provider.images or ())) for mime in media.IMAGE_TYPES} - {()}:
            mine = shots.filter(F.concat_ws("\n", "plan.providers") == "\n".join(names)).filter("not plan.apply_ocr")
            done.append(pictures.redact_by_image(pictures.as_pictures(mine, "_file"), [d for d in detectors if d.provider.name in names], able))
        if able.ocr and by_text:
            done.append(pictures.redact_by_text(pictures.as_pictures(shots.filter("plan.apply_ocr"), "_file"), by_text, able))
        parts.append(returned(_union(done)))
    if able.has_pdf and (by_png or (able.ocr and by_text)):
        papers = planned.filter("_kind = 'pdf'").select("relative_path", "content", known)
        pages = pictures.split_pages(papers, able)
        pages = pictures.redact_by_image(pages, by_png, able) if by_png else pictures.redact_by_text(pages, by_text, able)
        parts.append(returned(pictures.merge_pages(pages, able)))
    return _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def copy(spark: SparkSession, source: str, dest: str, options: CopyOptions = CopyOptions(), report: str | None = None) -> Row:
    """Copy the files of source to dest, redacting on the way; the run's counters.

    A file is read, redacted and written in one pass; nothing is cached. Which files a limit on their number
    leaves is settled by names alone, before any content is read.
    """
    came, goes = connect(spark, source, options.clipboard), connect(spark, dest, options.clipboard)
    check_cardinality(came, goes)
    files = with_verdict(came.read(), options.max_size, options.name_glob, options.mime_override)
    if options.match_name_again and options.name_glob:
        files = files.withColumn("verdict", F.when(media.matches_glob(media.filename(F.col("relative_path")), options.name_glob), F.col("verdict")).otherwise("SkippedDueToName"))
    matched = files.filter("verdict = 'Matched'")
    if came.has_many and options.max_files is not None:
        names = first_files(matched.select("relative_path"), options.max_files)
        matched = matched.join(names, "relative_path", "left_semi").select(matched.columns)
    skipped = files.drop("content").filter("verdict <> 'Matched'").count()
    counts = counted(goes.write(redact_files(matched, options)))
    counters = Row(**(counts | {"files_skipped": counts["files_skipped"] + skipped}))
    if report:
        sinks.json_report(counters, report)
    return counters


def listing(spark: SparkSession, source: str, max_size: int | None = None, name_glob: str | None = None) -> DataFrame:
    """Matched and skipped files of a source with their verdict."""
    return connect(spark, source).list(max_size, name_glob)
