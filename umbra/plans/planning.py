"""What each file gets: a plan by media type and provider, an outcome, and a run's counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import media


@dataclass(frozen=True)
class Provider:
    """A detector as planning sees it: which kinds of content it takes as they are."""

    name: str
    text: bool = True
    table: bool = False
    images: bool | tuple[str, ...] = False

    def supports(self, media_type: Column) -> Column:
        by_kind = F.lit(False)
        if self.text:
            by_kind = by_kind | media.is_text(media_type)
        if self.table:
            by_kind = by_kind | media.is_table(media_type)
        if self.images is True:
            by_kind = by_kind | media.is_image(media_type)
        elif self.images:
            by_kind = by_kind | F.coalesce(media_type.isin(*self.images), F.lit(False))
        return by_kind

    def takes_png(self) -> bool:
        return self.images is True or (bool(self.images) and "image/png" in self.images)


PROVIDERS = {
    "gcp-dlp": Provider("gcp-dlp", table=True, images=media.DLP_IMAGES),
    "aws-comprehend": Provider("aws-comprehend"),
    "ms-presidio": Provider("ms-presidio", images=True),
    "gemini-llm": Provider("gemini-llm", images=True),
    "open-ai-llm": Provider("open-ai-llm", images=True),
    "gcp-vertex-ai": Provider("gcp-vertex-ai", images=True),
    "rules": Provider("rules", table=True),
}


def presidio(text_url: str | None, image_url: str | None) -> Provider:
    if not (text_url or image_url):
        raise ValueError("ms-presidio needs a text or an image URL at least")
    return Provider("ms-presidio", text=bool(text_url), images=bool(image_url))


def _names(providers: Sequence[Provider]) -> Column:
    return F.array(*[F.lit(p.name) for p in providers]) if providers else F.array().cast("array<string>")


def redact_plan(media_type: Column, providers: Sequence[Provider], pdf: bool = False, ocr: bool = False) -> Column:
    """struct(providers, apply_pdf, apply_ocr, table_as_text).

    Providers that take the media type natively, in order. Only if there is none: tables as text, PDFs as
    page images or else as OCR text, images as OCR text, as far as the converters are there.
    """
    native = F.array_compact(F.array(*[F.when(p.supports(media_type), F.lit(p.name)) for p in providers])) if providers else F.array().cast("array<string>")
    text, image = [p for p in providers if p.text], [p for p in providers if p.takes_png()]

    def plan(names: Column, apply_pdf: bool = False, apply_ocr: bool = False, as_text: bool = False) -> Column:
        return F.struct(names.cast("array<string>").alias("providers"), F.lit(apply_pdf).alias("apply_pdf"), F.lit(apply_ocr).alias("apply_ocr"), F.lit(as_text).alias("table_as_text"))

    out = F.when(F.size(native) > 0, plan(native))
    if text:
        out = out.when(media.is_table(media_type), plan(_names(text), as_text=True))
    if pdf and image:
        out = out.when(media.is_pdf(media_type), plan(_names(image), apply_pdf=True))
    elif pdf and ocr and text:
        out = out.when(media.is_pdf(media_type), plan(_names(text), apply_pdf=True, apply_ocr=True))
    if ocr and text:
        out = out.when(media.is_image(media_type), plan(_names(text), apply_ocr=True))
    return out.otherwise(plan(_names([])))


def verdict(path: Column, size: Column, max_size: int | None = None, name_glob: str | None = None) -> Column:
    """Matched, SkippedDueToSize or SkippedDueToName; size is looked at first, an unknown size passes."""
    out = None
    if max_size is not None:
        out = F.when(F.coalesce(size > max_size, F.lit(False)), "SkippedDueToSize")
    if name_glob is not None:
        miss = ~media.matches_glob(path, name_glob)
        out = F.when(miss, "SkippedDueToName") if out is None else out.when(miss, "SkippedDueToName")
    return F.lit("Matched") if out is None else out.otherwise("Matched")


def outcome(verdict_: Column, redacting: bool, n_passes: Column, error: Column, allow_unsupported: bool) -> Column:
    """Copied, Redacted or Skipped. n_passes: providers of the plan; error: not null where redaction failed."""
    matched = verdict_ == "Matched"
    if not redacting:
        return F.when(matched, "Copied").otherwise("Skipped")
    return F.when(~matched, "Skipped").when(error.isNotNull(), "Skipped").when(n_passes > 0, "Redacted").otherwise("Copied" if allow_unsupported else "Skipped")


def run_counters(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """One row: files_copied (redacted ones included), files_redacted, files_skipped."""
    o = F.col(column)
    return outcomes.agg(F.count_if(o.isin("Copied", "Redacted")).alias("files_copied"), F.count_if(o == "Redacted").alias("files_redacted"), F.count_if(o == "Skipped").alias("files_skipped"))


def listing_totals(files: DataFrame) -> DataFrame:
    """One row: files_found, total_size (unknown sizes count as 0), files_skipped, longest_name."""
    hit = F.col("verdict") == "Matched"
    return files.agg(
        F.count_if(hit).alias("files_found"),
        F.coalesce(F.sum(F.when(hit, F.coalesce(F.col("file_size"), F.lit(0)))), F.lit(0)).cast("bigint").alias("total_size"),
        F.count_if(~hit).alias("files_skipped"),
        F.coalesce(F.max(F.when(hit, F.length("relative_path"))), F.lit(0)).cast("bigint").alias("longest_name"),
    )
