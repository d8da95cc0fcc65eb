"""The registered queries of the redaction engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.engine import CopyOptions, redact_files
from umbra.functions import detect, media, throttle
from umbra.functions.detect import CARD, DEFAULT_RULES, EMAIL, IP, PHONE, TOKEN
from umbra.operators import images, pictures
from umbra.operators.converters import Page, installed
from umbra.operators.providers import RuleDetector, boxes_from_json
from umbra.plans import planning
from umbra.plans.planning import PROVIDERS
from umbra.session import shared_path, spread
from umbra.sources.archive import read_zip, write_zip
from umbra.sources.inventory import decode_text, first_files, scan, with_verdict
from umbra.sources.sinks import write_files
from umbra.sources.tables import read_tables, redact_columns, write_tables

EXTENSIONS = ("txt", "md", "csv", "png", "pdf", "json", "html", "js", "toml", "svg", "bin")
_SQL_EXT = "['" + "','".join(EXTENSIONS) + "']"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """documents, spread over the cores where they are one small row group."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def sql_replace(column: str, rules=DEFAULT_RULES) -> str:
    for r in rules:
        column = f"regexp_replace({column}, '{r.pattern}', '[REDACTED]', 'g')"
    return column


def sql_mask(column: str, pattern: str) -> str:
    return f"""array_to_string(list_transform(list_zip(regexp_split_to_array({column}, '{pattern}'), regexp_extract_all({column}, '{pattern}')),
      lambda z: concat(z[1], repeat('X', coalesce(length(z[2]), 0)::int))), '')"""


# -- replacing and masking -------------------------------------------------------------------------------
for _name, _rule in (("redact_email", EMAIL), ("redact_ip", IP), ("redact_phone", PHONE), ("redact_card", CARD), ("redact_token", TOKEN)):

    @register(_name, f"select doc_id, {sql_replace('text', [_rule])} as text from documents")
    def _one(spark: SparkSession, sf_dir: str, rule=_rule) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", detect.replace(F.col("text"), [rule]).alias("text"))


@register("redact_all", f"select doc_id, {sql_replace('text')} as text from documents")
def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", detect.replace(F.col("text")).alias("text"))


@register("redact_once", f"select doc_id, regexp_replace(text, '{detect.any_of(DEFAULT_RULES)}', '[REDACTED]', 'g') as text from documents")
def redact_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", detect.replace_once(F.col("text")).alias("text"))


@register("mask_all", f"select doc_id, {sql_mask('text', detect.any_of(DEFAULT_RULES))} as text from documents")
def mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", detect.mask(F.col("text")).alias("text"))


def _given(start: int | None, end: int | None) -> Column:
    return F.array(F.struct(F.lit("PERSON").alias("entity_type"), F.lit(start).cast("int").alias("start"), F.lit(end).cast("int").alias("end")))


for _name, _a, _b, _sql in (
    ("mask_fixed_span", 7, 11, "left(text, 7) || repeat('X', greatest(least(11, length(text)) - 7, 0)::int) || substring(text, 12)"),
    ("mask_open_end", 5, None, "left(text, 5) || repeat('X', greatest(length(text) - 5, 0)::int)"),
    ("mask_open_start", None, 5, "repeat('X', least(5, length(text))::int) || substring(text, 6)"),
    ("mask_no_ends", None, None, "text"),
):

    @register(_name, f"select doc_id, {_sql} as text from documents")
    def _span(spark: SparkSession, sf_dir: str, a=_a, b=_b) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", detect.mask_spans(F.col("text"), _given(a, b)).alias("text"))


@register("deny_list_mask", f"select doc_id, {sql_mask('text', detect.any_of([EMAIL, PHONE]))} as text from documents")
def deny_list_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.allowed(detect.all_spans(F.col("text"), [EMAIL, IP, PHONE]), denied=("IP_ADDRESS",))
    return texts(spark, sf_dir).select("doc_id", detect.mask_spans(F.col("text"), found).alias("text"))


@register("chain_two_providers", f"select doc_id, regexp_replace({sql_replace('text', [EMAIL])}, '\\[REDACTED\\]|{CARD.pattern}', '<gone>', 'g') as text from documents")
def chain_two_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = detect.replace(F.col("text"), [EMAIL])
    return texts(spark, sf_dir).select("doc_id", F.regexp_replace(first, rf"\[REDACTED\]|{CARD.pattern}", "<gone>").alias("text"))


@register("html_as_text", f"select page_id, {sql_replace('html')} as html from pages")
def html_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", detect.replace(F.col("html")).alias("html"))


@register("chat_redact", f"select conv_id, turn, role, {sql_replace('text')} as text from conversations")
def chat_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", detect.replace(F.col("text")).alias("text"))


@register("column_redact", "select c_custkey, regexp_replace(c_name, '#[0-9]+', '[REDACTED]', 'g') as c_name, c_nationkey, c_acctbal, regexp_replace(c_mktsegment, '#[0-9]+', '[REDACTED]', 'g') as c_mktsegment from customer")
def column_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_columns(table(spark, sf_dir, "customer"), rules=[detect.Rule("CUSTOMER_NUMBER", "#[0-9]+", contains="#")])


@register("json_as_text", "select event_id, regexp_replace(props, '[0-9]+', '[REDACTED]', 'g') as props from events")
def json_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", detect.replace(F.col("props"), [detect.Rule("NUMBER", "[0-9]+")]).alias("props"))


@register("sample_text", "select doc_id, left(text, 64) as text from documents")
def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", detect.sample(F.col("text"), 64).alias("text"))


@register("sample_then_redact", f"select doc_id, {sql_replace('left(text, 400)')} as text from documents")
def sample_then_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", detect.replace(detect.sample(F.col("text"), 400)).alias("text"))


# -- entities ------------------------------------------------------------------------------------------------
@register("entity_counts", "select " + ", ".join(f"sum(len(regexp_extract_all(text, '{r.pattern}')))::bigint as {r.entity.lower()}" for r in DEFAULT_RULES) + " from documents")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).agg(*[F.sum(detect.count_matches(F.col("text"), r)).alias(r.entity.lower()) for r in DEFAULT_RULES])


@register("entity_docs_by_lang", f"select lang, count(*) as docs, count(*) filter (where regexp_matches(text, '{detect.any_of(DEFAULT_RULES)}')) as affected from documents group by lang")
def entity_docs_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.lit(False)
    for r in DEFAULT_RULES:
        hit = hit | (r.may_match(F.col("text")) & F.col("text").rlike(r.pattern))
    return texts(spark, sf_dir, "lang").groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(hit).alias("affected"))


_SPAN_SQL = " union all ".join(
    f"""select doc_id, '{r.entity}' as entity_type, start_at as "start", start_at + hit as "end" from (
      select doc_id, length(m[i]) as hit, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0))::int as start_at
      from (select doc_id, regexp_split_to_array(text, '{r.pattern}') as g, regexp_extract_all(text, '{r.pattern}') as m from documents) t, unnest(range(1, len(m) + 1)) as u(i))"""
    for r in DEFAULT_RULES
)


@register("entity_spans", f'select doc_id, entity_type, "start"::bigint as "start", "end"::bigint as "end" from ({_SPAN_SQL})')
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).select("doc_id", F.explode(detect.all_spans(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.entity_type", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"))


@register("toxic_entities", f"select toxic, count(*) as docs, count(*) filter (where regexp_matches(text, '{detect.any_of(DEFAULT_RULES)}')) as affected from documents join labels using (doc_id) group by toxic")
def toxic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.lit(False)
    for r in DEFAULT_RULES:
        hit = hit | (r.may_match(F.col("text")) & F.col("text").rlike(r.pattern))
    marked = texts(spark, sf_dir).select("doc_id", hit.alias("hit"))
    return marked.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic").agg(F.count("*").alias("docs"), F.count_if(F.col("hit")).alias("affected"))


# -- files: inventory, plan, outcome -----------------------------------------------------------------------
def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """documents as files: source/doc_id.ext of n_chars bytes, the extension by doc_id."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select(path.alias("relative_path"), media.guess(path).alias("media_type"), F.when(F.pmod("doc_id", F.lit(17)) != 0, F.col("n_chars")).alias("file_size"), *columns)


_TYPES = " ".join(f"when '{e}' then '{media.BY_EXTENSION[e]}'" for e in EXTENSIONS)
_FILES = f"""files as (select source || '/' || doc_id || '.' || {_SQL_EXT}[doc_id % {len(EXTENSIONS)} + 1] as relative_path,
  case {_SQL_EXT}[doc_id % {len(EXTENSIONS)} + 1] {_TYPES} end as media_type, case when doc_id % 17 <> 0 then n_chars end as file_size from documents)"""
_VERDICT = "case when file_size > 2000 then 'SkippedDueToSize' when not regexp_full_match(relative_path, 'src1.*\\.(txt|md|csv|png|pdf)') then 'SkippedDueToName' else 'Matched' end"
_GLOB = "src1*.{txt,md,csv,png,pdf}"
_TEXT = f"coalesce(regexp_matches(media_type, '{media.TEXT_PATTERN}'), false)"


@register("inventory", f"with {_FILES} select * from files")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir)


@register("inventory_size_filter", f"with {_FILES} select * from files where file_size is null or file_size <= 1000")
def inventory_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(planning.verdict(F.col("relative_path"), F.col("file_size"), max_size=1000) == "Matched")


@register("inventory_glob", f"with {_FILES} select * from files where regexp_full_match(relative_path, 'src[12]/.*[12]\\.[a-z]..*')")
def inventory_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(media.matches_glob(F.col("relative_path"), "src[12]/*[12].[a-z]?*"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("verdict", planning.verdict(F.col("relative_path"), F.col("file_size"), 2000, _GLOB))


@register("inventory_verdict", f"with {_FILES} select *, {_VERDICT} as verdict from files")
def inventory_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)


@register("filename_of", f"with {_FILES} select relative_path, split_part(relative_path, '/', 2) as filename from files")
def filename_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("relative_path", media.filename(F.col("relative_path")).alias("filename"))


@register("mime_override_first_wins", f"with {_FILES} select relative_path, media_type, case when relative_path like '%.md' then 'text/plain' when relative_path like 'src1/%' then 'text/html' else media_type end as effective_media_type from files")
def mime_override_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [media.parse_override(x) for x in ("text/plain=*.md", "text/html=src1/*", "text/css=*.md")]
    return files(spark, sf_dir).select("relative_path", "media_type", media.override(F.col("relative_path"), F.col("media_type"), rules).alias("effective_media_type"))


_CLASS = f"case when {_TEXT} then 'text' when media_type = 'text/csv' then 'table' when media_type like 'image/%' then 'image' when media_type = 'application/pdf' then 'pdf' end"


@register("mime_class", f"with {_FILES} select relative_path, {_CLASS} as media_class from files")
def mime_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("relative_path", media.media_class(F.col("media_type")).alias("media_class"))


_NATIVE = {
    "gcp-dlp": f"{_TEXT} or media_type = 'text/csv' or media_type in {media.DLP_IMAGES}",
    "aws-comprehend": _TEXT,
    **{p: f"{_TEXT} or media_type like 'image/%'" for p in ("ms-presidio", "gemini-llm", "open-ai-llm", "gcp-vertex-ai")},
    "rules": f"{_TEXT} or media_type = 'text/csv'",
}


@register("support_matrix", f"with {_FILES} " + " union all ".join(f"select media_type, '{p}' as provider, coalesce({c}, false) as supported, count(*) as files from files group by all" for p, c in _NATIVE.items()))
def support_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = files(spark, sf_dir).groupBy("media_type").agg(F.count("*").alias("files"))
    rows = F.array(*[F.struct(F.lit(n).alias("provider"), F.coalesce(p.supports(F.col("media_type")), F.lit(False)).alias("supported")) for n, p in PROVIDERS.items()])
    return kinds.select("media_type", "files", F.explode(rows).alias("r")).select("media_type", "r.provider", "r.supported", "files")


def _plan_sql(native: list[str], conversions: list[tuple[str, str, str]]) -> str:
    """native: providers in order; conversions: (condition, providers, flags) tried if none is native."""
    names = " || ".join(f"case when coalesce({_NATIVE[p]}, false) then '{p},' else '' end" for p in native)
    whens = " ".join(f"when {c} then '{p}'" for c, p, _ in conversions)
    flags = " ".join(f"when native = '' and {c} then '{f}'" for c, _, f in conversions)
    return f"""with {_FILES}, n as (select relative_path, media_type, {names} as native from files)
      select relative_path, case when native <> '' then rtrim(native, ',') {whens} else '' end as providers, case {flags} else '' end as conversion from n"""


def _plan(spark: SparkSession, sf_dir: str, names: list[str], pdf: bool, ocr: bool) -> DataFrame:
    plan = planning.redact_plan(F.col("media_type"), [PROVIDERS[n] for n in names], pdf, ocr)
    flags = F.concat_ws("+", *[F.when(F.col(f"p.{f}"), F.lit(n)) for f, n in (("apply_pdf", "pdf"), ("apply_ocr", "ocr"), ("table_as_text", "table_as_text"))])
    return files(spark, sf_dir).select("relative_path", plan.alias("p")).select("relative_path", F.array_join("p.providers", ",").alias("providers"), flags.alias("conversion"))


_CSV, _PDF, _IMG = "media_type = 'text/csv'", "media_type = 'application/pdf'", "media_type like 'image/%'"
_BOTH = "aws-comprehend,ms-presidio"


@register("redact_plan", _plan_sql(["aws-comprehend", "ms-presidio"], [(_CSV, _BOTH, "table_as_text"), (_PDF, "ms-presidio", "pdf"), (_IMG, _BOTH, "ocr")]))
def redact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, ["aws-comprehend", "ms-presidio"], True, True)


@register("plan_native_first", _plan_sql(["gcp-dlp", "aws-comprehend"], [(_PDF, "gcp-dlp", "pdf"), (_IMG, "gcp-dlp,aws-comprehend", "ocr")]))
def plan_native_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, ["gcp-dlp", "aws-comprehend"], True, True)


@register("plan_text_ocr", _plan_sql(["aws-comprehend"], [(_CSV, "aws-comprehend", "table_as_text"), (_PDF, "aws-comprehend", "pdf+ocr"), (_IMG, "aws-comprehend", "ocr")]))
def plan_text_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, ["aws-comprehend"], True, True)


@register("plan_no_ocr", _plan_sql(["aws-comprehend"], [(_CSV, "aws-comprehend", "table_as_text")]))
def plan_no_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, ["aws-comprehend"], True, False)


@register("plan_no_pdf", _plan_sql(["aws-comprehend"], [(_CSV, "aws-comprehend", "table_as_text"), (_IMG, "aws-comprehend", "ocr")]))
def plan_no_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, ["aws-comprehend"], False, True)


_OUTCOME = f"case when v <> 'Matched' then 'Skipped' when bad and native then 'Skipped' when native then 'Redacted' else 'Copied' end"
_OUT = f"with {_FILES}, o as (select relative_path, file_size, {_VERDICT} as v, coalesce({_NATIVE['rules']}, false) as native, coalesce(file_size % 10 = 0, false) as bad from files), done as (select relative_path, {_OUTCOME} as outcome from o)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the files; a size that ends in 0 stands for content that can't be read."""
    plan = planning.redact_plan(F.col("media_type"), [PROVIDERS["rules"]])
    planned = judged(spark, sf_dir).withColumn("n_passes", F.size(plan["providers"]))
    error = F.when((F.col("file_size") % 10 == 0) & (F.col("n_passes") > 0), "unreadable")
    return planned.select("relative_path", planning.outcome(F.col("verdict"), True, F.col("n_passes"), error, allow_unsupported=True).alias("outcome"))


@register("outcome_per_file", f"{_OUT} select * from done")
def outcome_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


@register("run_counters", f"{_OUT} select count(*) filter (where outcome in ('Copied', 'Redacted')) as files_copied, count(*) filter (where outcome = 'Redacted') as files_redacted, count(*) filter (where outcome = 'Skipped') as files_skipped from done")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.run_counters(outcomes(spark, sf_dir))


@register("listing_totals", f"with {_FILES}, j as (select *, {_VERDICT} as verdict from files) select count(*) filter (where verdict = 'Matched') as files_found, coalesce(sum(coalesce(file_size, 0)) filter (where verdict = 'Matched'), 0)::bigint as total_size, count(*) filter (where verdict <> 'Matched') as files_skipped, coalesce(max(length(relative_path)) filter (where verdict = 'Matched'), 0)::bigint as longest_name from j")
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.listing_totals(judged(spark, sf_dir))


@register("top_k_files", f"with {_FILES} select * from files order by relative_path limit 25")
def top_k_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_files(files(spark, sf_dir), 25)


@register("info_type_union", "select item_id, list_sort(list_distinct(list_concat([" + ",".join(f"'{x}'" for x in detect.BUILT_IN_INFO_TYPES) + "], ['AGE', 'CUSTOM_' || item_id])))::varchar as info_types from benchmark")
def info_type_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = detect.info_types(F.array(F.lit("AGE"), F.concat(F.lit("CUSTOM_"), F.col("item_id").cast("string"))))
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("["), F.array_join(types, ", "), F.lit("]")).alias("info_types"))


# -- contents: tables, files, archives ----------------------------------------------------------------------
def _quoted(text: Column) -> Column:
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _sql_csv(text: str) -> str:
    """A CSV file of a header line and one row."""
    return f"""'doc_id,text' || chr(10) || doc_id || ',' || case when regexp_matches({text}, '[",\\n\\r]') then '"' || replace({text}, '"', '""') || '"' else {text} end || chr(10)"""


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a CSV file of one row."""
    said = F.coalesce("text", F.lit(""))
    content = F.concat(F.lit("doc_id,text\n"), F.col("doc_id").cast("string"), F.lit(","), _quoted(said), F.lit("\n"))
    return texts(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".csv")).alias("relative_path"), F.encode(content, "UTF-8").alias("content"))


def _cells(parsed: DataFrame) -> DataFrame:
    row = F.element_at("rows", 1)
    return parsed.select(F.element_at(row, 1).cast("bigint").alias("doc_id"), F.element_at(row, 2).alias("text"))


_SAID = "coalesce(text, '')"


@register("csv_redact", f"select doc_id, {sql_replace(_SAID)} as text from documents")
def csv_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(RuleDetector().redact_tables(read_tables(csv_files(spark, sf_dir))))


@register("csv_mask", f"select doc_id, {sql_mask(_SAID, detect.any_of(DEFAULT_RULES))} as text from documents")
def csv_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(RuleDetector(mode="mask").redact_tables(read_tables(csv_files(spark, sf_dir))))


_CHAINED = sql_mask(sql_replace(_SAID, [EMAIL]), detect.any_of([CARD, PHONE]))


@register("csv_chain", f"select doc_id, sha256({_sql_csv('said')}) as content_sha256 from (select doc_id, {_CHAINED} as said from documents)")
def csv_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors in turn, of different modes; the written files' digests."""
    parsed = read_tables(csv_files(spark, sf_dir))
    for d in (RuleDetector([EMAIL]), RuleDetector([CARD, PHONE, IP], mode="mask", denied=("IP_ADDRESS",))):
        parsed = d.redact_tables(parsed)
    written = write_tables(parsed)
    return written.select(F.substring_index("relative_path", ".", 1).cast("bigint").alias("doc_id"), F.sha2("content", 256).alias("content_sha256"))


_SHA = "sha256({})"
_RULED = sql_replace(_SAID)


@register("copy_documents", f"""with {_FILES.replace("from documents)", ", doc_id, text from documents)")},
  made as (select relative_path, {_TEXT} as is_text, coalesce(media_type = 'text/csv', false) as is_table, doc_id, {_SAID} as plain, {_RULED} as said from files)
  select relative_path, case when (is_text and doc_id % 5 <> 0) or is_table then 'Redacted' else 'Skipped' end as outcome,
    case when is_text and doc_id % 5 <> 0 then {_SHA.format("said")} when is_table then {_SHA.format(_sql_csv("said"))} end as content_sha256,
    case when is_text and doc_id % 5 = 0 then 'content is not UTF-8' end as error,
    case when (is_text and doc_id % 5 <> 0) or is_table then 1 else 0 end::int as n_passes from made""")
def copy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of all types through the whole chain of a copy: each fifth one's bytes aren't UTF-8, .csv
    files are CSV, and types that rules don't take are skipped."""
    said = F.coalesce("text", F.lit(""))
    csv = F.concat(F.lit("doc_id,text\n"), F.col("doc_id").cast("string"), F.lit(","), _quoted(said), F.lit("\n"))
    is_csv = F.col("media_type") == "text/csv"
    broken = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))
    content = F.when(F.coalesce(is_csv, F.lit(False)), F.encode(csv, "UTF-8")).otherwise(F.concat(F.encode(said, "UTF-8"), broken))
    made = files(spark, sf_dir, "doc_id", "text").withColumn("content", content).drop("doc_id", "text")
    done = redact_files(with_verdict(made), CopyOptions(detectors=[RuleDetector()]))
    return done.select("relative_path", "outcome", F.sha2("content", 256).alias("content_sha256"), "error", "n_passes")


@register("strict_text", f"select doc_id, case when doc_id % 3 <> 0 then {_SAID} end as text, case when doc_id % 3 = 0 then 'content is not UTF-8' end as error from documents")
def strict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    broken = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    text, error = decode_text(broken)
    return texts(spark, sf_dir).select("doc_id", text.alias("text"), error.alias("error"))


def _as_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files(spark, sf_dir, "text")
    return made.select("relative_path", "media_type", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit("Copied").alias("outcome"))


_BACK = f"""with {_FILES.replace("from documents)", ", text from documents)")} select relative_path, media_type, strlen({_SAID})::bigint as file_size, sha256({_SAID}) as content_sha256 from files"""


@register("file_round_trip", _BACK)
def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files under the shared folder, then listed and read back."""
    root = shared_path(spark, "files") + "/"
    write_files(_as_copied(spark, sf_dir), root).count()
    found = scan(spark, root.removeprefix("file://"), content=True)
    return found.select("relative_path", "media_type", "file_size", F.sha2("content", 256).alias("content_sha256"))


@register("zip_round_trip", _BACK)
def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an archive, which one writer makes."""
    path = shared_path(spark, "all.zip").removeprefix("file://")
    write_zip(_as_copied(spark, sf_dir), path)
    return read_zip(spark, path).select("relative_path", "media_type", "file_size", F.sha2("content", 256).alias("content_sha256"))


@register("pdf_pages", "select item_id, string_agg(1 + strlen(w) % 40, ',' order by k) as widths from (select item_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as k from benchmark) group by item_id")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split into pages, carried as PNG rows, merged in order; a stand-in for a renderer makes a page of each word."""
    split = lambda data: [Page(np.zeros((2, 1 + len(w) % 40, 3), np.uint8), 1.0, 1.0) for w in data.split(b" ")]
    merge = lambda pages: ",".join(str(p.pixels.shape[1]) for p in pages).encode()
    able = replace(installed(), split_pdf=split, merge_pdf=merge)
    papers = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("relative_path"), F.encode("text", "UTF-8").alias("content"))
    pages = pictures.split_pages(papers, able).repartition(4)
    merged = pictures.merge_pages(pages, able)
    return merged.select(F.col("relative_path").cast("bigint").alias("item_id"), F.col("content").cast("string").alias("widths"))


# -- OCR and images ----------------------------------------------------------------------------------------
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as recognised pages: a row a character, lines as in the text."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "said")).filter("said <> ''")
    chars = lines.select("page", "line", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("said")), lambda k: F.substring("said", k, F.lit(1)))).alias("pos", "char"))
    x, y = F.col("pos").cast("float"), F.col("line").cast("float")
    return chars.withColumns({"x1": x * 10, "y1": y * 20, "x2": x * 10 + 9, "y2": y * 20 + 18})


_OCR_SQL = """
with lines as (select item_id as page, i - 1 as line, string_split(text, chr(10))[i] as said from benchmark, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)),
words as (select page, line, k - 1 as word, string_split(said, ' ')[k] as text, (length(array_to_string(string_split(said, ' ')[:k-1], ' ')) + case when k > 1 then 1 else 0 end) as col
  from lines, unnest(range(1, len(string_split(said, ' ')) + 1)) as v(k) where said <> '')
select page, line::bigint as line, word::bigint as word, text, (col * 10)::double as x1, (line * 20)::double as y1, ((col + length(text) - 1) * 10 + 9)::double as x2, (line * 20 + 18)::double as y2 from words
"""


@register("ocr_words", _OCR_SQL)
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = images.ocr_words(characters(spark, sf_dir))
    return words.select("page", F.col("line").cast("bigint").alias("line"), F.col("word").cast("bigint").alias("word"), "text", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])


@register("ocr_diff_boxes", "select doc_id, len(list_filter(string_split(text, ' '), lambda w: not list_contains(string_split(" + sql_replace("text", [EMAIL, IP, CARD]) + ", ' '), w)))::bigint as gone from documents")
def ocr_diff_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("float")
    boxes = F.transform(F.split("text", " "), lambda w: F.struct(zero.alias("x1"), zero.alias("y1"), zero.alias("x2"), zero.alias("y2"), w.alias("text")))
    redacted = detect.replace(F.col("text"), [EMAIL, IP, CARD])
    # an unchanged text loses no word: the look-up is spared
    gone = detect.let(redacted, lambda r: F.when(r == F.col("text"), 0).otherwise(F.size(images.gone_words(boxes, r))))
    return texts(spark, sf_dir).select("doc_id", gone.cast("bigint").alias("gone"))


@register("ocr_anti_join", f"""with w as (select doc_id as page, unnest(string_split(text, ' ')) as text from documents),
  r as (select doc_id as page, unnest(string_split({sql_replace('text', [EMAIL, IP, CARD])}, ' ')) as text from documents)
  select page, text, count(*) as n from w where not exists (select 1 from r where r.page = w.page and r.text = w.text) group by page, text""")
def ocr_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = texts(spark, sf_dir).withColumn("redacted", detect.replace(F.col("text"), [EMAIL, IP, CARD])).filter("redacted <> text")
    words = changed.select(F.col("doc_id").alias("page"), F.explode(F.split("text", " ")).alias("text"))
    kept = changed.select(F.col("doc_id").alias("page"), F.explode(F.split("redacted", " ")).alias("text"))
    return images.gone_words_join(words, kept).groupBy("page", "text").agg(F.count("*").alias("n"))


@register("box_pixel_range", "select vec_id, greatest(trunc(a - a * 0.25::float), 0)::int as low, greatest(trunc(b + b * 0.25::float), 0)::int as high from (select vec_id, (embedding[1] * 1000::float)::float as a, (embedding[2] * 1000::float)::float as b from embeddings)")
def box_pixel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: (F.element_at("embedding", k) * F.lit(1000).cast("float")).cast("float")
    low, high = images.pixel_range(side(1), side(2), 0.25)
    return table(spark, sf_dir, "embeddings").select("vec_id", low.alias("low"), high.alias("high"))


@register("boxes_from_answer", "select vec_id, len(embedding)::bigint as n, embedding[1]::varchar is not null as whole from embeddings")
def boxes_from_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    answer = F.to_json(F.transform("embedding", lambda v: F.struct(v.alias("x1"), v.alias("y1"), v.alias("x2"), v.alias("y2"))))
    boxes = boxes_from_json(answer)
    return vecs.select("vec_id", F.size(boxes).cast("bigint").alias("n"), boxes.isNotNull().alias("whole"))


# -- throttling --------------------------------------------------------------------------------------------
_LIMIT = throttle.parse_limit("15rpm")
_THROTTLE_SQL = f"""
with recursive r as (select user_id, event_id, epoch_ms(ts) as now, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (
  select user_id, event_id, k, now, now as arrived, {_LIMIT.capacity - 1}::bigint as cap, 0::bigint as delay_ms from r where k = 1
  union all
  select r.user_id, r.event_id, r.k, r.now, s.arrived + greatest(r.now - s.arrived, 0) // {_LIMIT.interval_ms} * {_LIMIT.interval_ms},
    least(s.cap + greatest(r.now - s.arrived, 0) // {_LIMIT.interval_ms}, {_LIMIT.capacity}) - 1,
    case when least(s.cap + greatest(r.now - s.arrived, 0) // {_LIMIT.interval_ms}, {_LIMIT.capacity}) > 0 then 0
      else greatest({_LIMIT.interval_ms} - (r.now - s.now), 0) + {_LIMIT.interval_ms} * abs(s.cap) // {_LIMIT.capacity} end
  from s join r on r.user_id = s.user_id and r.k = s.k + 1)
select user_id, event_id, delay_ms from s
"""


@register("throttle_delays", _THROTTLE_SQL)
def throttle_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket for each user over all the user's events."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now"), "event_id")
    return throttle.stream_delays(events, "user_id", "now", "event_id", _LIMIT)
