"""The registered queries of the ten operators, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import stage_path, stage_table

CAPACITY = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"), errors=4, width=4)


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.llm.contamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), similarity=0.8)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.llm.embeddings import embedding_components

    return embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.95)


OP3_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
), fine as (
  select vec_id, e from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
), pairs as (
  select a.vec_id as a, b.vec_id as b from fine a join fine b on a.vec_id < b.vec_id and len(a.e) = len(b.e)
    and list_cosine_similarity(a.e, b.e) >= 0.95
), edges as (
  select a, b from pairs union all select b, a from pairs
), reach as (
  select a as node, b as other from edges
  union select r.node, e.b from reach r join edges e on r.other = e.a
), low as (
  select node, least(node, min(other)) as component_id from reach group by node
), degree as (select a as node, count(*) as n from edges group by a)
select v.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(l.component_id, v.vec_id) as component_id,
  v.vec_id = coalesce(l.component_id, v.vec_id) as kept
from v left join low l on l.node = v.vec_id left join degree d on d.node = v.vec_id
"""


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the counts of all documents, rounded to what both engines agree on."""
    from umbra.llm.ngram_lm import lm_scores

    scores = lm_scores(_table(spark, sf_dir, "documents"), alpha=0.4, min_count=2)
    return scores.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


OP4_SQL = r"""
with words as (
  select doc_id, row_id, unnest(w) as w, generate_subscripts(w, 1) as i from (
    select doc_id, doc_id as row_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w
    from documents)
), grams as (
  select row_id, i, w as w3, lag(w) over d as w2, lag(w, 2) over d as w1
  from words window d as (partition by row_id order by i)
), c1 as (select w3, count(*) as n from grams group by w3),
c2 as (select w2, w3, count(*) as n from grams where w2 is not null group by w2, w3),
c3 as (select w1, w2, w3, count(*) as n from grams where w1 is not null group by w1, w2, w3),
total as (select count(*) as n from grams),
scored as (
  select g.row_id,
    case when c3.n >= 2 then 3 when c2.n >= 2 then 2 else 1 end as line,
    case when c3.n >= 2 then ln(c3.n::double / x2.n)
      when c2.n >= 2 then ln(c2.n::double / x1.n) + case when g.i > 2 then ln(0.4::double) else 0 end
      else ln(c1.n::double / total.n) + least(g.i - 1, 2) * ln(0.4::double) end as s
  from grams g cross join total
  join c1 on c1.w3 = g.w3
  left join c2 on c2.w2 = g.w2 and c2.w3 = g.w3
  left join c3 on c3.w1 = g.w1 and c3.w2 = g.w2 and c3.w3 = g.w3
  left join c1 x1 on x1.w3 = g.w2
  left join c2 x2 on x2.w2 = g.w1 and x2.w3 = g.w2
), sums as (
  select row_id, count(*) as n, count(*) filter (where line = 3) as n3, count(*) filter (where line = 2) as n2,
    count(*) filter (where line = 1) as n1, sum(s) as s from scored group by row_id
), docs as (select doc_id, doc_id as row_id from documents)
select d.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(n3, 0)::bigint as n_trigram, coalesce(n2, 0)::bigint as n_bigram,
  coalesce(n1, 0)::bigint as n_unigram, round(coalesce(s, 0), 4) as log_score, round(s / n, 6) as mean_log_score
from docs d left join sums using (row_id)
"""


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.llm.substrings import substring_removals

    return substring_removals(_table(spark, sf_dir, "documents"), length=200)


OP5_SQL = """
with b as (
  select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as data from documents
), windows as (
  select rid, p, data[p:p+199] as s from (select rid, data, unnest(range(1, octet_length(data) - 198)) as p from b where octet_length(data) >= 200)
), again as (
  select s from windows group by s having count(*) > 1
), hits as (
  select rid, p, lag(p) over (partition by rid order by p) as before from windows semi join again using (s)
), islands as (
  select rid, p, sum(case when before is null or p > before + 200 then 1 else 0 end) over (partition by rid order by p rows unbounded preceding) as island from hits
), spans as (
  select rid, island, min(p) as a, max(p) + 199 as z from islands group by rid, island
), gaps as (
  select rid, island, a, z, coalesce(lag(z) over (partition by rid order by island), 0) as prev from spans
), kept as (
  select rid, count(*) as n_spans, sum(z - a + 1) as n_removed, max(z) as last, string_agg(hex(data[prev+1:a-1]), '' order by island) as head
  from gaps join b using (rid) group by rid
)
select doc_id, octet_length(data)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(case when kept.rid is null then data else unhex(head || hex(data[last+1:octet_length(data)])) end) as kept_sha256
from b left join kept using (rid)
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, parsed back from the formatted strings, digested."""
    from umbra.llm.chat import format_conversations, parse

    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("t")).select("t.*")

    def digest(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                read = parse(text)
                all_turns = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said, _, _ in read).encode())
                marked = {(s["start"], s["end"]) for s in spans}
                loss = "".join(said for _, said, a, b in read if (a, b) in marked)
                out.append((conv, len(read), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_conversations(turns.unionByName(own)).mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP6_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g'))
    + case when role = 'assistant' then 6 + 6
      else 6 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) + 2 + 9 end as chars
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.llm.tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.llm.langid import fit, held_out, predict_languages

    docs = _table(spark, sf_dir, "documents")
    found = predict_languages(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from umbra.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY, 1)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as four arrivals of unequal size (shares 1/2, 1/4, 1/8, 1/8 of the rows), each appended, then
    compacted to files of 128 MB; every row with its shard and the digest of the stored text."""
    from umbra.llm.sharding import ShardStore

    docs = _table(spark, sf_dir, "documents")
    store = ShardStore(spark, stage_path(spark, "shards"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for low, high in ((0, 4), (4, 6), (6, 7), (7, 8)):
        store.append(docs.filter((slot >= low) & (slot < high)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_shard").alias("shard"), F.col("_shard_bytes").alias("shard_bytes"), F.col("_shard_rows").alias("shard_rows"), F.col("_version").alias("version"))


QUERIES = {
    "op8_language": op8_language,
    "op2_contamination": op2_contamination,
    "op4_lm_scores": op4_lm_scores,
    "op5_substrings": op5_substrings,
    "op1_simhash": op1_simhash,
    "op3_embeddings": op3_embeddings,
    "op6_chat": op6_chat,
    "op7_token_counts": op7_token_counts,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}
ORACLE_SQL = {"op4_lm_scores": OP4_SQL, "op5_substrings": OP5_SQL, "op3_embeddings": OP3_SQL, "op6_chat": OP6_SQL}
