"""Stupid-backoff language-model scores from n-gram counts over all documents.

Relationally: the n-grams of the documents are grouped by hash bucket into count tables, each document block's
n-grams are joined to the counts in the same bucket, and the joined log scores are summed per document. A
block's n-grams travel once each, as packed arrays (umbra.llm.blocks), whatever their number of occurrences.

    S(w3 | w1 w2) = c(w1 w2 w3) / c(w1 w2)   if c(w1 w2 w3) >= min_count
                  = alpha * c(w2 w3) / c(w2) if c(w2 w3) >= min_count
                  = alpha^2 * c(w3) / N      otherwise

A document's second word starts at the second line and its first at the third, without the factors alpha of
lines that its place doesn't offer. Words are runs of other than ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.blocks import ASKED, Rolling, answers_in_order, asked_rows, counted, exchange, level0_parts, mix, packed_blocks, unpacked
from umbra.llm.common import shuffle_partitions, stage_table

#: Names keep 56 bits: among n distinct n-grams, a given one shares its name with a chance of n / 2^56.
_DROP = 8
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text whose n-grams are handled at a time.
RUN = 2 << 20
_TAGS = [np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD)]


def _word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' names, and the number of words before each document."""
    white = _WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~white
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], white[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([white[1:], [True]]))) + 1
    return Rolling(_LOWER[data]).names(starts, ends), np.searchsorted(starts, offsets)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Names of the 1-, 2- and 3-grams ending at each word (where too few words precede: the longest there is),
    the words' places in their documents, and the number of words before each document."""
    words, before = _word_names(data, offsets)
    place = np.arange(len(words)) - np.repeat(before[:-1], np.diff(before))
    keep = ~np.uint64((1 << _DROP) - 1)
    one = mix(words ^ _TAGS[0])
    two, three = one.copy(), one.copy()
    if len(words) > 1:
        pair = mix(mix(words[:-1] ^ _TAGS[1]) + words[1:])
        two[1:] = np.where(place[1:] > 0, pair, one[1:])
        three = two.copy()
        if len(words) > 2:
            triple = mix(mix(pair[:-1] ^ _TAGS[2]) + words[2:])
            three[2:] = np.where(place[2:] > 1, triple, two[2:])
    return [x & keep for x in (one, two, three)], place, before


def _sorted_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All n-grams of a run, ascending; shorter n-grams that stand in for longer ones are not counted twice."""
    grams, place, _ = _grams(data, offsets)
    joined = np.concatenate([grams[0], grams[1][place > 0], grams[2][place > 1]])
    joined.sort()
    return joined


def _first(s: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _names(table: pa.Table) -> np.ndarray:
    """A block's distinct n-grams."""
    parts = []
    for data, offsets, _, _ in unpacked(table, RUN):
        s = _sorted_grams(data, offsets)
        parts.append(s[_first(s)])
    joined = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    parts.clear()
    joined.sort()
    return joined[_first(joined)]


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams and their counts. Run by run, so that memory is bounded by the distinct ones."""
    names: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for data, offsets, _, _ in unpacked(table, RUN):
        s = _sorted_grams(data, offsets)
        first = _first(s)
        names.append(s[first])
        counts.append(np.diff(np.append(first, len(s))).astype(np.int32))
    if len(names) < 2:
        return (names[0], counts[0]) if names else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    joined, many = np.concatenate(names), np.concatenate(counts)
    names.clear(), counts.clear()
    order = np.argsort(joined)
    joined = joined[order]
    first = _first(joined)
    return joined[first], np.add.reduceat(many[order], first) if len(first) else many


def _find(names: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where each n-gram stands in names. Looked up in order: else every look-up is several cache misses."""
    order = np.argsort(grams)
    at = np.empty(len(grams), np.int32)
    at[order] = np.searchsorted(names, grams[order])
    return at


def lm_scores(docs: DataFrame, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, n_trigram, n_bigram, n_unigram, log_score, mean_log_score of every row of docs.

    docs: doc_id and text; others are ignored. Counts are over all rows, repeated ones included. n_trigram,
    n_bigram and n_unigram are the words scored by each line. Null text, and text without words: 0 words,
    log_score 0, mean_log_score null. Natural logarithms. No rows in, no rows out.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed, blocks = packed_blocks(cols, ["doc_id"])
    partitions = min(blocks, 4 * shuffle_partitions(docs.sparkSession))
    parts = level0_parts(blocks, partitions)
    kind = counted(_DROP, lambda total: total, np.int64)

    def ask_counts(table: pa.Table) -> pa.Table:
        return asked_rows(kind, _asked(table), 0, table["src"][0].as_py(), 0, parts)

    known = exchange(packed.groupBy("src").applyInArrow(ask_counts, ASKED), kind, blocks)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_trigram", "n_bigram", "n_unigram")), T.StructField("partial", T.DoubleType())])

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        names = _names(table)
        counts = answers_in_order(found, kind)
        often, logs = counts >= min_count, np.log(np.maximum(counts, 1))
        del counts
        for data, offsets, _, rows in unpacked(table, RUN) if table.num_rows else ():
            grams, place, before = _grams(data, offsets)
            one, two, three = (_find(names, g) for g in grams)
            tri = (place > 1) & often[three] if len(place) else np.zeros(0, bool)
            bi = ~tri & (place > 0) & often[two] if len(place) else np.zeros(0, bool)
            uni = ~tri & ~bi
            prev_one, prev_two = np.roll(one, 1), np.roll(two, 1)
            value = np.where(tri, logs[three] - logs[prev_two], np.where(bi, logs[two] - logs[prev_one], logs[one])) if len(place) else np.zeros(0)
            value = value + np.log(alpha) * np.where(tri, 0, np.where(bi, np.minimum(place - 1, 1).clip(0), np.minimum(place, 2)))

            def per(x, before=before):
                sums = np.concatenate([[0], np.cumsum(x)])
                return sums[before[1:]] - sums[before[:-1]]

            # summed document by document: a running sum over the run would lose digits
            partial = np.zeros(len(before) - 1)
            filled = np.flatnonzero(np.diff(before))
            if len(filled):
                partial[filled] = np.add.reduceat(value, before[:-1][filled])
            out.append(pa.table({"doc_id": rows.field("c0"), "n_words": pa.array(np.diff(before), pa.int64()), "n_trigram": pa.array(per(tri), pa.int64()), "n_bigram": pa.array(per(bi), pa.int64()), "n_unigram": pa.array(per(uni), pa.int64()), "partial": pa.array(partial)}))
        empty = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_trigram": pa.int64(), "n_bigram": pa.int64(), "n_unigram": pa.int64(), "partial": pa.float64()}
        return pa.concat_tables(out) if out else pa.schema(list(empty.items())).empty_table()

    sums = stage_table(packed.groupBy("src").cogroup(known.repartition(partitions, "src").groupBy("src")).applyInArrow(score, schema), "lm-sums")
    total = sums.agg(F.sum("n_words").alias("n")).first()["n"] or 1
    log_score = F.col("partial") - F.col("n_unigram") * F.lit(float(np.log(total)))
    return sums.select("doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"))
