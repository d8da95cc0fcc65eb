"""Token counts with a digest cache, and the word-wise encoder that the packing operator shares.

Counts are kept in a table (digest, tokenizer, n_tokens). Documents are joined to it by the SHA-256 of
their normalised content and the tokenizer's version digest; only distinct contents that are absent are
encoded, once each, and appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import block_count, give_back, ragged, slices, stage_path, stage_table, text_buffer, worker_slot

#: A pre-tokenizer of this form matches no white space and drops what it doesn't match.
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words that the pre-tokenizer is followed on here, not in the library: of visible ASCII and of letters that no Unicode version,
#: composition or case folding treats apart, and the parts it cuts them into.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z{_LATIN}]+|[0-9]|[^A-Za-z0-9{_LATIN}]+")
#: Words whose ids a worker remembers; beyond that only those met in two batches at least stay, so memory is bounded.
MEMO_WORDS = 300_000
#: Words whose ids are put together at a time; a longer text's at once.
RUN_WORDS = 1 << 16
#: Bytes of documents whose distinct digests one task remembers.
DIGEST_BYTES = 64 << 20


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: another file or another version never meets the same cache rows."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def word_wise(path: str) -> bool:
    """Whether text may be cut at ASCII white space without changing its ids.

    True only for the known form: NFC, white space to blanks and lower case as normalizers, a Split that
    drops white space, BPE without dropout, no post-processor that matters and special tokens without
    blanks or stripping. Each of these acts within a run of non-white characters.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        return _word_wise(json.load(f))


def _word_wise(spec: dict) -> bool:
    norm = spec.get("normalizer") or {}
    parts = norm.get("normalizers", [norm]) if norm else []
    pre = spec.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0] if pre else {}
    return (
        {p.get("type") for p in parts} <= {"NFC", "Replace", "Lowercase"}
        and all(p.get("pattern") == {"Regex": "\\s+"} and p.get("content") == " " for p in parts if p.get("type") == "Replace")
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": _WORD_PATTERN}
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and spec["model"].get("type") == "BPE"
        and not spec["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )


def _by_part(spec: dict) -> bool:
    """Whether a word's ids are those that the model gives its _PARTS, one after another, as visible characters for bytes."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return len(parts) == 2 and parts[1].get("type") == "ByteLevel" and parts[1].get("add_prefix_space") is False and parts[1].get("use_regex") is False and spec.get("post_processor") is None


def _visible_bytes() -> list[str]:
    """The character by which a ByteLevel pre-tokenizer shows each byte: itself where it is visible, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict(zip(seen, map(chr, seen)))
    for b in range(256):
        shown.setdefault(b, chr(0x100 + len(shown) - len(seen)))
    return [shown[b] for b in range(256)]


class Encoder:
    """Ids of whole texts as the library gives them, without added special tokens.

    Where word_wise() holds, a batch is cut into words in Arrow, dictionary-encoded, and only words not
    met before go to the library; all else goes there whole. Of a word not met before that is _PLAIN,
    the library's model alone gets the parts: the way there and back costs more than the merging.
    """

    def __init__(self, path: str, word_path: bool | None = None):
        self.path = path
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
            self.special = sorted({t["content"][:2] for t in spec.get("added_tokens", [])})
        known = not self.sentencepiece and _word_wise(spec)
        self.by_word = known if word_path is None else word_path
        self.by_part = self.by_word and known and _by_part(spec)
        self.shown = _visible_bytes()
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[bytes, int] = {b"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)
        self.n_flat = 0
        self.met = np.zeros(1 << 14, np.uint8)

    def rest(self) -> None:
        """Forget all words when a task ends: workers that wait hold memory beside those that work, and an operator that
        ran before may have left more workers than there are cores."""
        self._reset()
        give_back()

    def _prune(self) -> None:
        keep = np.flatnonzero(self.met[: len(self.memo)] > 1)
        if not 0 < len(keep) < MEMO_WORDS // 2:
            self._reset()
            return
        wanted = np.zeros(len(self.memo), bool)
        wanted[keep] = wanted[0] = True
        kept = np.flatnonzero(wanted)
        number = np.cumsum(wanted) - 1
        memo = {w: int(number[k]) for w, k in self.memo.items() if wanted[k]}
        flat, lens = self.flat[ragged(self.starts[kept], self.lens[kept])], self.lens[kept]
        self._reset()
        self.memo, self.flat, self.n_flat = memo, flat, len(flat)
        self.starts, self.lens, self.met = np.cumsum(lens) - lens, lens, np.ones(len(kept), np.uint8)

    def _library(self, texts: list[str]) -> list[list[int]]:
        if self.sentencepiece:
            return self.lib.encode(texts, num_threads=1) if texts else []
        return [e.ids for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of words without ASCII white space. A text that holds an added token isn't cut into words."""
        texts = [w.decode() for w in words]
        flat: list[int] = []  # one list: the garbage collector walks every list that a word would get
        lens: list[int] = []
        plain = _PLAIN.fullmatch if self.by_part else lambda text: None
        others = iter(self._library([t for t in texts if not plain(t)]))
        model, shown, parts = None if self.sentencepiece else self.lib.model.tokenize, self.shown, _PARTS.findall
        of_part: dict[str, tuple[int, ...]] = {}
        for text in texts:
            before = len(flat)
            if plain(text):
                for part in parts(text.lower() if self.lower else text):
                    ids = of_part.get(part)
                    if ids is None:
                        ids = of_part[part] = tuple([t.id for t in model(part if part.isascii() else "".join([shown[b] for b in part.encode()]))])
                    flat += ids
            else:
                flat += next(others)
            lens.append(len(flat) - before)
        return np.array(lens, np.int64), np.array(flat, np.uint32)

    def _lookup(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            self._prune()
            memo = self.memo
        found = list(map(memo.get, words))
        missing = [w for w, k in zip(words, found) if k is None]
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            lens, flat = self._word_ids(part)
            first, n = len(memo), len(part)
            while first + n > len(self.starts):
                self.starts, self.lens, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.met))
            while self.n_flat + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.n_flat : self.n_flat + len(flat)] = flat
            self.starts[first : first + n] = self.n_flat + np.cumsum(lens) - lens
            self.lens[first : first + n] = lens
            self.n_flat += len(flat)
            memo.update(zip(part, range(first, first + n)))
        if missing:
            found = list(map(memo.__getitem__, words))
        index = np.fromiter(found, np.int64, len(found))
        self.met[index] = np.minimum(self.met[index], 1) + 1  # a batch asks for a word once
        return index

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Memo index of every word, and the words' offsets by text."""
        if self.lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        data, ends = text_buffer(words.dictionary)
        raw, ends = data.tobytes(), ends.tolist()
        index = self._lookup([raw[a:b] for a, b in zip(ends, ends[1:])])
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))]).astype(np.int64)
        return index[np.asarray(words.indices, np.int64)] if len(words) else np.zeros(0, np.int64), offsets

    def _special_rows(self, texts: pa.Array) -> np.ndarray:
        hit = np.zeros(len(texts), bool)
        for s in self.special:
            hit |= np.asarray(pc.match_substring(texts, s).fill_null(False))
        return np.flatnonzero(hit)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; nulls count as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return np.fromiter(map(len, self._library(texts.to_pylist())), np.int64, len(texts))
        index, offsets = self._words(texts)
        sums = np.concatenate([[0], np.cumsum(self.lens[index])])
        n = (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)
        rows = self._special_rows(texts)
        if len(rows):
            n[rows] = [len(x) for x in self._library(texts.take(pa.array(rows)).to_pylist())]
        return n

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each text; nulls count as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            for one in self._library(texts.to_pylist()):
                yield np.array(one, np.uint32)
            return
        index, offsets = self._words(texts)
        special = set(self._special_rows(texts).tolist())
        a = 0
        while a < len(texts):  # some words at a time: what leads to their ids is many times larger
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + RUN_WORDS, "right")) - 1)
            run = index[offsets[a] : offsets[b]]
            lens = self.lens[run]
            flat = self.flat[ragged(self.starts[run], lens)]
            sums = np.concatenate([[0], np.cumsum(lens)])[offsets[a : b + 1] - offsets[a]].tolist()
            for k in range(a, b):
                yield np.array(self._library([texts[k].as_py()])[0], np.uint32) if k in special else flat[sums[k - a] : sums[k - a + 1]]
            a = b


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; its memo outlives a task."""
    return worker_slot(("encoder", path), lambda: Encoder(path))


def content_digest(text: Column) -> Column:
    """Digest of the content that is counted. Null counts as empty; nothing else is folded, since a
    tokenizer may tell any two other texts apart."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _first_of_each(batches):
    """Drop repeats of a digest inside one task, before the shuffle: a hot text travels once a task."""
    seen: set[str] = set()
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        keep = np.zeros(len(digests), bool)
        for k, d in enumerate(digests):
            if d not in seen:
                seen.add(d)
                keep[k] = True
        if keep.any():
            yield batch.filter(pa.array(keep))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (columns doc_id and text; others are ignored).

    Null and empty text: 0 bytes, 0 tokens. Repeated rows, and repeated or null doc_id, give a row each. No
    rows in, no rows out. cache_path: a folder of runs, each a Parquet folder of (digest, tokenizer, n_tokens), that is
    read and added to; a fresh one in the shared folder if None. A run is written aside and renamed when complete, so
    runs at the same time don't meet; a digest that two of them add is read as one.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or stage_path(spark, "token-counts")
    schema = "digest string, tokenizer string, n_tokens long"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(cache_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    exists = fs.exists(path(cache_path))
    cached = lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(cache_path).filter(F.col("tokenizer") == version)

    text = docs.select("doc_id", "text").withColumn("digest", content_digest(F.col("text")))

    def encode(batches):
        seen: set[str] = set()
        enc = encoder(tokenizer_path)
        for batch in slices(batches, "text"):
            digests = batch.column("digest").to_pylist()
            fresh = [k for k, d in enumerate(digests) if not (d in seen or seen.add(d))]
            if fresh:
                part = batch.take(pa.array(fresh))
                n = enc.counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * len(fresh)), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    contents = text.select("digest", "text").mapInArrow(_first_of_each, "digest string, text string")
    if exists:
        known = cached().select("digest").distinct()
        contents = contents.join(known, "digest", "left_anti")
    run = uuid.uuid4().hex
    contents.repartition(block_count(docs, "text", DIGEST_BYTES), "digest").mapInArrow(encode, schema).write.parquet(f"{cache_path}/_run-{run}")
    if not fs.rename(path(f"{cache_path}/_run-{run}"), path(f"{cache_path}/run-{run}")):
        raise OSError(f"can't commit the token counts of run {run}")

    counts = cached().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    keys = stage_table(text.select("doc_id", "digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "token-keys")
    return keys.join(counts, "digest", "left").select("doc_id", "n_bytes", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), (F.coalesce("n_tokens", F.lit(0)) > limit).alias("over_limit"))
