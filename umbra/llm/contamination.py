"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

Texts and items are sequences of words. For every item length m, each run of m words of a document is a window.
A CGK walk reads a window word by word: at step t it shows the word under its pointer, and a random bit of
(t, word) says whether the pointer moves on; edit distance becomes Hamming distance between the shown sequences.
A repetition samples a few steps of a walk, forwards from the window's start or backwards from its end; windows
and items that show the same words there are candidates. The repetitions of an item's length reach the target recall
(tests measure it against brute force). Candidates are verified by the exact word edit distance, of the
window or else, as d words inserted or deleted make a passage longer or shorter than m, of the best passage that
starts or ends within d words of it. Windows may stand out of a document by d words, since it can be shorter than m.

Two gates decide which windows are walked; with d edits allowed, neither loses the windows that start or end with a
passage within d of an item. They must hold at least m - d words of the benchmark's vocabulary, and share a run of q
consecutive words with an item, displaced by d words at most, where q = ceil((m - d) / (d + 1)): d edits leave m - d
words in d + 1 runs. Documents are scanned in whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.blocks import mix
from umbra.llm.common import ragged, slices, worker_slot

REPETITIONS = 16
SAMPLED_STEPS = 2
#: Items that one pass searches for; a larger benchmark is searched in as many passes as it takes.
PASS_ITEMS = 50_000
PASS_BYTES = 64 << 20
#: Words and words between documents that are searched at once, beyond which documents are searched in parts.
SEARCH_WORDS = 3 << 20
_PUNCTUATION = ".,;:!?\"'()[]{}|<>*_`~#-"


def normalized(texts: pa.Array) -> pa.Array:
    """Lists of words: A-Z lower-cased, cut at ASCII white space, punctuation around a word taken off."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
    words = lists.flatten().dictionary_encode()
    bare = pc.utf8_trim(words.dictionary, _PUNCTUATION)
    flat = bare.take(words.indices)
    keep = np.asarray(pc.not_equal(pc.binary_length(flat), 0), bool) if len(flat) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(keep)))


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each row of a from the same row of b; all rows of one length."""
    n, m = a.shape
    row = np.broadcast_to(np.arange(m + 1, dtype=np.int16), (n, m + 1)).copy()
    steps = np.arange(m + 1, dtype=np.int16)
    for k in range(m):
        new = np.empty_like(row)
        new[:, 0] = k + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, k : k + 1] != b))
        # insertions along the row: running minimum of value minus column
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, m]


def passage_distances(regions: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The least Levenshtein distance of each row of items from any run of words of the same row of regions."""
    n, m = items.shape
    steps = np.arange(m + 1, dtype=np.int16)
    row = np.broadcast_to(steps, (n, m + 1)).copy()
    best = row[:, m].copy()
    for k in range(regions.shape[1]):
        new = np.zeros_like(row)
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions[:, k : k + 1] != items))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, row[:, m])
    return best


def passage(region: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, words) of the run of words of region that is nearest to item; the first and shortest of them."""
    m = len(item)
    wide = len(region) + 1  # cost and start in one number: of equal costs the latest start
    steps = np.arange(m + 1, dtype=np.int64) * wide
    row = steps + len(region)
    best = (int(row[m]) // wide, 0, 0)
    for k, word in enumerate(region):
        new = np.empty_like(row)
        new[0] = len(region) - (k + 1)
        new[1:] = np.minimum(row[1:] + wide, row[:-1] + (item != word) * wide)
        row = np.minimum.accumulate(new - steps) + steps
        edits, start = divmod(int(row[m]), wide)
        start = len(region) - start
        if edits < best[0]:
            best = (edits, start, k + 1 - start)
    return best


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    """A hash of q words in a row; words has a row for each."""
    key = np.full(words.shape[1], np.uint64(q))
    for w in words:
        key = mix(key * np.uint64(3) + w)
    return key


def repetitions_for(m: int) -> int:
    """Repetitions for items of m words: walks of longer items agree in fewer of the sampled steps. Measured at the
    full budget of edits, this many find 0.99 of the passages (tests hold it for up to 300 words)."""
    return max(REPETITIONS, -(-m * 27 // 100))


class Searcher:
    """LSH tables of a benchmark's items and the search of documents in them."""

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float, min_words: int = 1, repetitions: int | None = None, sampled: int = SAMPLED_STEPS):
        self.vocabulary: dict[str, int] = {}
        by_length: dict[int, list] = {}
        for item, words in items:
            if len(words) >= max(1, min_words):
                by_length.setdefault(len(words), []).append((item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        self.words = pa.array(list(self.vocabulary), pa.string())
        self.codes = mix(np.arange(len(self.vocabulary) + 1, dtype=np.uint64) + np.uint64(77))
        self.powers = mix(np.arange(1, max(by_length, default=0) + 1, dtype=np.uint64)) | np.uint64(1)
        self.plans = []
        seeds: dict[int, list] = {}
        rng = np.random.default_rng(20_240_501)
        for m in sorted(by_length):
            edits = int(np.floor((1 - similarity) * m + 1e-9))
            item_ids = np.array([i for i, _ in by_length[m]], np.int64)
            codes = np.array([w for _, w in by_length[m]], np.int64)
            q = -(-(m - edits) // (edits + 1))
            for b in range(m - q + 1):
                seeds.setdefault(q, []).append((_runs(self.codes[codes[:, b : b + q]].T, q), len(self.plans), b))
            tables = []
            for r in range(repetitions or repetitions_for(m)):
                steps = np.sort(rng.choice(max(2, int(1.5 * m)), min(sampled, max(2, int(1.5 * m))), replace=False))
                salt = np.uint64(rng.integers(1, 1 << 63))
                keys = self._walk(codes, steps, salt, backwards=bool(r % 2))
                order = np.argsort(keys, kind="stable")
                tables.append((steps, salt, bool(r % 2), keys[order], order))
            self.plans.append((m, edits, item_ids, codes, tables))
        self.seeds = []
        for q, found in sorted(seeds.items()):
            whole = np.unique(np.concatenate([np.stack([k, np.full(len(k), plan, np.uint64), np.full(len(k), b, np.uint64)]) for k, plan, b in found], axis=1), axis=1)
            self.seeds.append((q, whole[0], whole[1].astype(np.int64), whole[2].astype(np.int64)))

    def _seeded(self, code: np.ndarray, known: np.ndarray) -> dict[int, np.ndarray]:
        """By plan, where windows would start that are in line with a run shared with an item."""
        centres: dict[int, list] = {}
        for q, keys, plans, places in self.seeds:
            at = np.flatnonzero(known[q:] - known[:-q] == q) if len(code) >= q else np.zeros(0, np.int64)
            grams = _runs(np.stack([self.codes[code[at + k]] for k in range(q)]), q)
            low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            hit = np.flatnonzero(high > low)
            for some in np.array_split(hit, max(1, int((high - low)[hit].sum()) >> 20)):
                n = (high - low)[some]
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
                start, plan = np.repeat(at[some], n) - places[k], plans[k]
                for x in np.unique(plan):
                    centres.setdefault(int(x), []).append(np.unique(start[plan == x]))
        return {x: np.unique(np.concatenate(c)) for x, c in centres.items()}

    def _walk(self, windows: np.ndarray, steps: np.ndarray, salt: np.uint64, backwards: bool) -> np.ndarray:
        """The key of each window: a hash of what its walk shows at the sampled steps."""
        n, m = windows.shape
        coded = self.codes[windows[:, ::-1] if backwards else windows]
        at, key, rows = np.zeros(n, np.int64), np.full(n, salt), np.arange(n)
        wanted = set(steps.tolist())
        for t in range(int(steps[-1]) + 1):
            shown = np.where(at < m, coded[rows, np.minimum(at, m - 1)], np.uint64(0))
            if t in wanted:
                key = mix(key ^ shown)
            at += (mix(shown ^ (salt + np.uint64(t))) >> np.uint64(63)).astype(np.int64)
        return key

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, words) of the best window or passage of each item in each text."""
        lists = normalized(texts)
        flat = lists.flatten()
        if not len(flat) or not self.plans:
            return []
        code = np.asarray(pc.index_in(flat, self.words).fill_null(-1), np.int64) + 1
        offsets = np.asarray(lists.offsets, np.int64)
        rows = np.flatnonzero(np.diff(offsets) >= min(m - edits for m, edits, *_ in self.plans))
        gap = 2 * max(edits for _, edits, *_ in self.plans) + 1
        sizes = np.cumsum(np.diff(offsets)[rows] + gap)
        out, at = [], 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SEARCH_WORDS, "right")))
            some = rows[at:stop]
            at = stop
            lengths = offsets[some + 1] - offsets[some]
            begins = np.cumsum(lengths + gap) - lengths
            spaced = np.zeros(int(begins[-1] + lengths[-1]) + gap, np.int64)
            spaced[ragged(begins, lengths)] = code[ragged(offsets[some], lengths)]
            out += [(int(some[r]), *x) for r, *x in self._search(spaced, begins, begins + lengths)]
        return out

    def _search(self, code: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """search() in documents of code between begins and ends, with unknown words between them."""
        known = np.concatenate([[0], np.cumsum(code > 0)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for number, centres in self._seeded(code, known).items():
            m, edits, item_ids, codes, tables = self.plans[number]
            starts = np.unique(centres[:, None] + np.arange(-edits, edits + 1))
            starts = starts[(starts >= edits) & (starts <= len(code) - m - edits)]
            docs = np.maximum(np.searchsorted(begins, starts + m // 2, "right") - 1, 0)
            over = np.maximum(begins[docs] - starts, 0) + np.maximum(starts + m - ends[docs], 0)  # words outside the document
            ok = (known[starts + m] - known[starts] >= m - edits) & (over <= edits)
            starts, docs, over = starts[ok], docs[ok], over[ok]
            loose: list[np.ndarray] = []
            for at in range(0, len(starts), 1 << 15):
                part = np.arange(at, min(at + (1 << 15), len(starts)))
                windows = code[starts[part][:, None] + np.arange(m)]
                _, first, same = np.unique((self.codes[windows] * self.powers[:m]).sum(axis=1), return_index=True, return_inverse=True)
                windows = windows[first]  # windows of equal words are walked and verified once
                found: list[np.ndarray] = []
                for steps, salt, backwards, keys, order in tables:
                    mine = self._walk(windows, steps, salt, backwards)
                    low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                    n = high - low
                    w = np.repeat(np.arange(len(windows)), n)
                    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    found.append(w * len(codes) + order[k])
                pairs = np.unique(np.concatenate(found))
                members = np.argsort(same, kind="stable")
                bounds = np.searchsorted(same[members], np.arange(len(windows) + 1))
                for cut in range(0, len(pairs), 1 << 14):
                    w, k = np.divmod(pairs[cut : cut + (1 << 14)], len(codes))
                    d = edit_distances(windows[w], codes[k])
                    n = bounds[w + 1] - bounds[w]
                    of, k, d = part[members[ragged(bounds[w], n)]], np.repeat(k, n), np.repeat(d, n)
                    tight = (d <= edits) & (over[of] == 0)
                    for x, i, e in zip(of[tight].tolist(), k[tight].tolist(), d[tight].tolist()):
                        key, new = (int(docs[x]), int(item_ids[i])), (e, int(starts[x] - begins[docs[x]]), m)
                        if key not in best or new < best[key]:
                            best[key] = new
                    loose.append(np.stack([of[~tight], k[~tight]]))
            self._passages(code, begins, ends, self.plans[number], starts, docs, np.concatenate(loose, axis=1) if loose else np.zeros((2, 0), np.int64), best)
        return sorted((row, item, *v) for (row, item), v in best.items())

    def _passages(self, code, begins, ends, plan, starts, docs, loose, best) -> None:
        """Enter into best the items that no window but a longer or shorter passage about a candidate holds: the
        best window about it where one lies within the edits, else the passage."""
        m, edits, item_ids, codes, _ = plan
        fresh: dict[tuple[int, int], tuple[int, int, int]] = {}
        for cut in range(0, loose.shape[1], 1 << 14):
            x, k = loose[:, cut : cut + (1 << 14)]
            open_ = np.array([(a, b) not in best for a, b in zip(docs[x].tolist(), item_ids[k].tolist())], bool)
            x, k = x[open_], k[open_]
            regions = code[starts[x][:, None] + np.arange(-edits, m + edits)]
            # a passage within the edits keeps m - edits words of the item
            hit = np.flatnonzero((regions > 0).sum(axis=1) >= m - edits)
            hit = hit[passage_distances(regions[hit], codes[k[hit]]) <= edits]
            for h in hit.tolist():
                doc, item = int(docs[x[h]]), codes[k[h]]
                at = np.arange(max(int(begins[doc]), int(starts[x[h]]) - edits), min(int(ends[doc]) - m, int(starts[x[h]]) + edits) + 1)
                d = edit_distances(code[at[:, None] + np.arange(m)], np.broadcast_to(item, (len(at), m))) if len(at) else np.zeros(0, np.int16)
                if len(d) and d.min() <= edits:
                    new = (int(d.min()), int(at[d.argmin()] - begins[doc]), m)
                else:
                    e, first, words = passage(regions[h], item)
                    new = (e, int(starts[x[h]] - edits + first - begins[doc]), words)
                key = (doc, int(item_ids[k[h]]))
                # windows of m words before passages
                if key not in fresh or (new[2] != m, *new) < (fresh[key][2] != m, *fresh[key]):
                    fresh[key] = new
        best.update(fresh)


def _passes(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark, or as many hash parts of it as keep each one below the proven size that a task gets."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null and text is not null")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // (PASS_ITEMS // 2)), -(-size["bytes"] // (PASS_BYTES // 2)))
    if parts == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _searcher(items: list, similarity: float, min_words: int) -> Searcher:
    """The benchmark's tables, built once for a worker and not once a task."""
    digest = xxhash.xxh128_hexdigest(repr((items, similarity, min_words)))
    return worker_slot(("searcher", digest), lambda: Searcher(items, similarity, min_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 1) -> DataFrame:
    """doc_id, item_id, edits, first_word, n_words: the best place of every benchmark item found in a document.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. An item of m words is found where any
    run of words lies within floor((1 - similarity) * m) word edits. Where windows of m words do, the best one and its
    edits are given, else the best run of other length. Items of fewer than five
    words are found word for word, and any text may hold them: min_words leaves the shorter ones out. Items of null id
    or text, or without words, are skipped. Items equal in
    text are all reported. Null and empty texts hold nothing. Repeated documents give their rows each. An empty
    table on either side gives no rows. A benchmark above PASS_ITEMS items or PASS_BYTES is searched in passes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for part in _passes(benchmark):
        rows = part.toArrow()  # bounded: see _passes
        items = list(zip(rows["item_id"].to_pylist(), normalized(rows["text"].combine_chunks()).to_pylist())) if rows.num_rows else []

        def run(batches, items=items):
            searcher = _searcher(items, similarity, min_words)
            for batch in slices(batches, "text", 8 << 20):
                found = searcher.search(batch.column("text"))
                cols = list(zip(*found)) or [[]] * 5
                ids = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "edits", "first_word", "n_words"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 1) -> DataFrame:
    """docs, all columns, without the rows whose text holds a benchmark item; the rule of contaminated()."""
    out = docs
    for part in _passes(benchmark):
        rows = part.toArrow()  # bounded: see _passes
        items = list(zip(rows["item_id"].to_pylist(), normalized(rows["text"].combine_chunks()).to_pylist())) if rows.num_rows else []

        def run(batches, items=items):
            searcher = _searcher(items, similarity, min_words)
            for batch in slices(batches, "text", 8 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in searcher.search(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
