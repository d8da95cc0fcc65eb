"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

A document is read whole, as bytes with A-Z lower-cased and white space as blanks, in windows of WINDOW bytes. The
network reads each window from either side, across words, and labels every position with probabilities of the
languages; a document's probabilities are the mean over all its positions. States start anew at each window, which
bounds memory and lets all windows of a batch be read at once; the last window of a document is filled up with blanks,
which don't count. Training is backpropagation through time with Adam over a bounded sample of labelled windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import ragged, release_slot, slices, text_buffer

WINDOW = 64
#: The bounded sample: about so many documents and so many windows of each language.
TRAIN_DOCUMENTS = 400
TRAIN_WINDOWS = 2000
HIDDEN = 16
#: Windows that are read at once.
BATCH = 1024
#: What the network reads for each byte.
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[[9, 10, 11, 12, 13]] = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Two GRUs over bytes and a softmax at every position. params: input tables, recurrent and output weights."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = list(langs), hidden
        self.params = {}
        for d in ("f", "b"):
            self.params[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(dtype)
            self.params[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(dtype)
        self.params["w"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(dtype)
        self.params["c"] = np.zeros(len(langs), dtype)

    def _pass(self, x: np.ndarray, d: str, keep: bool):
        """States (T, B, H) after each byte of x (T, B), and what backpropagation needs."""
        h_size, table, u = self.hidden, self.params[f"x{d}"], self.params[f"u{d}"]
        steps, n = x.shape
        h = np.zeros((n, h_size), table.dtype)
        states, saved = np.empty((steps, n, h_size), table.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            inp, rec = table[x[t]], h @ u
            gates = _sigmoid(inp[:, : 2 * h_size] + rec[:, : 2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            new = np.tanh(inp[:, 2 * h_size :] + r * rec[:, 2 * h_size :])
            if keep:
                saved.append((t, h, z, r, new, rec[:, 2 * h_size :]))
            h = new + z * (h - new)
            states[t] = h
        return states, saved

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, languages, B) at every position of the windows x (T, B). The same states as those of
        _pass(), laid out so that each gate's units lie together."""
        size, (steps, n) = self.hidden, x.shape
        at = x.astype(np.int64)
        logits = np.empty((steps, len(self.langs), n), np.float32)
        logits[:] = self.params["c"][:, None]
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), size)  # sigmoid(x) = (tanh(x / 2) + 1) / 2
        rec, inp, said = np.empty((3 * size, n), np.float32), np.empty((3 * size, n), np.float32), np.empty((len(self.langs), n), np.float32)
        for d, w in (("f", self.params["w"][:size]), ("b", self.params["w"][size:])):
            table, u, w = (np.ascontiguousarray(m.T, np.float32) for m in (self.params[f"x{d}"] * half, self.params[f"u{d}"] * half, w))
            h = np.zeros((size, n), np.float32)
            gates, new = rec[: 2 * size], rec[2 * size :]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(table, at[t], axis=1, out=inp, mode="clip")
                np.matmul(u, h, out=rec)
                gates += inp[: 2 * size]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new *= gates[size:]
                new += inp[2 * size :]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:size]
                h += new
                np.matmul(w, h, out=said)
                logits[t] += said
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions of windows x (T, B) with languages y (B), and its gradients."""
        passes = {d: self._pass(x, d, True) for d in ("f", "b")}
        states = np.concatenate([passes["f"][0], passes["b"][0]], axis=2)
        p = self._softmax(states @ self.params["w"] + self.params["c"])
        steps, n = x.shape
        loss = float(-np.log(np.maximum(p[:, np.arange(n), y], 1e-12)).mean())
        d_logits = p.copy()
        d_logits[:, np.arange(n), y] -= 1
        d_logits /= steps * n
        flat = d_logits.reshape(steps * n, -1)
        grads = {"w": states.reshape(steps * n, -1).T @ flat, "c": flat.sum(axis=0)}
        d_states = d_logits @ self.params["w"].T
        size = self.hidden
        for d, part in (("f", d_states[:, :, :size]), ("b", d_states[:, :, size:])):
            u = self.params[f"u{d}"]
            d_u, d_x = np.zeros_like(u), np.zeros_like(self.params[f"x{d}"])
            d_next = np.zeros((n, size), u.dtype)
            for t, h, z, r, new, rec in reversed(passes[d][1]):
                dh = part[t] + d_next
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * rec * r * (1 - r)
                through = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += h.T @ through
                d_next = dh * z + through @ u.T
                np.add.at(d_x, x[t], np.concatenate([d_z, d_r, d_new], axis=1))
            grads[f"u{d}"], grads[f"x{d}"] = d_u, d_x
        return loss, grads

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam over batches of windows (a row each); the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(x) for k, x in self.params.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            total = 0.0
            for at in np.array_split(rng.permutation(len(windows)), max(1, -(-len(windows) // batch))):
                loss, grads = self.gradients(windows[at].T, labels[at])
                total, step = total + loss * len(at), step + 1
                now = rate * (1 - epoch / epochs)
                for name, g in grads.items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.params[name] -= now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(1, len(windows)))
        return losses

    def digest(self) -> str:
        return hashlib.sha256(b"".join(v.tobytes() for v in self.params.values()) + repr(self.langs).encode()).hexdigest()


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, document of each, bytes of it that count) of documents' bytes; a last window is filled with blanks."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), many)
    first = offsets[:-1][owner] + ragged(np.zeros(len(size), np.int64), many) * WINDOW
    real = np.minimum(offsets[1:][owner] - first, WINDOW)
    out = np.full((len(owner), WINDOW), 32, np.uint8)
    out[np.arange(WINDOW) < real[:, None]] = _READ[data[: offsets[-1]]]
    return out, owner, real


def predict(net: Network, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and pooled probability of each text; und and 0 for texts without a letter."""
    if not net.langs or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts))
    texts = pc.fill_null(texts, "")
    data, offsets = text_buffer(texts)
    windows, owner, real = windows_of(data, offsets)
    pooled = np.zeros((len(texts), len(net.langs)))
    for at in range(0, len(windows), BATCH):
        part = slice(at, at + BATCH)
        p = net.label(np.ascontiguousarray(windows[part].T))
        p *= (np.arange(WINDOW)[:, None] < real[part])[:, None, :]
        np.add.at(pooled, owner[part], p.sum(axis=0, dtype=np.float64).T)
    pooled /= np.maximum(np.diff(offsets), 1)[:, None]
    known = np.asarray(pc.match_substring_regex(texts, r"\p{L}"), bool)
    best = pooled.argmax(axis=1)
    return [net.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, np.clip(pooled[np.arange(len(texts)), best], 0, 1), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, windows: int = TRAIN_WINDOWS, hidden: int = HIDDEN, epochs: int = 6) -> Network:
    """A network trained on the labelled, not held-out rows of docs (doc_id, text, lang).

    Of each language about `documents` rows, by a hash of doc_id, and of these about `windows` windows, by a hash of
    row and place, come to the driver; a language with fewer gives all. No labelled rows: a network without
    languages, which calls everything und.
    """
    share = lambda wanted, n: min(1.0, wanted / max(1, n))
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Network([], hidden)
    langs = sorted(counts)
    draw = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(1 << 20)) / float(1 << 20)

    def below(column: Column, of: dict[str, float]) -> Column:
        return column < F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("lang"))

    rows = labelled.filter(below(draw(F.lit("d"), "doc_id"), {k: share(documents, n) for k, n in counts.items()}))
    places = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / WINDOW).cast("int")), lambda k: F.substring("text", k * WINDOW + 1, F.lit(WINDOW)))
    spread = rows.filter(F.length("text") > 0).select("lang", "doc_id", F.posexplode(places).alias("at", "said")).persist()
    totals = {r["lang"]: r["n"] for r in spread.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    sample = spread.filter(below(draw(F.lit("w"), "doc_id", "at"), {k: share(windows, n) for k, n in totals.items()}))
    got = sorted((r["lang"], r["doc_id"], r["at"], r["said"]) for r in sample.select("lang", "doc_id", "at", "said").collect())  # bounded: languages x windows
    spread.unpersist()
    net = Network(langs, hidden)
    if got:
        raw = [said.encode()[:WINDOW] for *_, said in got]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        net.train(windows_of(np.frombuffer(b"".join(raw), np.uint8), offsets)[0], np.array([langs.index(lang) for lang, *_ in got]), epochs)
    return net


def predict_languages(docs: DataFrame, net: Network) -> DataFrame:
    """docs, all columns, with lang_pred and score added (columns of these names are replaced).

    Null text and text without a letter: und, score 0. Whole texts are read. Ties go to the language that
    sorts first. No rows in, no rows out.
    """
    base = docs.drop("lang_pred", "score")
    schema = base.schema

    def run(batches):
        release_slot()
        for batch in slices(batches, "text"):
            langs, scores = predict(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, out)


def keep_known_languages(docs: DataFrame, net: Network | None = None, margin: float = 0.01) -> DataFrame:
    """docs, their columns and no others, without the rows whose language the network can't tell.

    These are null texts, texts without a letter, and texts whose pooled probability lies within `margin` of the way
    from an even spread over the languages to certainty; at 0.01 only texts on which the network has no opinion (with
    a single language learned there is no such text). Where docs has a
    column lang, a null there becomes the predicted language. Where nothing could be learned (no labelled rows), every
    text with a letter stays. Columns lang_pred and score of docs itself are left alone.
    """
    net = net or fit(docs)
    if not net.langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    even = 1 / len(net.langs)
    floor = even + margin * (1 - even) if len(net.langs) > 1 else 0.0
    found = predict_languages(docs.withColumnsRenamed(own), net).filter((F.col("lang_pred") != "und") & (F.col("score") >= floor))
    if "lang" in docs.columns:
        found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)
