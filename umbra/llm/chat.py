"""Chat formatting by columnar byte assembly.

Template (control strings begin with an unescaped '<' or '['):

    <s>                                       once, at the start
    [INST:role] text [/INST]                  a turn of any role but assistant; the role is escaped too
    [ANS] text </s>                           an assistant turn; text is under the loss mask

Inside roles and texts '\\', '<', '[' and ']' get a '\\' in front, so no text can forge a control string and
reading is exact: an unescaped '[' opens a header and an unescaped '[' or '<' ends the text.
A batch is assembled at once: lengths of all headers, contents and footers, their cumulative offsets, and
scatter indices put every byte at its place in one preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import ragged, text_buffer

FORMATTED = "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:long,end:long>>"
_ESCAPED = np.zeros(256, bool)
_ESCAPED[[ord("\\"), ord("<"), ord("["), ord("]")]] = True
_PIECES = [b"<s>", b"[INST:", b"] ", b" [/INST]\n", b"[ANS] ", b" </s>\n"]
_POOL = np.frombuffer(b"".join(_PIECES), np.uint8)
_LEN = np.array([len(p) for p in _PIECES], np.int64)
_AT = np.cumsum(_LEN) - _LEN


def escape_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and offsets of strings laid end to end."""
    special = _ESCAPED[data]
    before = np.cumsum(special)
    shift = np.concatenate([[0], before])
    out = np.full(len(data) + int(shift[-1]), ord("\\"), np.uint8)
    out[np.arange(len(data)) + before] = data
    return out, offsets + shift[offsets]


def unescape(text: str) -> str:
    out, k = [], 0
    while (j := text.find("\\", k)) >= 0:
        out += [text[k:j], text[j + 1 : j + 2]]
        k = j + 2
    return "".join(out) + text[k:]


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted strings of the conversations in conv (0, 0, 1, ...: one number a turn, ascending), the
    first turn of each, and the byte span of each turn's escaped text within its string."""
    n = len(conv)
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if n else np.zeros(0, np.int64)
    r_data, r_off = escape_bytes(*text_buffer(roles))
    t_data, t_off = escape_bytes(*text_buffer(texts))
    assistant = np.asarray(pc.equal(roles, "assistant"), bool) if n else np.zeros(0, bool)
    opens = np.zeros(n, bool)
    opens[first] = True
    # six segments a turn: start mark, header, role, header end, text, footer; all but role and text come from the pool
    lens = np.zeros((n, 6), np.int64)
    lens[:, 0] = np.where(opens, _LEN[0], 0)
    lens[:, 1] = np.where(assistant, _LEN[4], _LEN[1])
    lens[:, 2] = np.where(assistant, 0, np.diff(r_off))
    lens[:, 3] = np.where(assistant, 0, _LEN[2])
    lens[:, 4] = np.diff(t_off)
    lens[:, 5] = np.where(assistant, _LEN[5], _LEN[3])
    ends = np.cumsum(lens.ravel()).reshape(n, 6)
    starts = ends - lens
    out = np.empty(int(ends[-1, 5]) if n else 0, np.uint8)
    pool_at = np.stack([np.full(n, _AT[0]), np.where(assistant, _AT[4], _AT[1]), np.zeros(n, np.int64), np.full(n, _AT[2]), np.zeros(n, np.int64), np.where(assistant, _AT[5], _AT[3])], 1) if n else np.zeros((0, 6), np.int64)
    for k in (0, 1, 3, 5):
        out[ragged(starts[:, k], lens[:, k])] = _POOL[ragged(pool_at[:, k], lens[:, k])]
    out[ragged(starts[:, 2], lens[:, 2])] = r_data[ragged(r_off[:-1], lens[:, 2])]
    out[ragged(starts[:, 4], lens[:, 4])] = t_data
    bounds = np.append(starts[first, 0], len(out)) if n else np.zeros(1, np.int64)
    base = np.repeat(bounds[:-1], np.diff(np.append(first, n)))
    strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    return strings, first, starts[:, 4] - base, ends[:, 4] - base


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, read back; start and end are code points of the escaped text."""
    turns, k = [], len("<s>")
    while k < len(formatted):
        if formatted.startswith("[ANS] ", k):
            role, k, foot = "assistant", k + 6, " </s>\n"
        else:
            close = _unescaped(formatted, k + 6, "]")
            role, k, foot = unescape(formatted[k + 6 : close]), close + 2, " [/INST]\n"
        end = _unescaped(formatted, k, foot.strip()[0]) - 1
        turns.append((role, unescape(formatted[k:end]), k, end))
        k = end + len(foot)
    return turns


def _unescaped(s: str, k: int, char: str) -> int:
    """Index of the first char from k on that no backslash escapes."""
    while True:
        j = s.index(char, k)
        b = j
        while b > k and s[b - 1] == "\\":
            b -= 1
        if (j - b) % 2 == 0:
            return j
        k = j + 1


def format_conversations(turns: DataFrame, max_batch_bytes: int = 32 << 20) -> DataFrame:
    """One row per conv_id: the formatted string, its turns and the code-point spans under the loss mask.

    turns: conv_id, turn, role, text (others are ignored). Rows are ordered by turn, nulls first, equal
    turns by role and text. Null text is empty, null role is the role ''. Repeated rows are turns of their
    own; rows of null conv_id form one conversation; no rows in, none out. Rows are hash-partitioned by
    conv_id and sorted, and a task assembles runs of whole conversations of about max_batch_bytes; a single
    conversation has to fit in memory, as it is one output value.
    """

    def emit(tables):
        t = pa.Table.from_batches(tables)
        ids = t["conv_id"].combine_chunks()
        key, null = np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null(), bool)
        change = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (null[1:] != null[:-1]))])
        roles, texts = (t[c].combine_chunks().cast(pa.large_string()).fill_null("") for c in ("role", "text"))
        strings, first, lo, hi = assemble(change, roles, texts)
        counts = np.diff(np.append(first, len(key)))
        assistant = np.asarray(pc.equal(roles, "assistant"), bool)
        # byte spans to code points: continuation bytes before the span
        data, bounds = text_buffer(strings)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = np.repeat(bounds[:-1], counts)
        lo, hi = chars[base + lo] - chars[base], chars[base + hi] - chars[base]
        spans = pa.StructArray.from_arrays([pa.array(lo[assistant]), pa.array(hi[assistant])], ["start", "end"])
        offsets = np.concatenate([[0], np.cumsum(assistant)])[np.append(first, len(key))]
        loss = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), strings.cast(pa.string()), pa.array(counts, pa.int64()), loss], ["conv_id", "formatted", "n_turns", "loss_spans"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > max_batch_bytes:
                last = batch.column("conv_id")[batch.num_rows - 1].as_py()
                t = pa.Table.from_batches(held).combine_chunks()
                ids = t["conv_id"]
                same = ids.is_null() if last is None else pc.equal(ids, last).fill_null(False)
                cut = int(pc.index(same, True).as_py())
                if cut > 0:
                    yield from emit(t.slice(0, cut).to_batches())
                held, size = t.slice(cut).to_batches(), t.slice(cut).nbytes
        if held:
            yield from emit(held)

    cols = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = cols.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)
