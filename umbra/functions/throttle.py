"""Request limits: parsing, and the bucket as a fold over arrival times in order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Limit:
    """interval_ms between arrivals of a token, and the most tokens held."""

    interval_ms: int
    capacity: int


def parse_limit(text: str) -> Limit:
    """<n>rps or <n>rpm. Zero, other units and more than 1000 a second (no whole interval) are refused."""
    m = re.fullmatch(r"([0-9]+)(.*)", text)
    if not m or m[2] not in ("rps", "rpm"):
        raise ValueError(f"expected <n>rps or <n>rpm, got {text!r}")
    n, per = int(m[1]), 1000 if m[2] == "rps" else 60_000
    if n == 0 or n > per:
        raise ValueError(f"{text!r}: the limit must be 1 to {per} in this unit")
    return Limit(per // n, per // (per // n))


def share(limit: Limit, tasks: int) -> Limit:
    """A task's part of a limit that all tasks of a run keep together."""
    return Limit(limit.interval_ms * max(1, tasks), max(1, limit.capacity // max(1, tasks)))


class Bucket:
    """The same bucket for a task that waits: delay(now) is how long in ms the request at now has to wait."""

    def __init__(self, limit: Limit, start_ms: int):
        self.limit, self.cap, self.arrived, self.updated = limit, limit.capacity, start_ms, start_ms

    def delay(self, now: int) -> int:
        rate, most = self.limit.interval_ms, self.limit.capacity
        new = max(now - self.arrived, 0) // rate
        available = min(self.cap + new, most)
        wait = 0 if available > 0 else max(rate - (now - self.updated), 0) + rate * abs(self.cap) // most
        self.cap, self.arrived, self.updated = available - 1, self.arrived + new * rate, now
        return wait


def stream_delays(requests: DataFrame, key: str, time_ms: str, tie: str, limit: Limit) -> DataFrame:
    """key, tie, delay_ms of requests: a bucket for each key, full at its first request, over its requests in order of
    time and then of tie. Rows stream through in order, so a key of any number of requests takes constant memory."""
    names = [key, tie, "delay_ms"]
    schema = T.StructType([requests.schema[key], requests.schema[tie], T.StructField("delay_ms", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, bucket = object(), None
        for batch in batches:
            waits = []
            for k, now in zip(batch.column(key).to_pylist(), batch.column(time_ms).to_pylist()):
                if k != who or bucket is None:
                    who, bucket = k, Bucket(limit, now)
                waits.append(bucket.delay(now))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(tie), pa.array(waits, pa.int64())], names)

    return requests.repartition(key).sortWithinPartitions(key, time_ms, tie).mapInArrow(run, schema)
