"""The engine over streams: redaction as it comes, windowed entity counts, and the request bucket as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from umbra.functions.detect import DEFAULT_RULES, Rule, count_matches, replace
from umbra.functions.throttle import Bucket, Limit


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def redact_stream(df: DataFrame, column: str, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Stateless: each row's text redacted."""
    return df.withColumn(column, replace(F.col(column), rules))


def entity_windows(df: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "10 minutes", rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Matches of each rule by event-time window; rows later than the watermark are dropped."""
    counts = {r.entity: F.sum(count_matches(F.col(text), r)).alias(r.entity.lower()) for r in rules}
    return df.withWatermark(time, late).groupBy(F.window(time, window).alias("window")).agg(*counts.values())


def throttle_stream(df: DataFrame, key: str, time_ms: str, limit: Limit) -> DataFrame:
    """key, time_ms, delay_ms: a bucket of the limit for each key, carried over batches; requests in time order
    within a batch. State is three numbers a key."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted(t for pdf in pdfs for t in pdf["time_ms"].tolist())
        bucket = Bucket(limit, times[0])
        if state.exists:
            bucket.cap, bucket.arrived, bucket.updated = state.get
        out = [bucket.delay(now) for now in times]
        state.update((bucket.cap, bucket.arrived, bucket.updated))
        yield pd.DataFrame({"key": [k[0]] * len(times), "time_ms": times, "delay_ms": out})

    source = df.select(F.col(key).alias("key"), F.col(time_ms).cast("long").alias("time_ms"))
    kind = source.schema["key"].dataType.simpleString()
    return source.groupBy("key").applyInPandasWithState(run, f"key {kind}, time_ms long, delay_ms long", "cap long, arrived long, updated long", "append", GroupStateTimeout.NoTimeout)
