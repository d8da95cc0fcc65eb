import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.functions import detect
from umbra.functions.detect import CARD, EMAIL, IP, PHONE

SPAN = "array<struct<entity_type:string,start:int,end:int>>"


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def spans(*pairs, kind="PERSON"):
    return F.array(*[F.struct(F.lit(kind).alias("entity_type"), F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end")) for a, b in pairs])


def test_span_mask(spark):
    cases = [("Hello, John", [(7, 11)], "Hello, XXXX"), ("abcdef", [(2, None)], "abXXXX"), ("abcdef", [(None, 3)], "XXXdef"), ("abcdef", [(None, None)], "abcdef"), ("abcdef", [(0, 3), (2, 5)], "XXXXXf"), ("abcdef", [(2, 5), (0, 3)], "XXXXXf"), ("abc", [(1, 99)], "aXX"), ("abc", [(2, 1)], "abc"), ("éàü", [(1, 2)], "éXü")]
    for text, found, want in cases:
        assert one(spark, lambda t, f=found: detect.mask_spans(t, spans(*f)), text) == want


def test_denied_type_is_left_alone(spark):
    assert one(spark, lambda t: detect.mask_spans(t, detect.allowed(spans((0, 3), kind="US_DRIVER_LICENSE"))), "abcdef") == "abcdef"


def test_replace_and_null(spark):
    assert one(spark, lambda t: detect.replace(t), "mail a.b@c.org, call +1 (555) 123-4567 from 10.0.0.1") == "mail [REDACTED], call [REDACTED] from [REDACTED]"
    assert one(spark, lambda t: detect.replace(t), None) is None
    assert one(spark, lambda t: detect.replace(t), "") == ""
    assert one(spark, lambda t: detect.sample(t, 3), "éàü123") == "éàü"


def test_info_types(spark):
    got = spark.range(1).select(detect.info_types(F.array(F.lit("AGE"), F.lit("OWN")))).first()[0]
    assert len(got) == len(detect.BUILT_IN_INFO_TYPES) + 1 and "OWN" in got
    assert detect.stored_info_type("p", "n") == "projects/p/storedInfoTypes/n"


def test_many_rules_and_long_runs_stay_linear(spark):
    plan = spark.range(1).select(detect.replace(F.col("id").cast("string"), detect.ALL_RULES))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 6000
    long = spark.createDataFrame([("a" * 1_000_000 + " x@y.org",), ("ab-" * 300_000 + "@ " + "q.q" * 10,), ("a@" + "b." * 300_000,)], "t string")
    began = time.monotonic()
    t = F.col("t")
    got = long.select(F.length(detect.replace(t, detect.ALL_RULES)), F.length(detect.mask(t, detect.ALL_RULES)), F.size(detect.all_spans(t))).collect()
    assert [tuple(r) for r in got] == [(1_000_011, 1_000_008, 1), (900_032, 900_032, 0), (600_002, 600_002, 0)]
    assert time.monotonic() - began < 60
    many = spark.createDataFrame([(" a@b.co" * 3000,)], "t string").select(detect.mask_spans(t, detect.all_spans(t, [EMAIL])).alias("m")).first()["m"]
    assert many == " XXXXXX" * 3000


PIECES = st.lists(st.sampled_from(["a@b.co", "1.2.3.4", "+1 (555) 123-4567", "4" * 16, "é", " ", "x", "@", "12", "."]), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=1, max_size=8))
def test_properties(spark, many):
    texts = ["".join(p) for p in many]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    rows = df.select("k", "t", detect.mask(t).alias("m"), detect.replace(t).alias("r"), detect.replace(detect.replace(t)).alias("rr"), detect.all_spans(t, [EMAIL, IP, PHONE, CARD]).alias("s")).collect()
    for row in rows:
        assert len(row["m"]) == len(row["t"])
        assert row["r"] == row["rr"]
        want = [(r.entity, m.start(), m.end()) for r in (EMAIL, IP, PHONE, CARD) for m in re.finditer(r.pattern, row["t"])]
        assert [(s["entity_type"], s["start"], s["end"]) for s in row["s"]] == want
