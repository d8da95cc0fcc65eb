import pytest
from pyspark.sql import functions as F

from umbra.functions import media, throttle
from umbra.functions.throttle import Limit
from umbra.plans import planning
from umbra.plans.planning import PROVIDERS


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def plan(spark, kind, names, pdf=False, ocr=False):
    p = value(spark, planning.redact_plan(F.lit(kind).cast("string"), [PROVIDERS[n] for n in names], pdf, ocr))
    return p["providers"], [f for f in ("apply_pdf", "apply_ocr", "table_as_text") if p[f]]


def test_verdicts(spark):
    for path, size, want in [("test.txt", 50, "Matched"), ("test.txt", 150, "SkippedDueToSize"), ("test.md", 50, "SkippedDueToName"), ("test.txt", 100, "Matched"), ("test.txt", None, "Matched"), ("x.md", 101, "SkippedDueToSize")]:
        assert value(spark, planning.verdict(F.lit(path), F.lit(size).cast("bigint"), 100, "*.txt")) == want


def test_globs():
    import re

    for glob, path, want in [("*.txt", "a/b.txt", True), ("sub/*.txt", "sub/x.txt", True), ("?.md", "ab.md", False), ("[!a]*", "b", True), ("{a,b}.c", "b.c", True), ("a.b", "axb", False), ("**/x", "q/w/x", True)]:
        assert bool(re.match(media.glob_pattern(glob), path)) == want, glob


def test_classes(spark):
    for kind, want in [("text/x-toml", "text"), ("text/javascript", None), ("application/json", "text"), ("application/javascript", None), ("text/csv", "table"), ("image/svg+xml", "image"), ("application/pdf", "pdf"), (None, None)]:
        assert value(spark, media.media_class(F.lit(kind).cast("string"))) == want
    rules = [("text/plain", "*.md"), ("text/html", "*.md")]
    assert value(spark, media.override(F.lit("a.md"), F.lit(None).cast("string"), rules)) == "text/plain"
    with pytest.raises(ValueError):
        media.parse_override("nonsense")


def test_plans(spark):
    assert plan(spark, "text/csv", ["gcp-dlp", "ms-presidio"]) == (["gcp-dlp"], [])
    assert plan(spark, "text/csv", ["ms-presidio"]) == (["ms-presidio"], ["table_as_text"])
    assert plan(spark, "application/pdf", ["ms-presidio"], pdf=True) == (["ms-presidio"], ["apply_pdf"])
    assert plan(spark, "application/pdf", ["aws-comprehend"], pdf=True, ocr=True) == (["aws-comprehend"], ["apply_pdf", "apply_ocr"])
    assert plan(spark, "application/pdf", ["aws-comprehend"], pdf=True) == ([], [])
    assert plan(spark, "image/png", ["aws-comprehend"], ocr=True) == (["aws-comprehend"], ["apply_ocr"])
    assert plan(spark, "image/png", ["aws-comprehend"]) == ([], [])
    assert plan(spark, "image/webp", ["gcp-dlp"]) == ([], [])
    assert plan(spark, None, list(PROVIDERS), True, True) == ([], [])
    assert plan(spark, "text/plain", []) == ([], [])


def test_outcomes(spark):
    null = F.lit(None).cast("string")
    for args, want in [
        (("SkippedDueToName", True, 1, null, True), "Skipped"), (("Matched", False, 0, null, False), "Copied"), (("Matched", True, 0, null, True), "Copied"), (("Matched", True, 0, null, False), "Skipped"),
        (("Matched", True, 2, F.lit("no"), True), "Skipped"), (("Matched", True, 1, null, False), "Redacted"),
    ]:
        v, r, n, e, a = args
        assert value(spark, planning.outcome(F.lit(v), r, F.lit(n), e, a)) == want


def test_limits():
    assert throttle.parse_limit("15rpm") == Limit(4000, 15)
    assert throttle.parse_limit("7rps") == Limit(142, 7)
    for bad in ("5x", "0rps", "rps", "1001rps"):
        with pytest.raises(ValueError):
            throttle.parse_limit(bad)
    assert throttle.share(Limit(4000, 15), 4) == Limit(16000, 3)


def test_bucket(spark):
    limit = Limit(4000, 15)
    bucket = throttle.Bucket(limit, 0)
    assert [bucket.delay(0) for _ in range(17)] == [0] * 15 + [4000, 4266]
    for now, cap in ((3999, 14), (4001, 14)):
        bucket = throttle.Bucket(limit, 0)
        assert bucket.delay(now) == 0 and (bucket.cap, bucket.arrived) == (cap, 0 if now < 4000 else 4000)


def test_many_requests_of_one_key_stream_through(spark):
    limit = Limit(4000, 15)
    rows = [(1, 7 * k % 90_000, k) for k in range(25_000)] + [(2, 0, k) for k in range(17)]
    got = throttle.stream_delays(spark.createDataFrame(rows, "user int, now long, id long"), "user", "now", "id", limit).collect()
    assert [r["delay_ms"] for r in sorted((r for r in got if r["user"] == 2), key=lambda r: r["id"])] == [0] * 15 + [4000, 4266]
    order = sorted((t, k) for u, t, k in rows if u == 1)
    bucket = throttle.Bucket(limit, order[0][0])
    assert {r["id"]: r["delay_ms"] for r in got if r["user"] == 1} == {k: bucket.delay(t) for t, k in order}
