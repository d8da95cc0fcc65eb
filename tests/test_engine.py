import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbra.cli import main
from umbra.engine import CopyOptions, copy, listing, redact_files, throttled
from umbra.functions import detect, throttle
from umbra.operators import converters, images
from umbra.operators.converters import Page
from umbra.operators.providers import RemoteDetector, RuleDetector
from umbra.plans.planning import Provider, listing_totals
from umbra.queries import ORACLE_SQL, QUERIES
from umbra.sources import inventory, sinks
from umbra.sources.archive import read_zip, write_zip
from umbra.sources.connection import connect
from umbra.sources.tables import parse_csv, pieces, serialize_csv


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("mail a@b.org")
    (src / "sub" / "t.csv").write_text("name,mail\nx,a@b.org\n")
    (src / "bad.txt").write_bytes(b"\xff\xfe")
    (src / "i.png").write_bytes(b"123")
    (src / "sub" / "big.txt").write_text("1234567890" * 50)
    return src


def test_copy_redacts_and_counts(spark, tree, tmp_path):
    dest, report = tmp_path / "out", tmp_path / "r.json"
    dest.mkdir()
    got = copy(spark, str(tree) + "/", str(dest) + "/", CopyOptions(max_size=400, detectors=[RuleDetector()]), str(report))
    assert got.asDict() == {"files_copied": 2, "files_redacted": 2, "files_skipped": 3} == json.loads(report.read_text())
    assert (dest / "a.txt").read_text() == "mail [REDACTED]"
    assert (dest / "sub" / "t.csv").read_text() == "name,mail\nx,[REDACTED]\n"
    assert not (dest / "i.png").exists() and not (dest / "bad.txt").exists()


def test_plain_copy_unsupported_and_limit(spark, tree, tmp_path):
    (tmp_path / "o1").mkdir(), (tmp_path / "o2").mkdir()
    assert copy(spark, f"file://{tree}/", f"{tmp_path}/o1/")["files_copied"] == 5
    got = copy(spark, f"{tree}/", f"{tmp_path}/o2/", CopyOptions(max_files=2, allow_unsupported_copies=True, name_glob="*.{png,txt}", detectors=[RuleDetector(mode="mask")]))
    assert got.asDict() == {"files_copied": 1, "files_redacted": 1, "files_skipped": 2}  # a.txt, bad.txt fails; t.csv by name
    assert (tmp_path / "o2" / "a.txt").read_text() == "mail XXXXXXX"


def test_single_file_and_cardinality(spark, tree, tmp_path):
    assert copy(spark, f"{tree}/a.txt", f"{tmp_path}/one.txt", CopyOptions(detectors=[RuleDetector()], sample_chars=6))["files_redacted"] == 1
    assert (tmp_path / "one.txt").read_text() == "mail a"
    with pytest.raises(ValueError):
        copy(spark, f"{tree}/", f"{tmp_path}/one.txt")


def test_zip_both_ways(spark, tree, tmp_path):
    target = tmp_path / "x.zip"
    assert copy(spark, f"{tree}/", f"zip://{target}")["files_copied"] == 5
    assert "sub/t.csv" in zipfile.ZipFile(target).namelist()
    assert read_zip(spark, str(target)).filter("relative_path = 'a.txt'").first()["content"] == b"mail a@b.org"
    (tmp_path / "back").mkdir()
    assert copy(spark, f"zip://{target}", f"{tmp_path}/back/", CopyOptions(detectors=[RuleDetector()]))["files_redacted"] == 3
    with pytest.raises(FileExistsError):
        copy(spark, f"{tree}/", f"zip://{target}")


def test_zip_is_packed_by_tasks(spark, tmp_path, monkeypatch):
    made = spark.range(0, 400, 1, 4).select(F.concat(F.lit("d/"), "id", F.lit(".txt")).alias("relative_path"), F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("content"), F.when(F.col("id") % 10 == 0, "Skipped").otherwise("Copied").alias("outcome"))
    monkeypatch.setattr(type(made), "toLocalIterator", None)  # no content comes to the driver
    assert sorted(write_zip(made, f"{tmp_path}/p.zip")) == ["Copied"] * 360 + ["Skipped"] * 40
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert z.testzip() is None and z.namelist() == sorted(f"d/{k}.txt" for k in range(400) if k % 10)
        assert all(z.read(n) == n[2:-4].encode() * 50 for n in z.namelist())


def test_listing(spark, tree):
    files = listing(spark, f"{tree}/", name_glob="sub/*.csv")
    assert [r["relative_path"] for r in files.filter("verdict = 'Matched'").collect()] == ["sub/t.csv"]
    assert listing_totals(files).first().asDict() == {"files_found": 1, "total_size": 20, "files_skipped": 4, "longest_name": 9}
    assert listing(spark, f"{tree}/a.txt").count() == 0
    plan = inventory.scan(spark, f"{tree}/").filter(F.col("file_size") <= 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_empty_files_are_files(spark, tree):
    (tree / "none.txt").write_text(""), (tree / "sub" / "odd; isDirectory=false; length=7; .md").write_text("")
    want = {("none.txt", "text/plain", 0), ("sub/odd; isDirectory=false; length=7; .md", "text/markdown", 0)}
    got = inventory.scan(spark, f"{tree}/", content=True)
    assert {tuple(r)[:3] for r in got.filter("content = X''").collect()} == want and got.count() == 7
    assert {tuple(r) for r in inventory.scan(spark, f"{tree}/").filter("file_size = 0").collect()} == want
    assert inventory.scan(spark, f"{tree}/none.txt").first()["relative_path"] == "none.txt"


def test_file_round_trip_of_an_empty_document(spark, sf, tmp_path, same_as_sql, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    said = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.col("text"))
    docs.withColumn("text", said).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = ORACLE_SQL["file_round_trip"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    same_as_sql(QUERIES["file_round_trip"](spark, str(tmp_path)), sql)


def test_what_a_failed_write_leaves_is_not_a_file(spark, tree):
    with pytest.raises(OSError):
        sinks.put(f"{tree}/sub", b"x")  # a folder is in its place
    assert len(list(tree.rglob("*.part"))) == 1 and inventory.scan(spark, f"{tree}/").count() == 5


def test_schemes():
    assert inventory.resolve("s3://b/k") == ("s3a", "s3a://b/k") and inventory.resolve("gs://b") == ("gs", "gs://b/") and inventory.resolve("x/y") == ("file", "x/y")
    for bad in ("ftp://x", "s3://bucket"):
        with pytest.raises(ValueError):
            inventory.resolve(bad)


def test_remote_failures_are_data(spark, tree, tmp_path):
    def connect():
        def call(text):
            if "1" in text:
                raise RuntimeError("refused")
            return text.upper()

        return call

    (tmp_path / "o").mkdir()
    got = copy(spark, f"{tree}/", f"{tmp_path}/o/", CopyOptions(detectors=[RemoteDetector(Provider("svc"), connect)]))
    assert got.asDict() == {"files_copied": 2, "files_redacted": 2, "files_skipped": 3}
    assert (tmp_path / "o" / "a.txt").read_text() == "MAIL A@B.ORG" and (tmp_path / "o" / "sub" / "t.csv").read_text().startswith("NAME")


def test_batches_of_tables_are_cut():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([b"x" * 1000] * 4999 + [b"y" * (3 << 20)])], ["n", "content"])
    cut = list(pieces([batch]))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and all(b.nbytes <= 2 << 20 or b.num_rows == 1 for b in cut)


def test_csv():
    assert parse_csv("a;b\n1;'x'\n", ";") == (["a", "b"], [["1", "'x'"]])
    assert parse_csv('1,"a,b"\n', header=False) == ([], [["1", "a,b"]])
    with pytest.raises(ValueError):
        parse_csv("a,b\n1\n")
    assert serialize_csv(["h"], [["a,b"], [None]]) == 'h\n"a,b"\n""\n' and serialize_csv([], [["1"]]) == "1\n"


def files(spark, *rows):
    made = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "relative_path string, content binary")
    return inventory.with_verdict(made.withColumn("file_size", F.length("content").cast("bigint")).withColumn("media_type", inventory.media.guess(F.col("relative_path"))))


def redacted(spark, rows, *detectors, **options):
    got = redact_files(files(spark, *rows), CopyOptions(detectors=detectors, **options)).collect()
    return {r["relative_path"]: (r["outcome"], r["content"] and bytes(r["content"]), r["error"], r["n_passes"]) for r in got}


def shout(word):
    def connect():
        def call(text):
            if "fail" in text:
                raise RuntimeError("refused")
            return text.replace(word, word.upper())

        return call

    return connect


def test_csv_goes_through_every_detector(spark):
    svc = RemoteDetector(Provider("svc", table=True), shout("john"))
    rows = [("t.csv", b"name,mail\njohn,a@b.org\n"), ("f.csv", b"name,mail\nfail,a@b.org\n"), ("q.csv", b'"a\n'), ("w.csv", b"a,b\n1\n")]
    got = redacted(spark, rows, RuleDetector(), svc)
    assert got["t.csv"] == ("Redacted", b"name,mail\nJOHN,[REDACTED]\n", None, 2)
    assert got["f.csv"] == ("Skipped", None, "refused", 0)
    assert "CSV" in got["q.csv"][2] and "fields" in got["w.csv"][2] and got["w.csv"][0] == "Skipped"
    assert redacted(spark, rows[:1], svc)["t.csv"][1] == b"name,mail\nJOHN,a@b.org\n"
    by_table = RemoteDetector(Provider("svc", table=True), connect_table=lambda: lambda h, r: (h, [[c.title() for c in x] for x in r]))
    assert redacted(spark, rows[:1], by_table)["t.csv"][1] == b"name,mail\nJohn,A@B.Org\n"


def test_csv_a_detector_that_takes_no_tables_fails_the_row(spark):
    got = redacted(spark, [("t.csv", b"a\nx\n")], RuleDetector(), RemoteDetector(Provider("svc", table=True)))
    assert got["t.csv"] == ("Skipped", None, "svc takes no tables", 0)


def test_csv_keeps_mode_and_deny_list(spark):
    rows = [("t.csv", b"m,l\na@b.org,DL-12345678\n"), ("t.txt", b"a@b.org,DL-12345678")]
    got = redacted(spark, rows, RuleDetector(rules=detect.ALL_RULES, mode="mask"))
    assert got["t.csv"][1] == b"m,l\nXXXXXXX,DL-12345678\n" and got["t.txt"][1] == b"XXXXXXX,DL-12345678"
    got = redacted(spark, rows, RuleDetector(rules=detect.ALL_RULES, denied=()), csv_synthetic_header=True)
    assert got["t.csv"][1] == b"m,l\n[REDACTED],[REDACTED]\n"
    long = b"a\n" + b"x" * 200_000 + b" c@d.org\n"
    assert redacted(spark, [("l.csv", long)], RuleDetector())["l.csv"][1].endswith(b"x [REDACTED]\n")
    assert redacted(spark, [("h.csv", b"1,2\n")], RuleDetector(), csv_header=False, csv_synthetic_header=True)["h.csv"][1] == b"Column 0,Column 1\n1,2\n"


WHITE = np.full((40, 200, 3), 255, np.uint8)


@pytest.fixture
def plugins():
    """A recogniser that reads words written into the first row of pixels, and PDFs that are pickled pages."""

    def ocr(pixels):
        said = bytes(pixels[0, :, 0]).split(b"\0")[0].decode().split(" ")
        return [(10.0 + 40 * k, 10.0, 30.0 + 40 * k, 20.0, w) for k, w in enumerate(said)]

    def split(data):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return [Page(images.decode_png(bytes.fromhex(x)), 100.0 + k, 50.0) for k, x in enumerate(data.decode().split("\n")[1:])]

    def merge(pages):
        return ("%PDF " + ",".join(f"{p.width:g}" for p in pages) + "".join("\n" + images.encode_png(p.pixels).hex() for p in pages)).encode()

    converters.install(ocr=ocr, split_pdf=split, merge_pdf=merge)
    yield
    converters.install(ocr=None, split_pdf=None, merge_pdf=None)


def shot(said):
    pixels = WHITE.copy()
    data = said.encode() + b"\0"
    pixels[0, : len(data), 0] = np.frombuffer(data, np.uint8)
    return images.encode_png(pixels)


def is_black(data, k):
    return bool((images.decode_png(data)[12:18, 12 + 40 * k : 28 + 40 * k] == 0).all())


def test_images_by_ocr(spark, plugins):
    rows = [("a.png", shot("mail a@b.org now")), ("b.png", b"cut"), ("c.jpg", shot("x")), ("d.txt", b"a@b.org"), ("e.png", shot("fail a@b.org"))]
    got = redacted(spark, rows, RuleDetector(), RemoteDetector(Provider("svc"), shout("mail")))
    assert got["a.png"][0] == "Redacted" and [is_black(got["a.png"][1], k) for k in range(3)] == [True, True, False]
    assert got["b.png"][0] == "Skipped" and "PNG" in got["b.png"][2]
    assert got["c.jpg"][:3] == ("Skipped", None, "no codec for image/jpeg") and got["e.png"][2] == "refused"
    assert got["d.txt"] == ("Redacted", b"[REDACTED]", None, 2)


def test_images_by_boxes_and_by_service(spark):
    boxes = RemoteDetector(Provider("open-ai-llm", images=True), shout("x"), connect_boxes=lambda: lambda png: '[{"x1":10,"y1":10,"x2":30,"y2":20}]')
    got = redacted(spark, [("a.png", shot("x")), ("b.png", b"")], boxes)
    assert is_black(got["a.png"][1], 0) and not is_black(got["a.png"][1], 1) and got["b.png"][0] == "Skipped"
    small = RemoteDetector(Provider("gemini-llm", images=True), connect_boxes=lambda: lambda png: "[]", resize=100)
    assert images.decode_png(redacted(spark, [("a.png", shot("x"))], small)["a.png"][1]).shape == (20, 100, 3)
    bad = RemoteDetector(Provider("svc", images=True), connect_boxes=lambda: lambda png: '[{"x1":10}]')
    assert redacted(spark, [("a.png", shot("x"))], bad)["a.png"][2] == "a box lacks a coordinate"
    whole = RemoteDetector(Provider("svc", images=("image/gif",)), connect_image=lambda: lambda data, mime: data + mime.encode())
    got = redacted(spark, [("a.gif", b"g"), ("b.png", shot("x"))], whole)
    assert got["a.gif"][:2] == ("Redacted", b"gimage/gif") and got["b.png"][0] == "Skipped"


def test_pdf_pages_in_order(spark, plugins):
    paper = ("%PDF" + "".join("\n" + shot(s).hex() for s in ("one a@b.org", "two", "three c@d.org"))).encode()
    got = redacted(spark, [("p.pdf", paper), ("q.pdf", b"none")], RuleDetector())
    outcome, data, error, passes = got["p.pdf"]
    assert (outcome, error, passes) == ("Redacted", None, 1) and data.startswith(b"%PDF 100,101,102")
    pages = [bytes.fromhex(x) for x in data.decode().split("\n")[1:]]
    assert [[is_black(p, k) for k in (0, 1)] for p in pages] == [[False, True], [False, False], [False, True]]
    assert got["q.pdf"][0] == "Skipped" and "no PDF" in got["q.pdf"][2]
    drop = RemoteDetector(Provider("svc", images=True), connect_image=lambda: lambda data, mime: None if b"\xff" * 3 in data[:0] or len(data) % 2 else data)
    kept = redacted(spark, [("p.pdf", paper)], drop)["p.pdf"]
    want = [k for k, s in enumerate(("one a@b.org", "two", "three c@d.org")) if len(images.encode_png(images.decode_png(shot(s)))) % 2 == 0]
    assert kept[0] == "Redacted" and kept[1].split(b"\n")[0] == b"%PDF " + ",".join(str(100 + k) for k in want).encode()


def test_limit_is_kept_by_all_tasks_together(spark, tmp_path):
    limit = throttle.Limit(100, 4)
    bucket = throttle.Bucket(throttle.parse_limit("15rpm"), 0)
    assert [bucket.delay(0) for _ in range(17)] == [0] * 15 + [4000, 4266]
    log = str(tmp_path / "log")

    def note(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    rows = files(spark, *[(f"{k}.txt", b"x") for k in range(12)]).withColumn("n_passes", F.when(F.col("relative_path") < "5", 1).otherwise(0)).coalesce(1)
    assert throttled(rows, limit, note).count() == 12
    n = rows.filter("n_passes > 0").count()
    waits = [float(x) for x in open(log)]
    # four tasks share the limit: one request at once and then one in 400 ms each
    assert len(waits) == n - 1 and min(waits) > 0.3


def test_clipboard_and_noop(spark, tree, tmp_path):
    board = inventory.Clipboard("mail a@b.org")
    assert copy(spark, "clipboard://", f"{tmp_path}/c.txt", CopyOptions(detectors=[RuleDetector()], clipboard=board))["files_redacted"] == 1
    assert (tmp_path / "c.txt").read_text() == "mail [REDACTED]"
    assert copy(spark, f"{tree}/a.txt", "clipboard://", CopyOptions(clipboard=board))["files_copied"] == 1
    assert (board.content, board.media_type) == ("mail a@b.org", "text/plain")
    for source, dest in (("clipboard://", f"{tmp_path}/d.txt"), ("noop://", f"{tmp_path}/d.txt"), (f"{tree}/a.txt", "noop://")):
        with pytest.raises(ValueError):
            copy(spark, source, dest)
    assert listing(spark, "noop://").count() == 0


def test_connections(spark, tree, tmp_path):
    folder, one = connect(spark, f"{tree}/"), connect(spark, f"file://{tree}/a.txt")
    assert folder.has_many and folder.accepts_many and not one.has_many and not one.accepts_many
    assert folder.names().count() == 5 and one.names().count() == 0 and one.read().first()["relative_path"] == "a.txt"
    assert folder.resolve("x/y").endswith("/src/x/y") and one.resolve("x/y").endswith("/a.txt")
    assert connect(spark, f"zip://{tmp_path}/z.zip").resolve("e") == f"{tmp_path}/z.zip:e"
    nothing = connect(spark, "noop://")
    assert nothing.list().count() == 0 and connect(spark, "clipboard://").list().count() == 0
    for act in (nothing.read, lambda: nothing.write(None), connect(spark, "clipboard://").read, lambda: connect(spark, "clipboard://").write(None), lambda: connect(spark, "ftp://x")):
        with pytest.raises(ValueError):
            act()
    assert converters.locate("a.txt", ["/none", str(tree)]) == f"{tree}/a.txt" and converters.locate("none", [str(tree)]) is None


def test_destinations():
    assert sinks.arrow_uri("s3a://b/k") == "s3://b/k" and sinks.arrow_uri("hdfs://h/k") == "hdfs://h/k" and sinks.arrow_uri("/x") == "/x"
    assert sinks.destination("/r/", "a/b") == "/r/a/b" and sinks.destination("/r", "a/b", single=True) == "/r"


def test_cli(spark, tree, tmp_path, capsys):
    (tmp_path / "o").mkdir()
    assert main(["cp", f"{tree}/", f"{tmp_path}/o/", "-d", "rules", "-f", "*.txt", "--save-json-results", f"{tmp_path}/r.json", "--limit-dlp-requests", "5rps"]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["files_redacted"] == 2
    assert main(["ls", f"{tree}/"]) == 0 and "5 files found" in capsys.readouterr().out
    assert main(["cp", f"{tree}/", f"{tmp_path}/o/", "-d", "gcp-dlp"]) == 1
    for ignored in (["-d", "rules", "--open-ai-model", "m"], ["--gcp-region", "r"], ["--limit-dlp-requests", "5rps"], ["-d", "rules", "--gcp-dlp-built-in-info-type", "NONE"], ["-d", "rules", "--gcp-dlp-stored-info-type", "x"]):
        assert main(["cp", f"{tree}/", f"{tmp_path}/o/", *ignored]) == 1
    assert main(["cp", f"{tree}/", f"{tmp_path}/o/", "-d", "rules", "--gcp-dlp-built-in-info-type", "US_DRIVER_LICENSE"]) == 0
