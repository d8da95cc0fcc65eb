import base64
import json

import numpy as np
import pytest

from umbra.operators import images, services
from umbra.operators.converters import installed
from umbra.operators.providers import detector, strict_boxes

PNG = images.encode_png(np.full((20, 30, 3), 255, np.uint8))


def answering(*answers, status=200, kind="application/json"):
    """A transport that notes what it is sent and answers in turn."""
    sent, left = [], list(answers)

    def send(url, headers, body):
        sent.append((url, headers, body))
        return status, kind, (left.pop(0) if len(left) > 1 else left[0])

    return sent, lambda: send


def as_json(x):
    return json.dumps(x).encode()


def test_presidio():
    found = [{"entity_type": "PERSON", "start": 7, "end": 11}, {"entity_type": "US_DRIVER_LICENSE", "start": 0, "end": 5}, {"entity_type": "X", "start": None, "end": None}]
    sent, transport = answering(as_json(found))
    d = services.presidio_detector(transport, "http://t", "http://i")
    assert d.connect()("Hello, John é") == "Hello, XXXX é"
    assert json.loads(sent[0][2]) == {"text": "Hello, John é", "language": "en"} and sent[0][0] == "http://t"
    sent, transport = answering(b"IMG", kind="image/png")
    assert services.presidio_detector(transport, None, "http://i").connect_image()(PNG, "image/png") == b"IMG"
    assert PNG in sent[0][2] and b'name="image"' in sent[0][2] and sent[0][1]["Content-Type"].startswith("multipart/form-data")
    with pytest.raises(ValueError):
        services.presidio_detector(transport)
    assert services.presidio_detector(transport, "http://t").connect_image is None


@pytest.mark.parametrize("status, kind", [(500, "application/json"), (200, "text/html"), (200, "application/json; charset=utf-8")])
def test_what_is_no_json_success_is_an_error(status, kind):
    _, transport = answering(b"[]", status=status, kind=kind)
    with pytest.raises(ValueError):
        services.presidio_detector(transport, "http://t").connect()("x")


def test_comprehend():
    sent, transport = answering(as_json({"Entities": [{"Type": "NAME", "BeginOffset": 0, "EndOffset": 4}]}))
    assert services.comprehend_detector(transport, "eu-west-1").connect()("John here") == "XXXX here"
    assert json.loads(sent[0][2])["LanguageCode"] == "en" and "eu-west-1" in sent[0][0]


def test_dlp():
    sent, transport = answering(as_json({"item": {"value": "[REDACTED]"}}))
    d = services.dlp_detector(transport, "p", ["OWN"], ["stored"])
    assert d.connect()("John") == "[REDACTED]"
    asked = json.loads(sent[0][2])
    assert len(asked["inspectConfig"]["infoTypes"]) == 21 and {"name": "OWN"} in asked["inspectConfig"]["infoTypes"]
    assert asked["inspectConfig"]["customInfoTypes"][0]["storedType"]["name"] == "projects/p/storedInfoTypes/stored"
    table = {"item": {"table": {"headers": [{"name": "a"}], "rows": [{"values": [{"stringValue": "[REDACTED]"}]}]}}}
    _, transport = answering(as_json(table))
    assert services.dlp_detector(transport, "p").connect_table()(["a"], [["x"]]) == (["a"], [["[REDACTED]"]])
    assert services.dlp_detector(transport, "p").connect_table()([], [["x"]]) == ([], [["[REDACTED]"]])
    with pytest.raises(ValueError):
        services.dlp_detector(transport, "p").connect_table()(["a"], [["x"], ["y"]])
    sent, transport = answering(as_json({"redactedImage": base64.b64encode(b"out").decode()}))
    assert services.dlp_detector(transport, "p").connect_image()(PNG, "image/png") == b"out"
    assert json.loads(sent[0][2])["byteItem"]["type"] == "IMAGE_PNG"


def test_open_ai():
    sent, transport = answering(as_json({"choices": [{"message": {"content": "hi [REDACTED]"}}]}))
    d = services.open_ai_detector(transport, "key", "m")
    assert d.connect()("hi John") == "hi [REDACTED]" and sent[0][1]["Authorization"] == "Bearer key"
    messages = json.loads(sent[0][2])["messages"]
    assert messages[1] == messages[3] and messages[1]["content"][0]["text"] in messages[0]["content"][0]["text"] and messages[2]["content"][0]["text"] == "hi John"
    _, transport = answering(as_json({"choices": [{"message": {"content": json.dumps({"boxes": [{"x1": 1, "y1": 2, "x2": 3, "y2": 4}]})}}]}))
    assert strict_boxes(services.open_ai_detector(transport, "key").connect_boxes()(PNG)) == [(1, 2, 3, 4)]
    _, transport = answering(as_json({"choices": []}))
    with pytest.raises(ValueError):
        services.open_ai_detector(transport, "key").connect()("x")


def test_gemini_and_vertex(spark):
    parts = lambda *p: as_json({"candidates": [{"content": {"parts": list(p)}}]})
    sent, transport = answering(parts({"text": "a"}, {"inlineData": {"data": ""}}, {"text": "b"}))
    assert services.gemini_detector(transport, "p").connect()("x") == "ab"
    assert json.loads(sent[0][2])["generationConfig"] == {"candidateCount": 1, "temperature": 0.2}
    sent, transport = answering(parts({"text": "[]"}))
    assert services.vertex_detector(transport, "p", "r", gcp_vertex_ai_block_none_harmful=True).connect_boxes()(PNG) == "[]"
    asked = json.loads(sent[0][2])
    assert {s["threshold"] for s in asked["safetySettings"]} == {"BLOCK_NONE"} and len(asked["safetySettings"]) == 4 and "projects/p/locations/r" in sent[0][0]
    assert "30 pixels wide and 20 high" in asked["contents"][0]["parts"][0]["text"]
    one, two = (base64.b64encode(x).decode() for x in (b"one", b"two"))
    sent, transport = answering(parts({"text": "here"}, {"inlineData": {"data": one}}, {"inlineData": {"data": two}}))
    native = services.vertex_detector(transport, "p", "r", gcp_vertex_ai_native_image_support=True)
    assert native.connect_image()(PNG, "image/png") == b"one" and native.connect_boxes is None
    assert json.loads(sent[0][2])["generationConfig"]["temperature"] == 1.0
    for empty in (as_json({}), parts({"text": "no"})):
        _, transport = answering(empty)
        with pytest.raises(ValueError):
            services.vertex_detector(transport, "p", "r", gcp_vertex_ai_native_image_support=True).connect_image()(PNG, "image/png")


def test_installed_services_run_in_a_plan(spark):
    def transport():
        return lambda url, headers, body: (200, "application/json", json.dumps([{"entity_type": "PERSON", "start": 0, "end": len(json.loads(body)["text"]) - 1}]).encode())

    services.install("ms-presidio", transport)
    d = detector("ms-presidio", ms_presidio_text_analyze_url="http://t")
    df = spark.createDataFrame([("John!",), (None,)], "t string")
    assert [r["t"] for r in d.redact(df, "t").collect()] == ["XXXX!", None]
    pictures = spark.createDataFrame([("a", 0, "image/png", None, None, bytearray(PNG), None)], "relative_path string, page int, media_type string, width double, height double, content binary, error string")
    assert d.redact_pictures(pictures, installed()).first()["error"] == "ms-presidio takes no images"


def test_command_line_names_what_it_needs(spark, tmp_path, capsys):
    from umbra.cli import main

    (tmp_path / "a.txt").write_text("John")
    assert main(["cp", f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", "-d", "gcp-dlp", "--gcp-project-id", "p"]) == 1
    assert "transport" in capsys.readouterr().err
    assert main(["cp", f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", "-d", "open-ai-llm", "--open-ai-api-key", "k"]) == 0  # no network: the file is skipped
    assert not (tmp_path / "b.txt").exists() and "1 skipped" in capsys.readouterr().out
