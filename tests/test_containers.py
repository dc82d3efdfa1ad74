"""Containers of our own making, and the machines of jobs and saves."""

import json

import pytest

from parchment.sources import container as C
from parchment.streaming.jobs import coalesce, step

MANIFEST = json.dumps({"parchm": {"format_version": "1.0", "container_profile": "prefixed"}, "layers": {"content": {"path": "c.json", "sha256": "x"}}}).encode()


def made():
    return C.pack([("manifest.json", MANIFEST), ("c.json", b"{}"), ("a/b.bin", b"x" * 5000)])


def test_open_write_and_overlay():
    data = made()
    c = C.open_container(data)
    assert c.names() == ["manifest.json", "c.json", "a/b.bin"] and not c.warnings
    assert c.write() is data
    c.set("c.json", b"[1]")
    again = C.open_container(c.write())
    assert again.read("c.json") == b"[1]"
    assert json.loads(again.read("manifest.json"))["layers"]["content"]["sha256"] != "x"


def test_header_extension_is_kept():
    header = C.Header("PARCHM", size=40, zip_offset=40, extension=b"12345678")
    c = C.open_container(C.pack([("manifest.json", MANIFEST)], header=header))
    c.set("new", b"y")
    assert C.parse_header(c.write())[0].extension == b"12345678"


def test_refusals():
    data = made()
    with pytest.raises(C.Refused, match="too new"):
        C.open_container(C.Header("PARCHM", major=2).to_bytes() + data[32:])
    with pytest.raises(C.Refused, match="not a container"):
        C.open_container(b"hello" * 20)
    with pytest.raises(C.Refused, match="manifest"):
        C.open_container(C.pack([("x", b"1")]))
    with pytest.raises(C.Refused, match="compressed more"):
        C.open_container(C.pack([("manifest.json", MANIFEST), ("bomb", b"\0" * 10_000_000)]))
    damaged = bytearray(data)
    damaged[25] ^= 1
    assert C.open_container(bytes(damaged)).warnings == ["header checksum is wrong"]
    assert C.open_container(data[32:]).warnings == ["prefix is missing"]


def test_recovery_in_both_modes():
    data = made()
    assert {r["mode"] for r in C.recover(data)} == {"central"}
    scanned = C.recover(data[:-120])
    assert [(r["name"], r["ok"]) for r in scanned] == [("manifest.json", True), ("c.json", True), ("a/b.bin", True)]
    assert {r["mode"] for r in scanned} == {"scan"} and scanned[2]["bytes"] == b"x" * 5000
    assert C.recover(b"nothing") == []
    assert C.safe_path("../../etc/x") == "etc/x"


def test_job_machine():
    run = lambda events: [p := None] and [p := step(p, e)[0] for e in events]
    assert run(["start", "run", "commit", "succeed", "start"]) == ["queued", "running", "committing", "succeeded", "queued"]
    assert run(["start", "run", "cancel", "commit"]) == ["queued", "running", "cancelling", "cancelled"]
    assert run(["start", "run", "commit", "cancel", "succeed"])[-2:] == ["committing", "succeeded"]
    assert step("running", "start") == ("running", False)


def test_save_coalescing():
    state, out = (False, False), []
    for e in ("save", "save", "save", "done", "done", "done"):
        *state, action = coalesce(*state, e)
        out.append(action)
    assert out == ["begin", "wait", "fold", "begin", "idle", "idle"]
