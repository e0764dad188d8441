"""Fetching by ranges, resuming, digests, lines over chunk edges, and archives by member. A server on this host takes part."""

from __future__ import annotations

import hashlib
import http.server
import random
import threading
import zipfile
from pathlib import Path

import pytest

from tessera.sources import landing

MANIFEST = "name string, url string, size long, sha256 string"


class Ranged(http.server.BaseHTTPRequestHandler):
    files: dict[str, bytes] = {}
    broken: set[int] = set()
    served: list[tuple[str, int, int]] = []

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.files[self.path])))
        self.end_headers()

    def do_GET(self):
        begin, end = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        if any(begin <= b <= end for b in self.broken):
            self.send_response(503)
            self.end_headers()
            return
        self.served.append((self.path, begin, end))
        self.send_response(206)
        data = self.files[self.path][begin : end + 1]
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def server(monkeypatch):
    monkeypatch.setattr(landing, "PAUSE", 0.0)
    Ranged.files, Ranged.broken, Ranged.served = {}, set(), []
    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranged)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def states(df):
    return {r["name"]: (r["landed"], r["state"]) for r in df.collect()}


def test_a_broken_transfer_goes_on_with_what_is_missing(spark, tmp_path, server):
    data = random.Random(1).randbytes(300_000)
    Ranged.files = {"/a.bin": data, "/empty": b""}
    root = f"file://{tmp_path}/root"
    manifest = spark.createDataFrame([("x/a.bin", f"{server}/a.bin", None, hashlib.sha256(data).hexdigest()), ("empty", f"{server}/empty", None, None)], MANIFEST)
    Ranged.broken = {100_000}
    first = states(landing.land(manifest, root, 65_536))
    assert first == {"x/a.bin": (65_536, "missing"), "empty": (0, "complete")}
    Ranged.broken, before = set(), len(Ranged.served)
    assert states(landing.land(manifest, root, 65_536)) == {"x/a.bin": (300_000, "complete"), "empty": (0, "complete")}
    assert {b // 65_536 for _, b, _ in Ranged.served[before:]} == {1}
    before = len(Ranged.served)
    assert states(landing.land(manifest, root, 65_536))["x/a.bin"] == (300_000, "complete") and len(Ranged.served) == before
    plain = landing.exported(spark, root, "x/a.bin").removeprefix("file://")
    assert Path(plain).read_bytes() == data and not Path(f"{plain}.part").exists()


def test_a_wrong_digest_is_told_and_fetched_anew(spark, tmp_path, server):
    Ranged.files = {"/a": b"wrong" * 1000, "/b": b"right" * 1000}
    root = f"file://{tmp_path}/root"
    rows = [("a", f"{server}/a", 5000, hashlib.sha256(b"other" * 1000).hexdigest()), ("b", f"{server}/b", 5000, hashlib.sha256(b"right" * 1000).hexdigest())]
    manifest = spark.createDataFrame(rows, MANIFEST)
    assert states(landing.land(manifest, root, 2048)) == {"a": (5000, "digest differs"), "b": (5000, "complete")}
    Ranged.files["/a"], before = b"other" * 1000, len(Ranged.served)
    assert states(landing.land(manifest, root, 2048)) == {"a": (5000, "complete"), "b": (5000, "complete")}
    assert {p for p, _, _ in Ranged.served[before:]} == {"/a"}
    assert landing.held(spark, root).where("name = 'b'").count() == 3


def test_a_file_without_all_its_bytes_is_not_exported(spark, tmp_path, server):
    Ranged.files = {"/a": b"0123456789" * 100}
    Ranged.broken = {0}
    root = f"file://{tmp_path}/root"
    assert states(landing.land(spark.createDataFrame([("a", f"{server}/a", None, None)], MANIFEST), root, 256)) == {"a": (0, "missing")}
    with pytest.raises(landing.LandingError, match="lacks the bytes from 0"):
        landing.exported(spark, root, "a")


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../../x", "", ".", "a\\b", "s3://x/y", "a\0"])
def test_names_that_leave_the_root_are_refused(spark, tmp_path, name):
    with pytest.raises(landing.LandingError):
        landing.within(name)
    with pytest.raises(landing.LandingError):
        landing.land(spark.createDataFrame([(name, "file:///nowhere", 1, None)], MANIFEST), f"file://{tmp_path}/root")
    assert landing.within("a/./b//c.txt") == "a/b/c.txt"


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 10_000])
def test_lines_over_the_edges_of_chunks(spark, tmp_path, chunk):
    texts = {"t1": "one\n\ntwo é\n\n\nlonger line here\nlast", "t2": "ends\n", "t3": "", "t4": "\n\n", "t5": "no break"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    manifest = spark.createDataFrame([(n, f"file://{tmp_path}/{n}", None, None) for n in texts], MANIFEST)
    root = f"file://{tmp_path}/root"
    landing.land(manifest, root, chunk)
    got: dict[str, list] = {}
    for r in sorted(landing.lines(landing.held(spark, root)).collect(), key=lambda r: (r["name"], r["at"])):
        got.setdefault(r["name"], []).append((r["at"], r["text"]))
    for name, text in texts.items():
        want, at = [], 0
        for line in text.splitlines(keepends=True):
            want.append((at, line.rstrip("\n")))
            at += len(line.encode())
        assert got.get(name, []) == want


def test_members_are_read_by_a_task_each(spark, tmp_path, server):
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(5):
            z.writestr(f"m{k}.kab", "".join(f"line {i} of {k}\r\n" for i in range(10_000)))
        z.writestr("other.xml", "<x/>")
        z.writestr("none.kab", "")
    rows = landing.zip_members(spark, str(tmp_path / "b.zip"), ".kab")
    assert rows.rdd.getNumPartitions() == 6
    assert sorted((r["member"], r["n"], r["last"]) for r in rows.groupBy("member").agg({"line": "max", "text": "count"}).toDF("member", "last", "n").collect()) == [(f"m{k}.kab", 10_000, 9_999) for k in range(5)]
    assert rows.where("member = 'm3.kab' AND line = 77").first()["text"] == "line 77 of 3"
    # a remote archive is read by ranges, not fetched
    Ranged.files = {"/b.zip": (tmp_path / "b.zip").read_bytes()}
    spark.dataSource.register(landing.ZipMembers)
    remote = spark.read.format("zip_members").option("bundles", f'["{server}/b.zip"]').option("suffixes", '["m1.kab"]').load()
    assert remote.count() == 10_000
    assert sum(e - b + 1 for _, b, e in Ranged.served) < len(Ranged.files["/b.zip"]) * 2
