"""Fetching from a small server on this machine."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from filingloom.sources import http


class Archive(BaseHTTPRequestHandler):
    seen: Counter = Counter()
    agents: set = set()
    times: list = []

    def do_GET(self):
        self.seen[self.path] += 1
        self.agents.add((self.headers["User-Agent"], self.headers.get("Accept-Encoding")))
        self.times.append(time.monotonic())
        busy = self.path.startswith("/busy") and self.seen[self.path] <= 2 or self.path == "/down"
        status = 503 if busy else 404 if self.path == "/none" else 200
        self.send_response(status)
        if busy:
            self.send_header("Retry-After", "0")
        self.end_headers()
        if status == 200:
            self.wfile.write(f"document {self.path}".encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def archive():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Archive.seen.clear()
    Archive.agents.clear()
    Archive.times.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetching(spark, archive):
    paths = ["/a", "/b", "/busy1", "/none", "/down"]
    listing = spark.createDataFrame([(p, archive + p) for p in paths] + [("bad", "no url"), ("null", None)], "id string, locator string")
    got = {r.id: (r.content and bytes(r.content).decode(), r.error) for r in http.fetch_documents(listing, "Ann Lee ann@example.com", rate=200.0, lanes=2, most=2).collect()}
    assert {p: got[p] for p in ("/a", "/b", "/busy1")} == {p: (f"document {p}", None) for p in ("/a", "/b", "/busy1")}
    assert "404" in got["/none"][1] and "503" in got["/down"][1] and got["bad"][1].startswith("ValueError") and got["null"] == (None, got["null"][1])
    assert (Archive.seen["/none"], Archive.seen["/down"], Archive.seen["/busy1"]) == (1, 3, 3)
    assert {a for a, _ in Archive.agents} == {"Ann Lee ann@example.com"}
    with pytest.raises(ValueError, match="user agent"):
        http.fetch_documents(listing, "ann@example.com")


def test_the_rate_is_kept(spark, archive):
    listing = spark.createDataFrame([(f"{archive}/{i}",) for i in range(30)], "locator string")
    assert http.fetch_documents(listing, "Ann Lee ann@example.com", rate=20.0, lanes=3).count() == 30
    http.fetch_documents(listing, "Ann Lee ann@example.com", rate=20.0, lanes=3).select("content").collect()
    times = sorted(Archive.times)[-30:]
    assert times[-1] - times[0] > 0.75  # ten a lane at 20/3 a second, were they dealt evenly


def test_waiting():
    waits = []

    def opener(request, timeout):
        raise http.urllib.error.URLError("no way")

    with pytest.raises(http.urllib.error.URLError):
        http.get("http://x/", "a b@c.d", most=3, opener=opener, sleep=waits.append, chance=lambda: 1.0)
    assert waits == [1.5, 2.5, 4.5]
    assert [http.pause(2, s, 0.25) for s in ("7", "-3", "soon", None)] == [7.0, 0.0, 4.25, 4.25]
    assert [http.busy(s) for s in (200, 403, 404, 429, 500, 503)] == [False, True, False, True, True, True]
