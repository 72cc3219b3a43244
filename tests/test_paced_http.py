"""The data source of sitemaps against a server of this machine."""

from __future__ import annotations

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from rosterline.operators.ranked import shared_path
from rosterline.sources.paced_http import register


def urls(kind, rows):
    items = "".join(f"<{kind}><loc>{loc}</loc>{f'<lastmod>{t}</lastmod>' if t else ''}</{kind}>" for loc, t in rows)
    return f'<x xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{items}</x>'


@pytest.fixture
def site():
    pages, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.time(), self.headers["Host"], self.path))
            body = pages.get((self.headers["Host"], self.path))
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    a, b = f"127.0.0.1:{server.server_port}", f"localhost:{server.server_port}"
    for host in (a, b):
        listed = [(f"http://{host}/p{i}", f"2024-01-0{i + 1}T00:00:00Z") for i in range(3)]
        pages[host, "/map.xml"] = urls("url", listed)
        pages |= {(host, f"/p{i}"): f"page {i}" for i in range(3)}
    pages[b, "/bad.xml"] = "<no"
    pages[a, "/index.xml"] = urls("sitemap", [(f"http://{a}/map.xml", "2024-01-03"), (f"http://{b}/map.xml", "2024-01-03"), (f"http://{b}/bad.xml", None)])
    del pages[b, "/p2"]
    yield a, b, pages, asked
    server.shutdown()


def read(spark, a, **options):
    register(spark)
    return spark.read.format("paced_http").option("index", f"http://{a}/index.xml").options(delay=0.05, attempts=1, **options).load()


def test_batch(spark, site):
    a, b, pages, asked = site
    got = {(r.host, r.url.rsplit("/", 1)[1]): (r.body, r.error) for r in read(spark, a).collect()}
    assert got.pop((b, "bad.xml"))[1].startswith("no sitemap")
    assert got == {(h, f"p{i}"): (f"page {i}", None) for h in (a, b) for i in range(3)} | {(b, "p2"): (None, "HTTP 404")}
    for host in (a, b):
        times = [t for t, h, p in asked if h == host and p.startswith("/p")]
        assert all(y - x >= 0.045 for x, y in zip(times, times[1:], strict=False))


def test_filters_spare_requests(spark, site):
    a, b, pages, asked = site
    rows = read(spark, a).filter((F.col("host") == a) & F.col("url").isin(f"http://{a}/p1", f"http://{b}/p1") & F.col("body").contains("1"))
    assert [r.url for r in rows.collect()] == [f"http://{a}/p1"]
    assert {(h, p) for _, h, p in asked if not p.endswith(".xml")} == {(a, "/p1")} and not any(h == b for _, h, _ in asked)


def test_stream_goes_on(spark, site):
    a, b, pages, asked = site
    register(spark)
    out, checkpoint = shared_path(spark, "pages"), shared_path(spark, "offsets")

    def run():
        stream = spark.readStream.format("paced_http").option("index", f"http://{a}/index.xml").options(delay=0.01, attempts=1).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
        assert query.awaitTermination(60)
        return sorted(r.url.split("//")[1] for r in spark.read.schema(stream.schema).parquet(out).collect())

    assert run() == sorted(f"{h}/p{i}" for h in (a, b) for i in range(3))
    pages[a, "/p9"] = "new"
    pages[a, "/map.xml"] = urls("url", [(f"http://{a}/p0", "2024-01-01"), (f"http://{a}/p9", "2024-02-01")])
    pages[a, "/index.xml"] = urls("sitemap", [(f"http://{a}/map.xml", "2024-02-01"), (f"http://{b}/map.xml", "2024-01-03")])
    asked.clear()
    assert run() == sorted([*(f"{h}/p{i}" for h in (a, b) for i in range(3)), f"{a}/p9"])
    assert {p for _, h, p in asked} == {"/index.xml", "/map.xml", "/p9"} and all(h == a for _, h, _ in asked)


def test_no_index(spark, site):
    register(spark)
    with pytest.raises(Exception, match="index"):
        spark.read.format("paced_http").load().collect()
    with pytest.raises(Exception, match="404"):
        spark.read.format("paced_http").option("index", f"http://{site[0]}/absent").options(delay=0, attempts=1).load().collect()
