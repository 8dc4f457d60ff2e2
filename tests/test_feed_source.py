"""Feeds as a batch and a stream source: cached, offline and from a server on this machine."""

import functools
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources import feed_source
from weftline.sources.feeds import HttpClient


def articles(*names):
    return json.dumps({"articles": [{"url": n, "title": f"Title {n}", "domain": "d", "seendate": "2024"} for n in names]})


CATALOG = json.dumps([["one", "https://example.com/1", "gdelt"], ["two", "https://example.com/2", "gdelt"], ["gone", "https://example.com/3", "gdelt"]])


def fill(spark, cache, number, **by_feed):
    urls = {n: u for n, u, _ in json.loads(CATALOG)}
    feed_source.fill_cache(spark.createDataFrame([(urls[n], c) for n, c in by_feed.items()], "url string, content string"), str(cache), number)


def test_batch_has_a_partition_for_each_feed_and_errors_as_rows(spark, tmp_path):
    fill(spark, tmp_path, -1, one=articles("a", "b"), two=articles("b", "c"))
    got = feed_source.payloads(spark, cache=str(tmp_path), offline=True, catalog=CATALOG, feeds="one,two,gone,unknown")
    parts = {r["feed"]: (r["part"], r["error"], r["content"]) for r in got.withColumn("part", F.spark_partition_id()).collect()}
    assert len({p for p, _, _ in parts.values()}) == 4
    assert parts["one"][1] is None and parts["gone"][1].startswith("RuntimeError: offline") and parts["unknown"][1].startswith("KeyError")
    reports, errors = feed_source.collect(spark, HttpClient(str(tmp_path), offline=True), limit_per=1, catalog=CATALOG)
    assert sorted(r["text"] for r in reports.collect()) == ["Title a (d)", "Title b (d)"] and [e["feed"] for e in errors.collect()] == ["gone"]


def run(spark, frame, name, checkpoint, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_stream_reads_each_kept_fetch_once(spark, tmp_path):
    cache, at = tmp_path / "cache", f"file://{tmp_path}/checkpoint"
    fill(spark, cache, 0, one=articles("a", "b"), two=articles("x"))
    fill(spark, cache, 1, one=articles("b", "c"), two=articles("x"))
    options = {"cache": str(cache), "offline": True, "catalog": CATALOG}
    spark.dataSource.register(feed_source.FeedSource)
    raw = spark.readStream.format("feeds").options(**{k: str(v).lower() if v is True else v for k, v in options.items()}).load()
    got = [(r["feed"], r["fetch"], r["error"] is None) for r in run(spark, raw.select("feed", "fetch", "error"), "raw_feeds", f"{at}/raw").collect()]
    assert sorted(got) == sorted([(f, n, f != "gone") for n in (0, 1) for f in ("one", "two", "gone")])
    texts = lambda t: sorted(r["text"] for r in t.collect())
    assert texts(run(spark, feed_source.stream_reports(spark, **options), "stream_feeds", f"{at}/dedup")) == ["Title a (d)", "Title b (d)", "Title c (d)", "Title x (d)"]
    # begun again from its checkpoint it reads the new fetch only, and remembers the old reports
    fill(spark, cache, 2, one=articles("c", "d"), two=articles("x"))
    out = f"{tmp_path}/out"
    again = feed_source.stream_reports(spark, **options)
    for _ in range(2):
        q = again.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{at}/files").start()
        q.processAllAvailable()
        q.stop()
        fill(spark, cache, 3, one=articles("e", "a"))
    assert texts(spark.read.parquet(out)) == [f"Title {n} (d)" for n in "abcdex"]


@pytest.fixture
def server(tmp_path):
    folder = tmp_path / "www"
    folder.mkdir()
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(folder))
    handler.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield folder, f"http://127.0.0.1:{s.server_port}"
        s.shutdown()


def test_fetching_fills_the_cache_and_replays_read_it(spark, tmp_path, server):
    folder, url = server
    catalog = json.dumps([["live", f"{url}/a.json", "gdelt"], ["lost", f"{url}/none.json", "gdelt"]])
    (folder / "a.json").write_text(articles("a"))
    options = {"cache": str(tmp_path / "cache"), "catalog": catalog}
    read = lambda **o: {r["feed"]: (r["content"], (r["error"] or "").split(":")[0]) for r in feed_source.payloads(spark, **options, **o).collect()}
    assert read() == {"live": (articles("a"), ""), "lost": (None, "HTTPError")}
    (folder / "a.json").write_text(articles("b"))
    assert read(offline=True)["live"][0] == articles("a")
    assert read()["live"][0] == articles("b")
    # a stream's batch that runs again reads what its fetch kept, not what the server has by now
    feeds = feed_source._Feeds({**options})
    (fetch, _) = feeds.fetches(5)
    first = list(feeds.rows(fetch))
    (folder / "a.json").write_text(articles("c"))
    assert list(feeds.rows(fetch)) == first and first[0][6] == articles("b")
    stream = feed_source.FeedStream({**options, "interval": "1000"})
    assert stream.initialOffset() == {"fetch": -1} and stream.latestOffset() == {"fetch": 5}
    assert feed_source.FeedStream({**options, "interval": "0"}).latestOffset() == {"fetch": 6}
