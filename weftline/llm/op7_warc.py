"""WARC archives and their index, by external merge.

Pages become WARC records, each compressed as gzip members of its own, so that
the offset in the index is a place in the file to which a reader can seek.
Every archive is a capture run of about ARCHIVE_BYTES, sorted by URL key and
timestamp, and is written by Spark's text writer, which passes bytes through.
Reading back takes a file record by record.  The index is merged as from sorted
runs on disk: the key space is split into ranges of about RANGE_ROWS rows, each
task takes from every run the part that falls in its range, and a loser tree
merges these k parts, so that the ranges in turn hold the capture histories in
global order.  The numbers of archives and ranges follow the data, so what a
task holds does not.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, only, scratch_dir, stage

MIN_REVISIT_BYTES = 100
#: Compressed bytes of one archive, and rows of the index in one range, about.
ARCHIVE_BYTES = 32 << 20
RANGE_ROWS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = 1_704_067_200  # 2024-01-01; pages have no time of their own
#: A gzip member ends with its uncompressed length, the last byte of which is
#: zero below this; a longer record is several members.
MEMBER_BYTES = 1 << 24
#: Bytes of an archive that are decompressed at a time.
FEED_BYTES = 1 << 13

_END = "\r\n"


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then path and query: captures of
    one site, and of one page, stand together."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://(?:www\\.)?|#.*$", "")
    host = F.regexp_extract(bare, "^[^/?:]*", 0)
    rest = F.regexp_replace(bare, "^[^/?:]*(?::\\d+)?", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def with_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: the page
    whose record this one revisits, or null."""
    p = only(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    same = p.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    both = p.join(same.where("n > 1").drop("n"), "payload_digest", "left")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return both.withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def capture_time(page_id: Column) -> Column:
    """A page's time of capture, from its id."""
    when = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(page_id, F.lit(0)) % 31_536_000)
    return F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record(page_id: Column, url: Column, html: Column, digest: Column, size: Column, refers_to: Column, captured: Column) -> Column:
    """The text of a record."""
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(_END))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(_END + _END))
    revisit = refers_to.isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(html))
    safe_url = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", " ")
    return F.concat(
        F.lit("WARC/1.1" + _END),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(page_id)),
        line("WARC-Date", captured),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END),
        block,
        F.lit(_END + _END),
    )


def _members(data: bytes) -> list[bytes]:
    """The gzip members that hold a record, each without its last byte, a zero."""
    out = []
    for at in range(0, len(data), MEMBER_BYTES - 1):
        z = zlib.compressobj(wbits=31)
        out.append(z.compress(data[at : at + MEMBER_BYTES - 1]) + z.flush())
    assert all(m.endswith(b"\0") for m in out)
    return [m[:-1] for m in out]


def _compressed(records: pd.Series) -> pd.Series:
    return pd.Series([b"\0".join(_members(x.encode("utf-8", "surrogatepass"))) for x in records])


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Sorted capture runs under path.  A null html is an empty payload; a null
    page_id is an empty name, and counts as after all others.  Pages are dealt
    to the runs by a hash, so a run is about archive_bytes long, but never less
    than one record."""
    p = with_decisions(pages).withColumn("key", url_key(F.col("url"))).withColumn("captured", capture_time(F.col("page_id")))
    text = record(*[F.col(c) for c in ("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to", "captured")])
    packed = F.pandas_udf(_compressed, T.BinaryType())(text)
    p = stage(p.select("key", "captured", "page_id", packed.alias("packed")), "warc-records")
    total = p.agg(F.coalesce(F.sum(F.octet_length("packed")), F.lit(0))).first()[0]
    runs = p.repartition(max(1, -(-total // archive_bytes)), F.xxhash64("key", "captured", "page_id", "packed"))
    runs = runs.sortWithinPartitions("key", "captured", F.col("page_id").asc_nulls_last())
    # the writer puts the separator after every value: the zero that ends a member
    runs.select(F.col("packed").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    discard(p)


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length (in the file), headers and block of each record of an
    archive; one record is held at a time."""
    at = 0
    while at < len(data):
        start, text, size = at, bytearray(), None
        while size is None or len(text) < size:
            z = zlib.decompressobj(wbits=31)
            while not z.eof:  # where a member ends isn't known beforehand
                part = data[at : at + FEED_BYTES]
                if not part:
                    raise ValueError(f"the record at {start} has no end")
                text += z.decompress(part)
                at += len(part) - len(z.unused_data)
            if size is None:
                end = text.index(b"\r\n\r\n")
                head = dict(x.split(": ", 1) for x in text[:end].decode("utf-8", "replace").split(_END)[1:])
                size = end + 4 + int(head["Content-Length"]) + 4
        yield start, at - start, head, bytes(text[end + 4 : size - 4])


def _page(name: str | None) -> int | None:
    bare = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(bare) if bare else None


_INDEX = "run string, seq long, offset long, length long, url string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _INDEX.split(", "))])
#: Rows of the index that are handed on together.
BATCH_ROWS = 10_000


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            path, out = path.as_py(), []
            for seq, (at, size, head, block) in enumerate(parse_archive(content.as_buffer().to_pybytes())):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, n = head["WARC-Type"], int(http.rsplit(b": ", 1)[1])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                    raise ValueError(f"{path}: the payload at {at} is not what its header says")
                out.append((path.rsplit("/", 1)[-1], seq, at, size, head["WARC-Target-URI"], head["WARC-Date"], _page(head["WARC-Record-ID"]), kind, n, digest, _page(head.get("WARC-Refers-To"))))
                if len(out) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record; a response's digest and length are those of the
    payload that was read, and must be what its header says."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(_parsed, _INDEX)


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs.  Inner nodes keep the loser of their match, so a step
    replays only the path of the run that won: log2(k) comparisons."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k
    key = lambda r: (0, runs[r][at[r]], r) if at[r] < len(runs[r]) else (1, (), r)
    loser, winner = [0] * k, [0] * (2 * k)
    for r in range(k):
        winner[k + r] = r
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if key(a) <= key(b) else (b, a)
    best = winner[1] if k > 1 else 0
    while at[best] < len(runs[best]):
        yield runs[best][at[best]]
        at[best] += 1
        node = (k + best) // 2
        while node:
            if key(loser[node]) < key(best):
                loser[node], best = best, loser[node]
            node //= 2


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index (about RANGE_ROWS rows, by run and in the run's
    order) in global order."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    column = lambda name: rows[name].to_pylist()
    # only keys and places are compared; a null id comes last
    keys = [(key, captured, page is None, page or 0, k) for k, (key, captured, page) in enumerate(zip(column("url_key"), column("captured"), column("page_id")))]
    run = column("run")
    bounds = [0, *(k for k in range(1, len(run)) if run[k] != run[k - 1]), len(run)]
    order = pa.array([x[-1] for x in loser_tree_merge([keys[a:b] for a, b in zip(bounds, bounds[1:])])], pa.int64())
    rows = rows.drop_columns("seq")
    for at in range(0, len(order), BATCH_ROWS):
        yield from rows.take(order[at : at + BATCH_ROWS]).combine_chunks().to_batches()


def merge_index(records: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order of url_key, captured, page_id (null last)."""
    keyed = stage(records.withColumn("url_key", url_key(F.col("url"))), "warc-index")
    ranges = max(1, -(-keyed.count() // range_rows))
    # run and seq let rows of one key and time be split
    ranged = keyed.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_last(), "run", "seq").sortWithinPartitions("run", "seq")
    columns = [f"{n} {t}" for n, t in ranged.dtypes if n != "seq"]
    return ranged.mapInArrow(_merged, ", ".join(columns).replace("bigint", "long"))


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives, read them back and merge the index.

    Columns: run, offset, length (of the record in the file), url, captured, page_id, record_type,
    payload_bytes, payload_digest, refers_to, url_key.  Of records with equal
    payloads of MIN_REVISIT_BYTES or more the smallest page_id is the response;
    rows that repeat that id and payload are responses too, and where every id
    is null all are.  Very long pages are records of several gzip members.  An
    empty table gives an empty result; columns of pages
    other than page_id, url and html fall away.
    """
    path = path or f"{scratch_dir(pages.sparkSession)}/weftline/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return merge_index(read_archives(pages.sparkSession, path))
