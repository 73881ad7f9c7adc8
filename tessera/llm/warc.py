"""WARC archives of pages, and the external merge of their index runs.

Spark's text writer lays down one record per row, ended by the two line ends that close a WARC record, so
archives go through the usual task commit and survive lost executors. Records are written by size class, so many to a
file that no file of several records passes 64 MB; classes without records cost no pass. Archives are read back file by file and parsed; the captures
of a task's files, sorted by URL key, time and page_id, are runs of up to `RUN` captures. Ranges of keys gather their part of
every run, and a loser tree merges the runs of a range; ranges in order are the global order, and each capture gets its position in it
from its place in its range and a table of where ranges begin.

Of records with equal payloads of `least` bytes or more the one with the largest page_id is the response, others revisit it.
Rows that share that page_id are all responses. Null html is an empty payload; a null url an empty URL; rows with a null page_id are
responses. An empty table gives no rows. Columns other than page_id, url and html are passed over.
Record ids are made of page_id and a digest of URL and payload, so rows that are alike in all of them share one.
Pages carry no time of capture: WARC-Date, in UTC whatever the session's zone, counts seconds from 2020-01-01 by page_id, and begins anew after 2^31 of them.
Captures that tie in URL key, time and page_id are ordered by their digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.plans.storage import delete, materialize, release, scratch_path

END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload up to which so many records go to a file.
SIZE_CLASSES = ((16 << 10, 4096), (256 << 10, 256), (4 << 20, 16), (16 << 20, 4), (None, 1))
RUN = 100_000  # captures of a run (some 300 bytes each) at most
BROADCAST_DIGESTS = 250_000  # up to so many repeated payloads (some 60 bytes each) are broadcast


class LoserTree:
    """Merges sorted runs; each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.head = [key(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while self.head[self.best] is not None:
            w = self.best
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node >= 1 and self.k > 1:
                if not self._before(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.best = w


_URL = re.compile(rb"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)(?:\?([^#]*))?", re.S)


def url_key(url: str) -> str:
    """Host reversed by labels without www, then path and query, with A-Z in lower case. What has no scheme and host stays as it is."""
    raw = url.encode().strip(b" ").lower()
    m = _URL.match(raw)
    if m is None:
        return raw.decode()
    host, path, query = m[1], m[2] or b"/", m[3]
    key = b",".join(x for x in reversed(host.split(b".")) if x not in (b"", b"www")) + b")" + path
    return (key + b"?" + query if query else key).decode()


def capture_time(page_id):
    """A column of the time of capture, as a string in UTC."""
    t = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1 << 31))
    clock = [F.lpad(x.cast("string"), 2, "0") for x in (F.floor(t % 86400 / 3600), F.floor(t % 3600 / 60), t % 60)]
    return F.concat(F.date_add(F.lit("2020-01-01").cast("date"), F.floor(t / 86400).cast("int")).cast("string"), F.lit("T"), clock[0], F.lit(":"), clock[1], F.lit(":"), clock[2], F.lit("Z"))


def originals(rows: DataFrame, least: int) -> DataFrame:
    """digest, original (the largest page_id) and its tag, of the payloads of `least` bytes or more that several rows have."""
    groups = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "tag")).alias("x"), F.count("*").alias("k"))
    return groups.filter("k > 1 and x.page_id is not null").select("digest", F.col("x.page_id").alias("original"), F.col("x.tag").alias("original_tag"))


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """One WARC record per row below `path`."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"), html.alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("tag", F.lower(F.hex(F.xxhash64("url", "digest"))))
    groups = materialize(originals(rows.select("page_id", "n", "digest", "tag"), least), "payloads")
    if groups.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:  # a narrow join by payload, whose large groups are split at run time; payloads move by page, evenly
        known = rows.filter(F.col("n") >= least).select("page_id", "digest").distinct().join(groups, "digest").select("page_id", "digest", "original", "original_tag")
        rows = rows.join(materialize(known, "revisits"), ["page_id", "digest"], "left")
    again = F.coalesce(F.col("page_id") != F.col("original"), F.lit(False))
    block = F.concat(F.lit(_HTTP), F.when(again, F.lit("")).otherwise(F.col("html")))
    urn = lambda c, tag: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(":"), F.col(tag), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id", "tag")), line("WARC-Date", capture_time(F.col("page_id"))), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", urn("original", "original_tag")), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    records = rows.select("n", "url", F.concat(head, block).alias("value"))
    # sizes go by the payload, so that choosing a class builds no record; heads are of some 1 KB and their URL
    size = F.col("n") + F.octet_length("url") + 1024
    bounds = [upto if upto else 1 << 62 for upto, _ in SIZE_CLASSES]
    of = [(size > low) & (size <= high) for low, high in zip([-1, *bounds], bounds, strict=False)]
    some = rows.select("n", "url").agg(*[F.count_if(c).alias(str(i)) for i, c in enumerate(of)]).first()
    for i, (own, (_, most)) in enumerate(zip(of, SIZE_CLASSES, strict=True)):
        if some[i] or not i:  # the first is written even if it is empty
            records.filter(own).select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def parse_archive(raw: bytes | memoryview) -> Iterator[dict]:
    """The records of one file; payload digests and lengths are checked."""
    raw, at = bytes(raw), 0
    while at < len(raw):
        cut = raw.index(b"\r\n\r\n", at)
        lines = raw[at:cut].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        body, end = cut + 4, cut + 4 + int(head["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length")
        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            payload = raw[raw.index(b"\r\n\r\n", body) + 4 : end]
            if (len(payload), hashlib.sha1(payload).hexdigest()) != (n, digest):
                raise ValueError(f"payload at byte {at} is damaged")
        number = lambda x: None if x is None or x.startswith("<urn:page:none:") else int(x[10:-1].split(":")[0])
        yield {
            "page_id": number(head["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": head["WARC-Type"],
            "refers_to": number(head.get("WARC-Refers-To")), "url_key": url_key(head["WARC-Target-URI"]), "captured": head["WARC-Date"], "offset": at, "length": end + 4 - at,
        }
        at = end + 4


_INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, offset long, length long, file string, run string"
_ARROW = pa.schema([(c, pa.string() if k == "string" else pa.int64()) for c, k in (x.split() for x in _INDEX.split(", "))])


def _order(r: dict) -> tuple:
    return r["url_key"], r["captured"], (r["page_id"] is not None, r["page_id"] or 0), r["payload_digest"], r["record_type"]


def read_runs(spark, path: str, most: int = RUN) -> DataFrame:
    """The captures of every archive below `path`, in runs sorted by URL key and time."""
    files = spark.read.format("binaryFile").load(f"{path}/part-*").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        name = f"{TaskContext.get().partitionId()}-"
        runs = 0

        def sorted_run() -> Iterator[pa.RecordBatch]:
            rows = sorted(held, key=_order)
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([r | {"run": f"{name}{runs}"} for r in rows[k : k + 10_000]], _ARROW)

        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held += [r | {"file": file.rsplit("/", 1)[-1]} for r in parse_archive(raw.as_buffer())]
                if len(held) >= most:
                    yield from sorted_run()
                    held, runs = [], runs + 1
        yield from sorted_run()

    return bw.arrow(files, run, _INDEX)


def natural_runs(rows: Iterator[dict]) -> list[list[dict]]:
    """The ordered stretches of each run's rows, which may arrive in several blocks, in any order of these."""
    runs: list[list[dict]] = []
    last: dict[str, int] = {}
    for r in rows:
        at = last.get(r["run"])
        if at is None or _order(runs[at][-1]) > _order(r):
            last[r["run"]] = at = len(runs)
            runs.append([])
        runs[at].append(r)
    return runs


def merge_runs(runs: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """All captures with range_no, place in it, and position: by it they are ordered by URL key, time and page_id."""
    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // rows_per_range))
    columns = [x.split()[0] for x in _INDEX.split(", ")]
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "payload_digest").withColumn("range_no", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for place, r in enumerate(LoserTree(natural_runs(r for batch in batches for r in batch.to_pylist()), _order)):
            out.append(r | {"place": place})
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = _ARROW.append(pa.field("range_no", pa.int32())).append(pa.field("place", pa.int64()))
    merged = materialize(bw.arrow(dealt.select(*columns, "range_no"), run, _INDEX + ", range_no int, place long"), "captures")
    before = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)  # over a row for each range
    first = merged.groupBy("range_no").count().select("range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    placed = merged.join(F.broadcast(first) if ranges <= BROADCAST_DIGESTS else first, "range_no")
    return placed.withColumn("position", F.col("first") + F.col("place")).drop("first", "run")


def archive(pages: DataFrame, least: int = 1000, path: str | None = None, run_length: int = RUN) -> DataFrame:
    """Write archives below `path`, read them back and merge their index. Without a path they are written into the shared folder, and go when they are read."""
    spark = pages.sparkSession
    own = path is None
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least)
    runs = materialize(read_runs(spark, path, run_length), "runs")
    merged = merge_runs(runs)
    release(runs)
    if own:  # archives that nobody asked to keep
        delete(spark, path)
    return merged
