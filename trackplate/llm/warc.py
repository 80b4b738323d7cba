"""WARC archives: writing with payload dedup, reading back, merging capture histories.

Records are built and written by Spark's text writer whose line end is the record end, so
files are plain WARC. Readers take whole files of bounded record counts, check lengths and
digests, and hand on one locally sorted run of captures per file. Runs are cut into ranges
of (URL key, time, page); each range merges its slices of all runs with a loser tree, and
the ranges follow each other, so the histories are globally ordered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import scratch_folder, written

LEAST_SHARED = 1000           #: payloads of fewer bytes are never replaced by a reference
RECORDS_PER_FILE = 1000
FIRST_CAPTURE = 1_704_067_200  #: seconds of the first WARC-Date; page numbers count on from it
END = "\r\n\r\n"
CAPTURE = "run string, offset long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_roles(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Add `_html`, `_bytes`, `_sha1` and `_refers`: the page that holds an equal payload, NULL for responses.

    Of equal payloads of LEAST_SHARED bytes or more, the largest page number is stored. Only
    payloads that occur several times are joined, by digest and length.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    sized = pages.withColumns({"_html": body, "_bytes": F.octet_length(body).cast("long"), "_sha1": F.sha1(body.cast("binary"))})
    shared = written(sized.where(F.col("_bytes") >= LEAST_SHARED).groupBy("_sha1", "_bytes")
                     .agg(F.count(F.lit(1)).alias("_n"), F.max(page_id).alias("_kept")).where("_n > 1").drop("_n"), "warc-shared")
    return (sized.join(shared, ["_sha1", "_bytes"], "left")
            .withColumn("_refers", F.when(~F.col(page_id).eqNullSafe(F.col("_kept")), F.col("_kept"))).drop("_kept"))


def record_id(page: Column) -> Column:
    h = F.md5(F.coalesce(page.cast("string"), F.lit("")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column `value`: a whole record per row, without its end. Revisits carry no payload."""
    df = with_roles(pages, page_id, html)
    page, refers = F.col(page_id), F.col("_refers")
    when = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(10 ** 9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(refers.isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", record_id(page)),
        line("WARC-Date", when),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\x00-\\x1F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.coalesce(F.concat(line("WARC-Refers-To", record_id(refers)), line("X-Refers-To-Page", refers.cast("string")),
                            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")), F.lit("")),
        line("X-Page", F.coalesce(page.cast("string"), F.lit(""))),
        line("X-Payload-Bytes", F.col("_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.lit("Content-Length: "), F.when(refers.isNull(), F.col("_bytes")).otherwise(F.lit(0)).cast("string"), F.lit(END))
    return df.select(F.concat(head, F.when(refers.isNull(), F.col("_html")).otherwise(F.lit(""))).alias("value"))


def write_archives(pages: DataFrame, folder: str, **columns: str) -> None:
    records(pages, **columns).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def url_key(url: str) -> str:
    """Host labels in reverse, without www and scheme, then path and query."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path.lower() or "/") + (f"?{u.query.lower()}" if u.query else "")


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of the records of one file, by their stated lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is longer or shorter than it says")
        yield at, head, data[begin:end]
        at = end + 4


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives: each file is one run, sorted by (url_key, captured, page_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows = []
                for at, head, payload in parse(content.as_py()):
                    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != stated:
                        raise ValueError(f"payload at byte {at} of {path} does not have its digest")
                    number = lambda x: int(x) if x else None
                    rows.append((path.as_py(), at, url_key(head["WARC-Target-URI"]), head["WARC-Date"], number(head["X-Page"]),
                                 int(head["X-Payload-Bytes"]) if revisit else len(payload), stated, head["WARC-Type"],
                                 number(head.get("X-Refers-To-Page"))))
                rows.sort(key=lambda r: (r[2], r[3], r[4] is not None, r[4] or 0))
                yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in CAPTURE.split(", "))])


class LoserTree:
    """Merges sorted runs: inner nodes remember losers, so each step replays one path."""

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.size = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 0
        self.heads += [None] * (self.size - len(runs))
        self.losers = [0] * max(1, self.size)
        self.winner = self._play(1) if self.size else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.size and (head := self.heads[self.winner]) is not None:
            own = self.winner
            yield own, head
            self.heads[own] = next(self.runs[own], None)
            node = (own + self.size) >> 1
            while node:
                if self._beats(self.losers[node], own):
                    own, self.losers[node] = self.losers[node], own
                node >>= 1
            self.winner = own


def merge_runs(captures: DataFrame) -> DataFrame:
    """All captures in global order of (url_key, captured, page_id).

    A range of keys holds slices of all runs; a URL with many captures spreads over ranges,
    since time and page are part of the key.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        names, keys = t.column("run").to_pylist(), list(zip(*(t.column(c).to_pylist() for c in ("url_key", "captured", "page_id"))))
        slices: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            slices.setdefault(name, []).append(i)
        order = lambda i: (keys[i][0], keys[i][1], keys[i][2] is not None, keys[i][2] or 0, i)
        tree = LoserTree([iter([order(i) for i in own]) for own in slices.values()])
        yield from t.take(pa.array([key[-1] for _, key in tree])).combine_chunks().to_batches()

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, "url_key", "captured", "page_id")
    return ranged.sortWithinPartitions("run", "url_key", "captured", "page_id").mapInArrow(merge, CAPTURE)


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write `pages` to archives in a new shared folder and return their merged capture histories.

    NULL html is an empty payload, a NULL or odd URL keeps its record, a NULL page number is
    NULL again; rows that repeat a page number and payload are equal and all responses. An
    empty table gives no captures.
    """
    folder = scratch_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, **columns)
    return merge_runs(written(read_runs(pages.sparkSession, folder), "warc-runs"))
