"""Web archives: records written, read back and indexed as capture histories.

Every page becomes a WARC/1.1 record.  Of pages with equal payloads the one
with the largest id is a response and the others are revisits of it, without a
payload of their own.  Records are written by Spark's text writer with the
record separator as its line separator, so archives are committed as any other
output and lie wherever Spark can write.

An archive holds at most ``RECORDS`` records of pages up to ``LARGE`` bytes each,
and a larger page has an archive of its own, so an archive's size is bounded by
these and by the largest page.

Reading parses each archive by its content lengths, tests the digests, and
gives a run of captures sorted by URL key, time and page id, each with its
archive, offset and length there.  The runs are merged into one order, whose
ties are broken by archive and offset: ranges of it, of about ``RANGE`` captures,
are dealt out, and a task merges the pieces of all runs in its range by a loser
tree.  Pieces stay in Arrow's columns; of each only ``AHEAD`` captures at a time
are Python rows.

Defined results: a null page is an empty payload; a null URL is written as
``-``; blanks and control characters in a URL are percent-encoded; a null page
id is not written and reads as null, and is a response unless a page with an id
has the same payload; rows with equal ids and payloads are alike; empty tables
give empty archives; other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialise, scratch_path

MIN_PAYLOAD = 0
RECORDS = 500  # in an archive file, at most
LARGE = 1 << 18  # bytes of a page beyond which it has an archive of its own
RANGE = 100_000  # captures that a task merges, about
AHEAD = 256  # captures of a piece that are read ahead
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Pages carry no time of their own: second ``page_id`` after the start of 2020, UTC.
EPOCH = 1_577_836_800
CAPTURE = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: five hex digits at a time are four characters."""
    digest = F.sha1(data)
    out = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _date(page_id: Column) -> Column:
    """Arithmetic on days and seconds, so that no session time zone comes in."""
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000))
    day = F.date_format(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(seconds, F.lit(86_400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), F.concat_ws(":", two(rest / 3600), two(F.pmod(rest, F.lit(3600)) / 60), two(F.pmod(rest, F.lit(60)))), F.lit("Z"))


def _safe_url(url: Column) -> Column:
    for c in ("\t", "\n", "\r", " "):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%00"), F.lit("-"))


def records(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """One column, ``value``: the text of each page's record without the end mark."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _safe_url(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    shared = rows.filter(F.col("size") >= min_payload).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(shared, ["digest", "size"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Date", _date(F.col("page_id"))),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(field("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", _record_id(F.col("keeper"))), field("X-Refers-To-Page", F.col("keeper").cast("string")))).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(header, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Gzipped archives in the folders ``small`` and ``large`` of ``path``.  Equal pages are of one size, so each folder has its own responses."""
    large = F.coalesce(F.octet_length("html"), F.lit(0)) > LARGE
    for name, part, most in (("small", pages.filter(~large), RECORDS), ("large", pages.filter(large), 1)):
        records(part, min_payload).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields in lower case, block, offset, length) of each record of an unpacked archive; raises ValueError where the archive is damaged."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        end = head + 4 + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end mark")
        yield fields, data[head + 4 : end], at, end + 4 - at
        at = end + 4


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url.lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _capture(file: str, fields: dict[str, str], block: bytes, offset: int, length: int) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"wrong payload digest in {fields['warc-record-id']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return url_key(fields["warc-target-uri"]), fields["warc-date"], number("x-page-id"), fields["warc-target-uri"], fields["warc-type"], size, digest, number("x-refers-to-page"), file, offset, length


ORDER = ("url_key", "captured", "page_id", "file", "offset")


def merge_order(capture: tuple) -> tuple:
    """By URL key in UTF-8 order, time, page id (null first), archive and offset there."""
    return capture[0].encode(), capture[1], capture[2] is not None, capture[2] or 0, capture[8].encode(), capture[9]


_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_KINDS = [pa.int64() if x.endswith("long") else pa.string() for x in CAPTURE.split(", ")]


def _batch(captures: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*captures, strict=True)) if captures else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive as a sorted run, named by its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                yield _batch(sorted((_capture(name, *record) for record in parse_archive(raw)), key=merge_order))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, and the next item replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.item: list[tuple | None] = [None] * self.size
        self.key: list[tuple] = [(True,)] * self.size
        for k in range(len(runs)):
            self._advance(k)
        self.loser = [-1] * self.size
        self.winner = self._play(1) if runs else -1

    def _advance(self, k: int) -> None:
        """The run's next item; its key is (False, order, run), (True,) after its end."""
        self.item[k] = next(self.runs[k], None)
        self.key[k] = (True,) if self.item[k] is None else (False, merge_order(self.item[k]), k)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.key[b] < self.key[a]:
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and not self.key[self.winner][0]:
            k = self.winner
            yield self.item[k]
            self._advance(k)
            node = (k + self.size) // 2
            while node:
                if self.key[self.loser[node]] < self.key[k]:
                    self.loser[node], k = k, self.loser[node]
                node //= 2
            self.winner = k


def _read(piece: pa.Table) -> Iterator[tuple]:
    """A run's piece, in order although its blocks may arrive in another than they were written in."""
    piece = piece.take(pc.sort_indices(piece, [(c, "ascending") for c in ORDER], null_placement="at_start"))
    for k in range(0, len(piece), AHEAD):
        yield from zip(*(c.to_pylist() for c in piece.slice(k, AHEAD).columns), strict=True)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, time, page id and place: one range of it a partition."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            files = batch.column(8).dictionary_encode()
            for k, name in enumerate(files.dictionary.to_pylist()):
                pieces.setdefault(name, []).append(batch.filter(pc.equal(files.indices, k)))
        held: list[tuple] = []
        for capture in LoserTree([_read(pa.Table.from_batches(piece)) for piece in pieces.values()]):
            held.append(capture)
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        yield _batch(held)

    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE))
    return runs.repartitionByRange(ranges, *ORDER).mapInArrow(merged, CAPTURE)


def capture_histories(pages: DataFrame, path: str | None = None, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write ``pages`` as archives (to ``path``, or a scratch folder), read them back and merge their index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path, min_payload)
    return merge_runs(materialise(read_runs(spark, path), "capture-runs"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
sized AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, h,
         list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS BIGINT) >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM hashed),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM kept
"""
