"""WARC archives of pages, and a merged index of their captures.

Archives are WARC/1.0 files written by Spark's text writer: a record is its headers, an HTTP header block and the payload,
and the separator of the writer is the two line ends that close a record. Of the records with equal payloads the one with
the greatest page_id is a response, the others are revisits that refer to it and carry the HTTP headers only (payloads
shorter than `min_bytes` are all responses). Payloads that occur more than once come from a pre-aggregated grouping by
digest; pages are joined with those only, in a join Spark can split where one payload has very many pages.

Reading goes file by file, record by record by Content-Length, so payloads may hold anything. What a file says in its
headers becomes index entries, sorted in the task: a run, written to the shared folder, so archives are read once. Runs are
dealt out by ranges of (URL key, timestamp, page_id), whose bounds are sampled from the written runs, so even one URL's
captures spread over tasks. Each task merges its pieces of the runs with a tree of losers into ranges of the capture history,
ordered within and between partitions. It holds `ROOM` rows at most: what is more is merged into runs on disk, and these are
merged in the end, a block of each in memory.

Null html is an empty payload, a null URL the empty one. Rows with a null page_id revisit a row that has one; without any
such row, and for repeated rows with the greatest page_id, all are responses. Without a time column a capture's time is
a fixed instant plus page_id seconds. An empty table gives an empty index.
"""

import base64
import hashlib
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Window, functions as F

from kilowatch.llm.common import emit, shuffle_partitions, spilled, written

MIN_BYTES = 0
EPOCH = 1_704_067_200
MONTHS = 10 * 365 * 86400  # page_id is taken modulo ten years for its time
RECORD_END = "\r\n\r\n"
RECORDS, FILE_BYTES = 2000, 256 << 20
ROOM = 200_000  # rows a merging task holds
WAYS = 64  # runs on disk before they are merged into one


# ---- writing --------------------------------------------------------------------------------------------------------


def _capture_time(page_id):
    return F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(MONTHS)))


def captures(pages, min_bytes=MIN_BYTES, time_col=None):
    """(page_id, url, at, html, digest, bytes, response_id, is_response) of every page."""
    page_id = F.col("page_id").cast("bigint")
    rows = pages.select(
        page_id.alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20]", "").alias("url"),
        (F.col(time_col).cast("timestamp") if time_col else _capture_time(page_id)).alias("at"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("bigint")})
    groups = rows.groupBy("digest", "bytes").agg(F.max("page_id").alias("greatest"), F.count("*").alias("n"))
    repeated = written(groups.filter("n > 1"), "repeated-payloads").select("digest", "bytes", "greatest", F.lit(True).alias("again"))
    of = rows.join(repeated, ["digest", "bytes"], "left")
    of = of.withColumn("response_id", F.when(F.col("again"), F.col("greatest")).otherwise(F.col("page_id"))).drop("greatest", "again")
    first = F.col("page_id").eqNullSafe(F.col("response_id")) | (F.col("bytes") < min_bytes)
    return of.withColumn("is_response", first)


def _base32(hexadecimal):
    """Upper-case base32 of hexadecimal text of 40 digits, 5 bits a letter."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(hexadecimal, k, 10), 16, 2), 40, "0") for k in (1, 11, 21, 31)))
    letters = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.conv(F.substring(bits, k * 5 + 1, F.lit(5)), 2, 10).cast("int"))
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.array_join(F.transform(letters, lambda v: F.substring(alphabet, v + 1, F.lit(1))), "")


def _uri(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(found):
    """One WARC record per capture, without the line ends that close it."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    kind = F.when(F.col("is_response"), "response").otherwise("revisit")
    block = F.when(F.col("is_response"), F.concat(head, F.col("html"))).otherwise(head)
    more = F.when(F.col("is_response"), "").otherwise(
        F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("response_id")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))
    )
    # From the instant by arithmetic, whatever the session's zone.
    second = F.coalesce(F.unix_seconds("at"), F.lit(0))
    day, rest = F.floor(second / 86400).cast("int"), F.pmod(second, F.lit(86400))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")
    when = F.concat(date, F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))
    parts = [
        F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _uri(F.col("page_id")), F.lit("\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), _base32(F.col("digest")), F.lit("\r\n"), more,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END), block,
    ]
    return found.select(F.concat(*parts).alias("value"))


def write_archives(pages, path, min_bytes=MIN_BYTES, time_col=None, records_per_file=RECORDS, file_bytes=FILE_BYTES):
    """Write all pages as archives below the path, of `file_bytes` payload bytes at most (or one record).

    A file of ordinary pages takes `records_per_file` records; if there are pages too long for that, they go to files of
    their own, of as few records as the longest of them asks for.
    """
    found = captures(pages, min_bytes, time_col)
    short = file_bytes // records_per_file
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    parts = [(found, records_per_file)]
    if longest > short:
        parts = [(found.filter(F.col("bytes") <= short), records_per_file), (found.filter(F.col("bytes") > short), max(1, file_bytes // longest))]
    for part, count in parts:
        writer = records(part).write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", count)
        writer.text(path)


# ---- reading --------------------------------------------------------------------------------------------------------

_NUMBER = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def url_key(url):
    """Sort-friendly form of a URL: host reversed, no scheme, `www.` or fragment, lower-case host, sorted query."""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower().removeprefix("www.")
    name, _, port = host.partition(":")
    path, mark, query = path.partition("?")
    query = "&".join(sorted(query.split("&"))) if mark else ""
    reverse = ",".join(reversed(name.split(".")))
    return quote(f"{reverse}{':' + port if port and port not in ('80', '443') else ''}){slash or '/'}{path}{mark}{query}", safe=",):/?&=%~;@+$!*'(")


def parse(content):
    """(headers, block, offset, length) of the records of an archive, looked at in place."""
    view, at = memoryview(content), 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        head = bytes(view[at:stop])
        size = int(_NUMBER.search(head)[1])
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        begin = stop + 4
        yield headers, view[begin : begin + size], at, begin + size + 4 - at
        at = begin + size + 4


def _page(uri):
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _entry(headers, block, offset, length, name):
    """An index entry of a record; a response's digest is checked against its payload."""
    raw = bytes(block)
    stop = raw.index(b"\r\n\r\n") + 4
    size, digest = int(_NUMBER.search(raw[:stop])[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(raw) - stop != size or base64.b32encode(hashlib.sha1(raw[stop:]).digest()).decode() != digest):
        raise ValueError(f"{name}: the record at {offset} is damaged")
    refers = headers.get("WARC-Refers-To")
    return (
        url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), size, digest, kind,
        _page(refers) if refers else None, name, offset, length,
    )


ENTRY = pa.schema(
    [("urlkey", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]
    + [("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_DDL = "urlkey string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, `offset` bigint, length bigint"


def _place(row):
    """Order of the merged index; nulls first, ties by where the record is."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def runs(spark, path):
    """Index entries of all archives; each archive's are a run, sorted where it is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data = content.as_buffer().to_pybytes()
                short = name.rsplit("/", 1)[-1]
                entries = sorted((_entry(*record, short) for record in parse(data)), key=_place)
                for k in range(0, len(entries), 10_000):
                    yield emit(entries[k : k + 10_000], ENTRY)

    return files.mapInArrow(run, _DDL)


# ---- merging --------------------------------------------------------------------------------------------------------


def merged(sequences, key):
    """Sorted sequences as one, by a tree of losers: each step plays one path from a leaf to the root."""
    sources = [iter(s) for s in sequences]
    k = len(sources)
    if not k:
        return
    ended = object()

    def pull(i):
        row = next(sources[i], ended)
        return (1,) if row is ended else (0, key(row)), row

    heads = [pull(i) for i in range(k)]
    beats = lambda i, j: (heads[i][0], i) < (heads[j][0], j)
    losers = [0] * k  # node n has the players or nodes 2n and 2n + 1 below it; players are k .. 2k - 1
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0
    while heads[champion][1] is not ended:
        yield heads[champion][1]
        heads[champion] = pull(champion)
        node = (champion + k) // 2
        while node:
            if beats(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2


def merge_runs(entries, partitions=None):
    """The index in order: partitions are ranges of (urlkey, captured_at, page_id), each the merge of its runs' pieces.

    A piece keeps the order of its run, so a task sorts nothing: it tells the runs apart and merges them, on disk beyond
    `ROOM` rows.
    """
    spark = entries.sparkSession
    dealt = entries.repartitionByRange(partitions or shuffle_partitions(spark), "urlkey", "captured_at", "page_id", "file", "offset")

    def rows(batches):
        pieces, held, far = {}, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(row[7], []).append(row)
            held += len(batch)
            if held >= ROOM:
                far.append(spilled(merged([_ascending(p) for p in pieces.values()], _place)))
                pieces, held = {}, 0
                if len(far) == WAYS:
                    far = [spilled(merged(far, _place))]
        yield from merged([*far, *(_ascending(p) for p in pieces.values())], _place)

    def run(batches):
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 10_000:
                yield emit(out, ENTRY)
                out = []
        if out:
            yield emit(out, ENTRY)

    return dealt.mapInArrow(run, _DDL)


def _ascending(piece):
    """A run's piece, put in order in case the shuffle has handed over its parts in another one."""
    return piece if all(_place(a) <= _place(b) for a, b in zip(piece, piece[1:])) else sorted(piece, key=_place)


def capture_index(spark, path, partitions=None):
    """The globally ordered index of the archives below the path."""
    return merge_runs(written(runs(spark, path), "capture-runs"), partitions)


def histories(index):
    """Per URL key: its number of captures, of different payloads, first and last time."""
    return index.groupBy("urlkey").agg(
        F.count("*").alias("captures"), F.countDistinct("payload_digest").alias("payloads"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at")
    )


def previous_capture(index):
    """The index with the time of the capture before it of the same URL key."""
    return index.withColumn("previous_at", F.lag("captured_at").over(Window.partitionBy("urlkey").orderBy("captured_at", "page_id")))
