"""WARC archives of pages with revisit records, and their capture index by an external merge of sorted runs."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from prefspark.llm.common import fresh, slices
from prefspark.plans.session import materialize, scratch_path

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_LAST = int((datetime(9999, 12, 31, tzinfo=timezone.utc) - _EPOCH).total_seconds())


# ---- writing ----


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, seconds: int | None, refers_to: int | None) -> bytes:
    """A response record, or a revisit record of `refers_to`, whose digest and length are the full payload's."""
    payload = (html or "").encode()
    seconds = page_id if seconds is None else seconds
    date = _EPOCH + timedelta(seconds=min(max(seconds or 0, 0), _LAST))
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if url is not None:
        # White space and control characters can't stand in a header.
        headers.append(("WARC-Target-URI", "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE), ("X-Payload-Length", str(len(payload)))]
        return _record(headers, HTTP)
    return _record(headers, HTTP + payload)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 16 << 20):
        rows = zip(*(column.to_pylist() for column in batch.columns))
        # The text writer adds the last line feed of each record.
        made = [page_record(*row)[:-1].decode() for row in rows]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])


def write_warc(
    pages: DataFrame,
    path: str,
    min_revisit_bytes: int = 1000,
    records_per_file: int = 2000,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    seconds_column: str | None = None,
) -> None:
    """Write a record per row of `pages` below `path`, gzip-compressed WARC files of `records_per_file` records.

    Of rows with equal payloads of at least `min_revisit_bytes` bytes, those with the largest page_id are
    responses and the others revisit it; smaller payloads are all responses. The payload is the html in UTF-8,
    a null html is empty. A null page_id is below all others; rows that repeat the largest id are all
    responses. `seconds_column` has the capture time in seconds since 1970; without it the page_id stands in,
    so that histories have an order. An empty table makes an archive without records.

    Only digests are grouped. The few that repeat are joined back to the pages: if their table is small by
    measure Spark broadcasts it, else it splits a digest that many pages share.
    """
    digest, keeper = fresh(pages, "digest"), fresh(pages, "keeper")
    payload = F.coalesce(pages[html_column], F.lit("")).cast("binary")
    rows = pages.select(
        pages[id_column].cast("long").alias("page_id"),
        pages[url_column].alias("url"),
        pages[html_column].alias("html"),
        (F.lit(None) if seconds_column is None else pages[seconds_column]).cast("long").alias("seconds"),
        F.when(F.octet_length(payload) >= min_revisit_bytes, F.sha1(payload)).alias(digest),
    )
    repeated = (
        rows.where(F.col(digest).isNotNull())
        .groupBy(digest)
        .agg(F.max("page_id").alias(keeper), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    repeated = materialize(repeated, "warc-repeated").withColumnRenamed(digest, digest + "_of")
    decided = rows.join(repeated, F.col(digest) == F.col(digest + "_of"), "left")
    refers = F.when(F.col(keeper).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(keeper)), F.col(keeper))
    decided.select("page_id", "url", "html", "seconds", refers.alias("refers_to")).mapInArrow(_records, "value string").write.option(
        "lineSep", "\n"
    ).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# ---- reading ----


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record; Content-Length alone says where a block ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
        start, n = end + 4, int(headers["content-length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end after {n} bytes")
        yield at, start + n + 4 - at, headers, data[start : start + n]
        at = start + n + 4


def url_key(url: str | None) -> str:
    """Host parts from the last to the first, then path and query, in lower case; fragment and port are left out."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower()


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


_INDEX = [
    ("run", pa.string()), ("nth", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
]
_INDEX_DDL = (
    "run string, nth bigint, url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, url string, offset bigint, length bigint"
)


def _key(row: tuple) -> tuple:
    """URL key, time, id (null first), then the place, so that the order is total."""
    return row[2], row[3], row[4] is not None, row[4] or 0, row[0], row[10]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_INDEX)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _INDEX)], [n for n, _ in _INDEX])


def _captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of each archive file; the payload's digest and length are taken from its bytes."""
    for batch in batches:
        for path, packed in zip(batch.column(0), batch.column(1)):
            name, found = path.as_py().rsplit("/", 1)[-1], []
            data = zlib.decompress(packed.as_buffer(), 31) if len(packed.as_buffer()) else b""
            for offset, length, headers, block in parse_records(data):
                kind, refers = headers["warc-type"], headers.get("warc-refers-to")
                said = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    if digest != said:
                        raise ValueError(f"{name}: the payload at byte {offset} does not have its digest")
                else:
                    digest, size = said, int(headers["x-payload-length"])
                url = headers.get("warc-target-uri")
                found.append(
                    (name, 0, url_key(url), headers["warc-date"], _page(headers["warc-record-id"]), size, digest, kind,
                     None if refers is None else _page(refers), url, offset, length)
                )
            found.sort(key=_key)
            yield _batch([(row[0], i, *row[2:]) for i, row in enumerate(found)])


# ---- merging ----


def merge_runs(sources: list[list], key) -> Iterator:
    """All items of sorted lists in order, by a loser tree: one comparison per level for each item.

    An inner node holds the list that lost there; the winner's next item is played up along one path.
    """
    k = len(sources)
    at = [0] * k

    def head(i: int) -> tuple:
        return (0, key(sources[i][at[i]]), i) if at[i] < len(sources[i]) else (1, i)

    heads = [head(i) for i in range(k)]
    losers = [0] * max(k, 1)  # node 0 has the winner, nodes 1..k-1 the losers; list i is leaf k + i
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if heads[a] < heads[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best][0] == 0:
        yield sources[best][at[best]]
        at[best] += 1
        heads[best] = head(best)
        node = (k + best) // 2
        while node:
            if heads[losers[node]] < heads[best]:
                losers[node], best = best, losers[node]
            node //= 2


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sources: list[list] = []
    last = None
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[0] != last:
                sources.append([])
                last = row[0]
            sources[-1].append(row)
    out = []
    for row in merge_runs(sources, _key):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of an archive in the order of URL key, time and id, partition after partition.

    Every file gives a run sorted where it was read. Runs are cut at common key ranges (a URL that a third of
    the captures share is divided by time and id), and each task merges its pieces of all runs by a loser tree.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    captures = materialize(files.mapInArrow(_captures, _INDEX_DDL), "warc-runs")
    return (
        captures.repartitionByRange("url_key", "captured", "page_id", "run", "offset")
        .sortWithinPartitions("run", "nth")
        .mapInArrow(_merge, _INDEX_DDL)
        .drop("nth")
        .withColumnRenamed("run", "file")
    )


def archive_and_index(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to an archive in the shared folder and return its index (see `write_warc`, `read_index`)."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_index(pages.sparkSession, path)
