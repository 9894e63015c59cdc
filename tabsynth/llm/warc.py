"""WARC archives of pages, and a capture index merged from sorted runs.

Archives are written and read by Spark's text source, which any store that Spark reaches supports: records are
set apart by their first lines, which name the archive (WARC-Warcinfo-ID), so that no payload can look like a
record's start. Each archive file gives a run of captures sorted by (URL key, timestamp, page). Runs are cut at common
splitters, and each range is merged from its k slices by a tree of losers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsynth.llm.common import shared_path, shuffle_partitions, written

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed: RFC 4648
#: Fixed: 2024-01-01 in UTC, for pages without a date of their own.
EPOCH = 1704067200


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in upper-case base32, 32 characters: four groups of 40 bits."""
    hexes = F.sha1(payload)
    out = []
    for g in range(4):
        bits = F.conv(F.substring(hexes, 10 * g + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Host parts reversed, then the rest, in lower case: captures of a site lie together. Null gives an empty key."""
    parts = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)(:\d+)?([^#]*)", 1)
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.concat_ws(",", F.reverse(F.split(parts, r"\."))), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.when(url.isNull(), F.lit("")).when(parts == "", F.lower(url)).otherwise(key)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, date, payload) with digest, record_type and refers_to.

    Of payloads that are equal and have least_bytes, that with the smallest page_id (null is largest) is the
    response. Rows that repeat page_id and payload are told apart by their place in the scan. Only digests
    that occur twice take part in the join, whose skew Spark splits.
    """
    marked = pages.withColumns({"digest": base32_sha1(F.col("payload")), "_row": F.monotonically_increasing_id()})
    rank = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("_row").alias("row"))
    firsts = marked.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    both = marked.join(firsts, "digest", "left")
    again = (F.length("payload") >= least_bytes) & F.col("_first").isNotNull() & (F.col("_first.row") != F.col("_row"))
    return both.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first.page_id"))}).drop("_first", "_row")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))


def write_archives(captures: DataFrame, path: str) -> str:
    """Writes a record for each capture under path, in gzip files; returns the archive's id.

    A revisit has no payload of its own; its digest and length are those of the full payload.
    """
    archive = str(uuid.uuid4())
    text = lambda c: c.cast("string")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    kept = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(first_lines(archive)),
        F.lit("WARC-Type: "), F.col("record_type"), F.lit(CRLF),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text(F.col("page_id")), F.lit(">"))),
        _line("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", uri),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(F.lit("")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), text(F.col("refers_to")), F.lit(">"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", text(F.length("payload"))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", text(F.length(kept))),
        F.lit(CRLF),
    )
    captures.select(F.concat(head.cast("binary"), kept).cast("string").alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
    return archive


def first_lines(archive: str) -> str:
    return f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive}>{CRLF}"


def read_archives(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """file, n (place in it), page_id, url, date, record_type, refers_to, payload_bytes, payload_digest, payload, length (of the record).

    Digest and length of a response come from the payload that was read, those of a revisit from its lines.
    """
    raw = spark.read.option("lineSep", first_lines(archive)).text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n")).where("value != ''")
    end = F.instr("value", CRLF + CRLF)
    raw = raw.select("file", "n", F.substring("value", F.lit(1), end + 1).alias("head"), F.col("value").cast("binary").alias("body"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))
    body = F.substring("body", F.octet_length("head") + 3, field("Content-Length").cast("int"))
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\w+)>", 1).cast("long")
    records = raw.select("file", "n", page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), F.to_timestamp(field("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), field("X-Payload-Length").cast("long").alias("_bytes"), F.substring(field("WARC-Payload-Digest"), 6, 32).alias("_digest"), body.alias("payload"), (F.octet_length("body") + len(first_lines(archive))).cast("long").alias("length"))
    own = F.col("record_type") == "response"
    return records.withColumns({"payload_bytes": F.when(own, F.length("payload").cast("long")).otherwise(F.col("_bytes")), "payload_digest": F.when(own, base32_sha1(F.col("payload"))).otherwise(F.col("_digest"))}).drop("_bytes", "_digest")


class LoserTree:
    """Merges k sorted lists: each inner node holds the loser of its match, the root's winner is next."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.head = [key(r[0]) if r else None for r in runs]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; an empty run comes last, ties go to the earlier run."""
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a], a) < (self.head[b], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.loser[node] < 0:  # the first to come waits for its match
                self.loser[node] = i
                return
            if self._before(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        if not self.k:
            return
        while self.head[w := self.winner] is not None:
            run, at = self.runs[w], self.at[w]
            yield run[at]
            self.at[w] = at = at + 1
            self.head[w] = self.key(run[at]) if at < len(run) else None
            self._play(w)


def _sort_key(row: dict) -> tuple:
    return tuple((x is None, x) if x is not None else (True, 0) for x in (row["urlkey"], row["date"], row["page_id"], row["file"], row["n"]))


def merge_runs(index: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """index (urlkey, date, page_id, file, n, ...) in global order: range_no numbers the ranges, place the rows in each.

    The files' runs are sorted where they lie, before the exchange. Ranges hold some range_rows captures each; as the
    splitters take in date and page, one URL's history may span ranges, so no key fills a task.
    """
    spark = index.sparkSession
    ranges = max(math.ceil(index.count() / range_rows), shuffle_partitions(spark))
    order = ["urlkey", "date", "page_id", "file", "n"]
    runs = index.sortWithinPartitions("file", *order).repartitionByRange(ranges, *[F.col(c).asc_nulls_last() for c in order])
    names = index.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slices, last = [], None  # blocks of the exchange come one after another: a run's slice ends where the order falls back
        for batch in batches:
            for row in batch.to_pylist():
                here = _sort_key(row)
                if last is None or here < last:
                    slices.append([])
                slices[-1].append(row)
                last = here
        out = list(LoserTree(slices, _sort_key))
        for at in range(0, len(out), 10_000):
            some = pa.RecordBatch.from_pylist(out[at : at + 10_000], schema=kinds)
            n = len(some)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*names, "range_no", "place"])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(index.schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return runs.mapInArrow(merge, f"{fields}, range_no int, place long")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes pages to archives in the shared folder, reads them back and returns the merged index and the archives' path.

    The index has page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, date, file, offset (in the unpacked
    file), length, range_no, place (both give the global order: a URL key's captures in time order). Null html
    is an empty payload, a null page_id a record without id, a null url an empty key. Repeated rows are captures
    of their own. Empty tables give an empty index. Other columns are left out.
    """
    spark = pages.sparkSession
    when = F.col(date) if date else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod(F.col(key), F.lit(31_536_000)), F.lit(0)))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), when.alias("date"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    path = shared_path(spark, "warc")
    archive = write_archives(deduplicated(rows, least_bytes), path)
    read = read_archives(spark, path, archive)
    captures = written(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", url_key(F.col("url")).alias("urlkey"), "date", "file", "n", "length"), "captures")
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    located = captures.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    merged = merge_runs(located)
    return merged.drop("n"), path
