"""Operator 2, WARC archives with a merged capture index.

write_archives() renders each page as one WARC/1.1 record and writes them with Spark's text writer: the
record's last line feed is the writer's separator, so the files are byte-exact archives, committed by Spark's own
protocol and compressed with gzip; offsets count uncompressed bytes. Records of equal payloads (SHA-1, of at
least min_bytes) but the one with the largest page_id are revisits that refer to it and carry no payload.
read_archives() streams the archives' lines from Spark's text reader through a parser that honours
Content-Length, so a task holds one record and not an archive, and checks each digest. merge_index() makes the
captures of every archive a locally sorted run and merges the runs with a loser tree by URL key and timestamp,
one key range to a task; ranges are in order, so the output is a globally ordered capture history. Spark's range
exchange and external sort bring a range's runs together; a task merges CAPTURES_PER_TASK narrow rows or so.

Defined cases: a null html is an empty payload; a null url gives an empty target and URL key; a null page_id
stays null, orders first and is never referred to; repeated rows of the largest page_id are responses all; ids of
any size are kept exactly; ties of key, time and page_id are ordered by archive and offset; line breaks in a url
are percent-encoded; very long pages are read and written whole; an empty table gives an empty result; extra
columns are ignored. Capture times follow page_id, one second each from START.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read, scratch_path, settle, sized

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
START = "2024-01-01 00:00:00"
CRLF = "\r\n"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, archive string, offset long"
#: Records of one archive file, and captures of one merging task.
RECORDS_PER_ARCHIVE = 2_000
CAPTURES_PER_TASK = 250_000


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal digest: 20 bits are 5 digits and 4 letters."""
    group = lambda g: F.conv(F.substring(digest, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda v, n: F.substring(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * n).bitwiseAND(31) + 1, F.lit(1))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), group)
    return F.array_join(F.transform(groups, lambda v: F.concat(*[letter(v, n) for n in range(4)])), "")


def _records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(record) texts, each without its last line feed."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    same = pages.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("sha").alias("same_sha"), "first")
    rows = pages.join(sized(same), F.col("sha") == F.col("same_sha"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    moment = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat_ws(CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), line("Content-Length", F.col("bytes").cast("string")), F.lit(""), F.lit(""))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), line("WARC-Date", moment), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"), line("Content-Length", F.octet_length(block).cast("string")), F.lit(""), F.lit(""),
    )
    return rows.select(F.concat(head, block, F.lit(CRLF + "\r")).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    _records(pages, min_bytes).write.option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path, compression="gzip")


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then the path and query; lower case, no fragment."""
    rest = url.partition("://")[2].partition("#")[0].lower()
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:] if rest else ""


class Parser:
    """Records of one archive from its lines, in order."""

    def __init__(self) -> None:
        self.held, self.size, self.offset, self.head, self.need = [], 0, 0, {}, 0

    def feed(self, line: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, headers, block) once a line, given without its line feed, ends a record."""
        self.held.append(line)
        self.size += len(line) + 1
        if not self.need and line == b"\r":
            first, *lines = b"\n".join(self.held)[: self.size - 4].decode().split(CRLF)
            if not first.startswith("WARC/"):
                raise ValueError(f"no record at byte {self.offset}")
            self.head = dict(x.split(": ", 1) for x in lines)
            self.start, self.need = self.size, self.size + int(self.head["Content-Length"]) + 4
        elif self.need and self.size >= self.need:
            data = b"\n".join(self.held)
            if self.size != self.need or not data.endswith(b"\r\n\r"):
                raise ValueError(f"damaged record at byte {self.offset}")
            yield self.offset, self.head, data[self.start : -3]
            self.held, self.offset, self.size, self.need = [], self.offset + self.size, 0, 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below path, as RECORD. Archives are compressed, so a file is one task's."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD.split(", ")]

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn != "<urn:page:none>" else None

    def row(name: str, offset: int, headers: dict[str, str], block: bytes) -> tuple:
        import base64
        import hashlib

        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{name}: damaged record at byte {offset}")
        return number(headers["WARC-Record-ID"]), size, digest, kind, number(headers.get("WARC-Refers-To")), url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], name, offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parser = None, Parser()
        for batch in batches:
            rows = []
            for name, line in zip(batch.column("name").to_pylist(), batch.column("line")):
                if name != current:
                    if parser.held:
                        raise ValueError(f"{current}: cut record at byte {parser.offset}")
                    current, parser = name, Parser()
                rows += [row(name, *record) for record in parser.feed(line.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        if parser.held:
            raise ValueError(f"{current}: cut record at byte {parser.offset}")

    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_name").alias("name"), F.col("value").cast("binary").alias("line")).mapInArrow(run, RECORD)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the loser of their match, one path is replayed per row."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival < 0:  # still filling: wait here for the rival
                self.losers[node] = i
                return
            if self._beats(rival, i):
                self.losers[node], i = i, rival
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[i := self.losers[0]]) is not None:
            yield row
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


def merge_index(captures: DataFrame) -> DataFrame:
    """captures (as RECORD) in the global order of URL key, time and page_id."""
    captures = settle(captures)
    ranges = max(1, -(-captures.count() // CAPTURES_PER_TASK))
    order = ["url_key", "captured", "page_id", "archive", "offset"]  # unique, so no group of equal keys stays in one range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        url, captured, page, archive, offset = (table.column(c).to_pylist() for c in order)
        keys = [(u, c, p is not None, p or 0, a, o, i) for i, (u, c, p, a, o) in enumerate(zip(url, captured, page, archive, offset))]
        starts = [i for i in range(len(keys)) if not i or archive[i] != archive[i - 1]]
        runs = [iter(keys[a:b]) for a, b in zip(starts, [*starts[1:], len(keys)])]
        merged = [row[-1] for row in LoserTree(runs)]
        for at in range(0, len(merged), 10_000):
            yield from table.take(merged[at : at + 10_000]).combine_chunks().to_batches()

    return captures.repartitionByRange(ranges, *order).sortWithinPartitions("archive", *order).mapInArrow(run, captures.schema)


def capture_history(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive pages, read the archives back and return their merged index."""
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return merge_index(read_archives(spark, path))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(spark, read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET}', (((('0x' || substr(sha, (i // 4 * 5 + 1)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN top IS NULL OR top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR top IS NOT DISTINCT FROM page_id THEN NULL ELSE top END AS refers_to
FROM g
"""
