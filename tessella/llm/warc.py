"""Web archives: WARC records with revisits, read back, and one globally ordered capture history.

`write_archives` stores pages as WARC 1.1 records, `read_records` parses and verifies them, `history` merges the archives'
locally sorted index runs by URL key and time. Pages are page_id, url and html; other columns are not looked at. A null
html is an empty payload, a null url an empty one with an empty key, a null page_id comes after all others. Of rows
repeated in page_id, url and html one is the response and the others revisit it; an empty table gives no records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, materialize, shared_dir
from tessella.llm.neardup import lookup

CRLF = "\r\n"
RECORDS_A_FILE = 20_000
ENTRIES_A_RANGE = 50_000  # index entries that one task merges
# fixed values: alphabet of base 32, revisit profile of WARC 1.1
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: pages have no time of their own: each is captured its page_id in seconds after this day, within a hundred years
FIRST_DAY = "2024-01-01"
CENTURY = 36_525 * 86_400


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: five hexadecimal digits at a time are four digits of base 32."""
    digits = F.sha1(payload)
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digit = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*[digit(v, s) for s in (15, 10, 5, 0)])), "")


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, without scheme, user, www, default port and fragment, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "^[a-z][a-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^www[0-9]*[.]|:(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(F.coalesce(bare, F.lit("")) == "", "").otherwise(key)


def capture_time(page_id: Column) -> Column:
    """WARC date of a page, the same in every time zone."""
    seconds = F.pmod(F.coalesce(page_id.cast("long"), F.lit(0)), F.lit(CENTURY))
    clock = [F.lpad(F.pmod(F.floor(seconds / div).cast("long"), F.lit(mod)).cast("string"), 2, "0") for div, mod in ((3600, 24), (60, 60), (1, 60))]
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


_KEY = ["page_id", "url", "at", "digest"]


def _captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, at, payload, digest, bytes) of pages."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), capture_time(F.col("page_id")).alias("at"), F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})


def _matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) a match in keys, null page ids being equal."""
    there = keys.select(*[F.col(c).alias(f"_{c}") for c in _KEY])
    test = F.lit(True)
    for c in _KEY:
        test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(there, test, how)


def _record_id(run: str, page_id: Column, url: Column, at: Column, digest: Column, copy: Column) -> Column:
    d = F.md5(F.concat_ws("\n", F.lit(run), F.coalesce(page_id.cast("string"), F.lit("-")), url, at, digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(d, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(mark: str, fields: dict[str, Column], http: Column, payload: Column, size: Column) -> Column:
    """One record, whose payload has size bytes, less its last line feed, which the writer of lines adds."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    head = F.concat_ws(CRLF, *lines, F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), (F.octet_length(http) + size + len(2 * CRLF)).cast("string")))
    return F.concat(F.lit(mark), head, F.lit(2 * CRLF), http, F.lit(2 * CRLF), payload, F.lit(CRLF + "\r")).alias("value")


def write_archives(pages: DataFrame, path: str, least: int = 0, records: int = RECORDS_A_FILE, compression: str = "gzip") -> None:
    """Write each page as one WARC record below path, in archives of at most so many records.

    Of equal payloads of at least `least` bytes that with the smallest page_id is a response; the others are revisit
    records that name it and hold no payload. Digests, never payloads, are grouped; payloads are moved only to leave out
    the revisits, and not even then where the table of revisits is small enough for Spark to send it to all tasks.
    Each archive starts its records with a mark of its own run, which no payload can hold by chance.
    """
    spark, run = pages.sparkSession, uuid.uuid4().hex
    mark = f"WARC/1.1{CRLF}X-Archive-Run: {run}{CRLF}"
    rows = _captures(pages)
    with Scratch(spark) as held:
        thin = held.keep(rows.groupBy(*_KEY, "bytes").agg(F.count(F.lit(1)).alias("times")), "captures")
        total = thin.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
        first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "at"))
        groups = thin.where(F.col("bytes") >= least).groupBy("digest").agg(first.alias("f"), F.sum("times").alias("c")).where("c > 1")
        groups = held.keep(groups.select("digest", "c", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"), F.col("f.at").alias("first_at")), "groups")
        is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("url") == F.col("first_url")) & (F.col("at") == F.col("first_at"))
        met = lookup(thin, groups, "digest", total).withColumn("is_first", is_first)
        revisits = held.keep(met.withColumn("copies", F.col("times") - F.col("is_first").cast("long")).where("copies > 0"), "revisits")
        responses, again = _matched(rows, revisits.where("NOT is_first"), "left_anti"), revisits.where("is_first")
        if not again.isEmpty():  # a response that is repeated whole: one copy of its payload is kept
            copies = _matched(rows, again, "left_semi").groupBy(*_KEY, "bytes").agg(F.first("payload").alias("payload"))
            responses = _matched(responses, again, "left_anti").unionByName(copies)
        http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"))
        own = [F.col(c) for c in _KEY]
        at_first = [F.col("first_id"), F.col("first_url"), F.col("first_at"), F.col("digest")]
        fields = lambda kind, copy: {
            "WARC-Type": F.lit(kind), "WARC-Record-ID": _record_id(run, *own, copy), "WARC-Date": F.col("at"), "WARC-Target-URI": F.col("url"),
            "X-Page-Id": F.col("page_id").cast("string"), "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest"),
        }
        refers = {
            "WARC-Profile": F.lit(PROFILE), "WARC-Refers-To": _record_id(run, *at_first, F.lit(0)), "WARC-Refers-To-Target-URI": F.col("first_url"),
            "WARC-Refers-To-Date": F.col("first_at"), "X-Refers-To-Page-Id": F.col("first_id").cast("string"),
        }
        own_copy = F.when(F.col("bytes") < least, F.monotonically_increasing_id() + 1).otherwise(0)  # short payloads that are repeated whole are responses each
        full = responses.withColumn("copy", own_copy).select(_record(mark, fields("response", F.col("copy")), http, F.col("payload"), F.col("bytes")))
        empty = revisits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(_record(mark, fields("revisit", F.col("copy")) | refers, http, F.lit(""), F.lit(0)))
        full.unionByName(empty).write.option("compression", compression).option("maxRecordsPerFile", records).text(f"{path}/archives")
        spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.json(f"{path}/manifest")


def read_records(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """Records of the archives below path, payloads too: record_type, record_id, page_id, url, at, digest, bytes, refers_to,
    refers_to_page, payload (null of a revisit), intact, archive, size.

    intact: the block has the length that its header says, and a response's payload its length and digest. mark is what
    every record starts with, by default what the manifest says; archives of other makers are read with "WARC/1.0\\r\\n" or
    the like, where a payload that holds such a line shows as not intact.
    """
    if mark is None:
        mark = spark.read.schema("mark string").json(f"{path}/manifest").first()["mark"]
        path = f"{path}/archives"
    lines = spark.read.option("lineSep", mark).text(path).where("value <> ''").select("value", F.col("_metadata.file_path").alias("archive"))
    heads = F.substring_index("value", 2 * CRLF, 2)  # headers of the record and of the response; what follows is cut as bytes
    parts = lines.select("archive", "value", heads.alias("heads"), F.octet_length("value").cast("long").alias("length"), F.octet_length(heads).cast("long").alias("at"))
    head, http = F.substring_index("heads", 2 * CRLF, 1), F.when(F.contains("heads", F.lit(2 * CRLF)), F.substring_index("heads", 2 * CRLF, -1))
    rest = F.col("length") - F.col("at") - 2 * len(2 * CRLF)
    payload = F.when(rest >= 0, F.substring(F.col("value").cast("binary"), (F.col("at") + len(2 * CRLF) + 1).cast("int"), rest.cast("int"))).cast("string")

    def field(name: str, of: Column = head) -> Column:
        found = F.regexp_extract(of, f"(?i)(?:^|{CRLF}){name}:[ \\t]*([^\r\n]*)", 1)
        return F.when(of.rlike(f"(?i)(?:^|{CRLF}){name}:"), found)

    rows = parts.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("X-Page-Id").try_cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("at"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), field("Content-Length", http).try_cast("long").alias("bytes"), field("WARC-Refers-To").alias("refers_to"),
        field("X-Refers-To-Page-Id").try_cast("long").alias("refers_to_page"), field("Content-Length").try_cast("long").alias("_length"), payload.alias("payload"),
        (F.octet_length(http) + len(2 * CRLF) + rest).alias("_block"), "archive", (F.col("length") + len(mark)).alias("size"),
    )
    whole = (F.col("_length") == F.col("_block")) & ((F.col("record_type") != "response") | ((F.octet_length("payload") == F.col("bytes")) & (base32_sha1(F.col("payload")) == F.col("digest"))))
    shown = F.when(F.col("record_type") != "revisit", F.col("payload"))
    return rows.withColumns({"intact": F.coalesce(whole, F.lit(False)), "payload": shown}).drop("_length", "_block")


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds where in its archive, unpacked, each record starts: rows come in the order of their file, which is read by one task."""
    archive, at = None, 0
    for batch in batches:
        offsets = []
        for name, size in zip(batch.column("archive").to_pylist(), batch.column("size").to_pylist()):
            if name != archive:
                archive, at = name, 0
            offsets.append(at)
            at += size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offsets, pa.int64())], names=[*batch.schema.names, "offset"])


class LoserTree:
    """k-way merge of sorted lists: each inner node keeps the loser of its match, so the next least entry costs one path to the root."""

    _END = (1,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers, winners = [0] * self.k, [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.best = winners[1] if self.k > 1 else 0

    def _head(self, run: int) -> tuple:
        entries = self.runs[run]
        return (0, entries[self.at[run]]) if self.at[run] < len(entries) else self._END

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.best] != self._END:
            won = self.best
            yield self.heads[won][1]
            self.at[won] += 1
            self.heads[won] = self._head(won)
            node = (won + self.k) // 2
            while node:
                other = self.losers[node]
                if self.heads[other] < self.heads[won]:
                    self.losers[node], won = won, other
                node //= 2
            self.best = won


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of one key range, in order, with their place in the range and in their URL's captures there."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    runs: dict[int, list[tuple]] = {}
    columns = [table.column(c).to_pylist() for c in ("url_key", "at", "page_id", "run", "pos")]
    for i, (key, at, page, run, pos) in enumerate(zip(*columns)):
        runs.setdefault(run, []).append((key, at, page is None, page or 0, run, pos, i))
    for entries in runs.values():  # a run's entries come in pieces of the order they were sorted in
        if any(a[5] > b[5] for a, b in zip(entries, entries[1:])):
            entries.sort(key=lambda e: e[5])
    order, in_key, last, n = [], [], None, 0
    for entry in LoserTree([runs[r] for r in sorted(runs)]):
        n = n + 1 if entry[0] == last else 0
        last = entry[0]
        order.append(entry[6])
        in_key.append(n)
    table = table.take(pa.array(order)).drop_columns(["run", "pos"])
    table = table.append_column("place", pa.array(range(len(order)), pa.int64())).append_column("in_key", pa.array(in_key, pa.int64()))
    yield from table.combine_chunks().to_batches(max_chunksize=20_000)


def history(records: DataFrame, entries: int = ENTRIES_A_RANGE) -> DataFrame:
    """Index of records in the order of URL key, time and page: all columns but the payload, with url_key, offset, slot and capture.

    slot numbers all captures from 0 without gaps, capture those of one URL key. Every input partition sorts its own
    entries into a run (offset is the place in the unpacked archive, which one task reads whole); the space of (key, time, page, run, place) is cut into ranges of about `entries` entries by Spark's
    range partitioning, so that a URL with very many captures spans several ranges; a task merges the runs of its range.
    """
    spark = records.sparkSession
    thin = records.drop("payload").withColumn("url_key", url_key(F.col("url")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema)
    with Scratch(spark) as held:
        thin = held.keep(thin.mapInArrow(_located, schema + ", offset long"), "index")
        none = F.col("page_id").isNull()
        sorted_runs = thin.sortWithinPartitions("url_key", "at", none, "page_id", "archive", "offset")
        runs = sorted_runs.withColumns({"run": F.spark_partition_id(), "pos": F.monotonically_increasing_id()})
        ranges = max(1, -(-thin.count() // entries))
        runs = runs.repartitionByRange(ranges, "url_key", "at", none, "page_id", "run", "pos")
        merged = runs.mapInArrow(_merged, schema + ", offset long, place long, in_key long").withColumn("part", F.spark_partition_id())
        merged = held.keep(merged, "merged")
        first, last = F.min_by("url_key", "place"), F.max_by(F.struct("url_key", "in_key"), "place")
        ends = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), first.alias("first"), last.alias("last")).orderBy("part").collect()  # one row a range
        carried, before, open_key, open_n = [], 0, None, 0
        for r in ends:
            carry = open_n if r["first"] == open_key else 0
            carried.append((r["part"], before, r["first"], carry))
            before += r["n"]
            same = r["last"]["url_key"] == r["first"]
            open_key, open_n = r["last"]["url_key"], r["last"]["in_key"] + 1 + (carry if same else 0)
        starts = F.broadcast(spark.createDataFrame(carried, "part int, before long, first string, carry long"))
        out = merged.join(starts, "part").withColumns({"slot": F.col("before") + F.col("place"), "capture": F.col("in_key") + F.when(F.col("url_key") == F.col("first"), F.col("carry")).otherwise(0)})
        return materialize(out.drop("part", "place", "in_key", "before", "first", "carry"), "history")


def restored(records: DataFrame) -> DataFrame:
    """records with the payload of each revisit filled in from the response that it refers to; needs that response among them."""
    full = records.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload").alias("_payload"))
    met = records.join(full, F.col("refers_to") == F.col("_id"), "left")
    return met.withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_payload")


def archive_history(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives, reads them back and merges their index; the archives are deleted when the history is saved."""
    spark = pages.sparkSession
    with Scratch(spark) as held:
        path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        held.paths.append(path)
        write_archives(pages, path, least)
        return history(read_records(spark, path))
