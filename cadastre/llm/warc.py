"""WARC archives: records written as text files, read back in splits, and verified along the chain of records.

Reading. A record starts after a line break with `WARC/1.`; so does many a line inside a payload. Spark's text reader splits
the files at this mark, so each task meets the segments of its part of a file. A segment with a version, a header and a
Content-Length is a candidate, and its length names its successor. Tasks emit candidates with positions relative to their
part and with the place where the candidate's chain leaves the part; totals of the parts give positions in the file. Pointer
jumping from the start of each file over these leaving places finds the true first record of each part, and one walk through
a part's candidates keeps what its first record reaches. Marks inside payloads are not reached, whatever follows them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.text import table
from cadastre.operators.joins import lookup_join
from cadastre.session import materialize, shared_folder

END, MARK = "\r\n\r\n", "\nWARC/1."
LEAD = len(MARK) - 1  # bytes of a record that its mark holds
PART_BYTES = 32 << 20
GROUP_PARTS = 100_000  # parts whose positions are broadcast at once
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http"


def _uri(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(key.cast("string")), F.lit(">")), F.lit("<urn:page>"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row, a file per task, no row shuffled while the table of repeated payloads can be broadcast.

    Payloads (text in UTF-8 or binary, NULL: empty) stand behind an HTTP head. Of equal payloads of at least `least` bytes those
    with the smallest id (NULL last) are `response`; the others are `revisit` records without payload, whose head states its
    length and whose WARC-Refers-To its response. Rows that repeat the smallest id are all responses. Control
    characters in URLs are written as %20, a NULL URL has no line; no rows give an archive without records.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))  # cast keeps the bytes of a binary column
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    repeated = materialize(groups.filter("n > 1").select("digest", "least"), "repeated")
    typed = lookup_join(rows, repeated, "digest", "left", row_bytes=96)
    revisit = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _uri(F.col("id"))),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _uri(F.col("least")))),
        F.lit(f"Content-Type: {HTTP}; msgtype=response\r\nContent-Length: "),
    )
    body = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    typed.select(F.concat(header, F.octet_length(body).cast("string"), F.lit(END), body).alias("value")).write.option("lineSep", END).text(path)


@contextmanager
def _fixed_parts(spark: SparkSession, part_bytes: int) -> Iterator[None]:
    """Inside, files are cut into the same parts however many cores there are."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(part_bytes), "spark.sql.files.openCostInBytes": str(part_bytes)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def field(header: str | Column, name: str) -> Column:
    """The value of a header field, NULL where it is missing; the first of several."""
    header = F.col(header) if isinstance(header, str) else header
    return F.nullif(F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("lineSep", MARK).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    return found.withColumn("span", F.octet_length("value").cast("long") + len(MARK))


def _parsed(found: DataFrame) -> DataFrame:
    """With header (NULL: no candidate), its bytes, the declared length, and whether the segment holds the whole block."""
    cut = F.substring_index("value", END, 1)
    size = F.octet_length("value")
    found = found.withColumn("header", cut).withColumn("head", F.when(F.octet_length("header") < size, F.octet_length("header")).when(F.col("value").endswith("\r\n\r"), size - 3))
    found = found.withColumn("length", F.when(F.col("header").rlike(r"\A(WARC/1\.)?[0-9]+\r\n"), field("header", "Content-Length").try_cast("long")))
    found = found.withColumn("header", F.when(F.col("head").isNotNull() & (F.col("length") >= 0), F.col("header")))
    return found.withColumn("whole", F.col("header").isNotNull() & (size >= F.col("head") + len(END) + F.col("length")))


def _measured(found: DataFrame) -> DataFrame:
    """With what the block's payload measures, where the segment holds it: after the HTTP head, if it has one."""
    content = F.substring(F.col("value").cast("binary"), F.col("head") + len(END) + 1, F.col("length").cast("int"))
    found = found.withColumn("content", F.when(F.col("whole"), content)).withColumn("http", F.when(field("header", "Content-Type").startswith(HTTP), F.substring_index(F.col("content").cast("string"), END, 1)))
    payload = F.when(F.col("http").isNull(), F.col("content")).otherwise(F.substring(F.col("content"), F.octet_length("http") + len(END) + 1, F.lit((1 << 31) - 1)))
    found = found.withColumn("payload", payload)
    return found.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256), "stated_bytes": field("http", "Content-Length").try_cast("long")})


MEASURES = "header string, whole boolean, payload_bytes long, payload_digest string, stated_bytes long"
CANDIDATES = f"file string, part long, at long, next long, leave long, {MEASURES}"
_ARROW = pa.schema([("file", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("leave", pa.int64()), ("header", pa.string()), ("whole", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_bytes", pa.int64())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each part with the place where their chain leaves it, then a row with the part's total (at: -1).

    Rows come in the order of the file. What a task keeps is the headers of one part.
    """
    kept: list[dict] = []
    here, total = None, 0

    def closed() -> pa.RecordBatch:
        leave: dict[int, int | None] = {}
        for row in reversed(kept):
            row["leave"] = leave[row["at"]] = row["next"] if row["next"] >= total else leave.get(row["next"])
        kept.append({"file": here[0], "part": here[1], "at": -1, "next": total})
        return pa.RecordBatch.from_pylist(kept, _ARROW)

    for batch in batches:
        for row in batch.to_pylist():
            if (row["file"], row["part"]) != here:
                if here:
                    yield closed()
                kept, here, total = [], (row["file"], row["part"]), 0
            first = row["part"] == 0 and total == 0
            if row["header"] is not None and row.pop("led") == first:
                row["at"] = total
                row["next"] = total + row.pop("head") + row.pop("length") + 2 * len(END) + LEAD
                kept.append(row)
            total += row["span"]
    if here:
        yield closed()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the candidates of each part, sorted, those that its true first record reaches."""
    here, wanted = None, 0
    for batch in batches:
        files, parts, at, after, first = (batch.column(c).to_pylist() for c in ("file", "part", "at", "next", "first"))
        keep = []
        for k in range(len(at)):
            if (files[k], parts[k]) != here:
                here, wanted = (files[k], parts[k]), first[k]
            if at[k] == wanted:
                keep.append(k)
                wanted = after[k]
        yield batch.take(pa.array(keep, pa.int64()))


def _true_starts(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """(file, part, first, base, total): relative position of the first true record of each part that has one."""
    placed = candidates.filter("at >= 0").select("file", "part", "at", "leave").join(parts, ["file", "part"])
    nodes = placed.select("file", "part", (F.col("base") + F.col("at")).alias("place"), (F.col("base") + F.col("leave")).alias("to"))
    reached = nodes.filter("to IS NOT NULL").select("file", F.col("to").alias("place")).distinct()
    nodes = materialize(nodes.filter("place = 0").unionByName(nodes.filter("place > 0").join(reached, ["file", "place"], "left_semi")), "places")
    jumps = nodes.filter("to IS NOT NULL").select("file", "place", "to")
    seen = nodes.filter("place = 0").select("file", "place")
    longest = parts.groupBy("file").count().agg(F.max("count")).head()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):  # a chain enters each part once at most
        seen = materialize(seen.union(seen.join(jumps, ["file", "place"]).select("file", F.col("to").alias("place"))).distinct(), "reached")
        then = jumps.select("file", F.col("place").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(then, ["file", "to"]).select("file", "place", F.col("beyond").alias("to")), "jumps")
    starts = nodes.join(seen, ["file", "place"], "left_semi").select("file", "part", "place")
    return starts.join(parts, ["file", "part"]).select("file", "part", (F.col("place") - F.col("base")).alias("first"), "base", "total")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of true records (place of the record, place of the segment); those of records in one segment where `all`."""
    here = None
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in ("file", "part", "span", "base", "open", "first", "head", "length", "whole", "every")}
        record, keep = [], []
        places = []
        for k in range(batch.num_rows):
            if (rows["file"][k], rows["part"][k]) != here:
                here, place, owner, wanted, single = (rows["file"][k], rows["part"][k]), rows["base"][k], rows["open"][k], rows["first"][k], False
            if place == wanted:
                owner, single = place, rows["whole"][k]
                wanted = place + rows["head"][k] + rows["length"][k] + 2 * len(END) + LEAD
            elif single or (wanted is not None and place > wanted):
                owner = None
            if owner is not None and (rows["every"][k] or not single):
                keep.append(k)
                record.append(owner)
                places.append(place)
            place += rows["span"][k]
        taken = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([taken.column("file"), pa.array(record, pa.int64()), pa.array(places, pa.int64()), taken.column("whole"), taken.column("value")], ["file", "record", "place", "whole", "value"])


def _read_again(spark: SparkSession, path: str, records: DataFrame, parts: DataFrame, files: DataFrame, every: bool) -> DataFrame:
    """Whole text of the records that lie in several segments, or of all: (file, record, value)."""
    last = records.groupBy("file", "part").agg(F.min(F.col("base") + F.col("at")).alias("first"), F.max(F.struct((F.col("base") + F.col("at")).alias("place"), (F.col("base") + F.col("next")).alias("next"), "whole")).alias("last"))
    order = Window.partitionBy("file").orderBy("part")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = parts.join(files, "file", "left_semi").join(last, ["file", "part"], "left").withColumn("before", before)
    open_ = F.when((F.col("before.next") > F.col("base")) & ~F.col("before.whole"), F.col("before.place"))  # has segments in this part
    known = materialize(known.select("file", "part", "base", open_.alias("open"), F.coalesce("first", "before.next").alias("first")), "part-places")
    groups, size = [[]], 0
    for name, n in known.groupBy("file").count().collect():  # the driver lists the files anyway
        if size + n > GROUP_PARTS and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(name)
        size += n
    shape = "file string, record long, place long, whole boolean, value binary"
    found = None
    for names in groups:
        here = F.broadcast(known.filter(F.col("file").isin(names)))
        rows = _parsed(_segments(spark, path).filter(F.col("file").isin(names))).join(here, ["file", "part"]).withColumns({"every": F.lit(every), "value": F.col("value").cast("binary")})
        some = materialize(rows.select("file", "part", "span", "base", "open", "first", "head", "length", "whole", "every", "value").mapInArrow(_pieces, shape), "pieces")
        found = some if found is None else found.unionByName(some)
    alone = found.filter("whole AND record = place").select("file", "record", F.col("value").cast("string").alias("value"))
    torn = found.filter("NOT (whole AND record = place)").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("place", F.col("value").cast("string").alias("value")))).alias("all"))
    return alone.unionByName(torn.select("file", "record", F.array_join(F.transform("all", lambda x: x["value"]), MARK).alias("value")))


def read_warc(spark: SparkSession, path: str, payloads: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per verified record: file, offset, header, payload_bytes, payload_digest (SHA-256), stated_bytes (HTTP Content-Length), and payload if asked.

    `path` names a file, folder or pattern that Spark can read. Compressed files are read in one part each, with offsets in the
    plain text. Marks inside payloads, truncated last records and what follows a broken record are left out; empty
    files have no records. Without `payloads` only records with a mark inside their payload are read twice. A record must fit into a
    row (2 GB). The results are written to the shared folder.
    """
    with _fixed_parts(spark, part_bytes):
        found = _measured(_parsed(_segments(spark, path)))
        led = F.col("value").startswith(MARK[1:])
        rows = found.select("file", "part", "span", "head", "length", led.alias("led"), *[f.split()[0] for f in MEASURES.split(", ")])
        candidates = materialize(rows.mapInArrow(_chained, CANDIDATES), "candidates")
        order = Window.partitionBy("file")
        sums = candidates.filter("at < 0").select("file", "part", F.col("next").alias("bytes"))
        running = F.sum("bytes").over(order.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = materialize(sums.select("file", "part", F.coalesce(running, F.lit(0)).alias("base"), (F.sum("bytes").over(order) - len(MARK)).alias("total")), "parts")
        starts = materialize(_true_starts(candidates, parts), "starts")
        joined = candidates.filter("at >= 0").join(starts, ["file", "part"]).repartition("file", "part").sortWithinPartitions("file", "part", "at")
        walked = joined.mapInArrow(_walk, joined.schema)
        records = materialize(walked.filter(F.col("base") + F.col("next") - LEAD - len(END) <= F.col("total")), "records")
        torn = records.filter("NOT whole").select("file").distinct()
        place = F.col("base") + F.col("at")
        out = records.select("file", place.alias("record"), *[f.split()[0] for f in MEASURES.split(", ")])
        if payloads or not torn.isEmpty():
            files = records.select("file").distinct() if payloads else torn
            again = _measured(_parsed(_read_again(spark, path, records, parts, files, payloads))).select("file", "record", *[f.split()[0] for f in MEASURES.split(", ")], "payload")
            real = records.select("file", place.alias("record"))
            again = again.join(real, ["file", "record"], "left_semi")
            out = again if payloads else out.filter("whole").unionByName(again.drop("payload"))
        offset = F.greatest(F.lit(0), F.col("record") - LEAD)
        header = F.when(F.col("header").startswith(MARK[1:]), F.col("header")).otherwise(F.concat(F.lit(MARK[1:]), F.col("header")))
        return materialize(out.select("file", offset.alias("offset"), header.alias("header"), "payload_bytes", "payload_digest", "stated_bytes", *["payload"] * payloads), "warc")


def page_of(uri: Column) -> Column:
    """The id in a record's name; NULL where it has none."""
    return F.when(uri.startswith("<urn:page:"), F.url_decode(F.regexp_extract(uri, "^<urn:page:(.*)>$", 1)))


def op11_boundary_chain(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    revisit = F.col("record_type") == "revisit"
    out = read_warc(spark, folder).withColumn("record_type", field("header", "WARC-Type"))
    return out.select(
        page_of(field("header", "WARC-Record-ID")).cast("long").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(field("header", "WARC-Payload-Digest"), ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page_of(field("header", "WARC-Refers-To")).cast("long")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM g
"""
