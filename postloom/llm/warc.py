"""WARC archives: records written by Spark's text writer, read back by verified boundaries.

Writing: a record is one text value and the record terminator is the line
separator, so every task writes valid archives. Of pages with equal payloads
one is a response and the others are revisits without a payload.

Reading: the record magic is the reader's line separator. Archives are split
like any text, and each line after the first starts behind a magic: a candidate
record, real or inside a payload. A task emits a row per candidate: where it
starts in the lines of its split, where its successor must start by its
Content-Length, and where its chain leaves the split. Summed line lengths turn
these into offsets in the file. Pointer jumping over the exits, from offset 0
of each file, finds where the true chain enters every split; a walk inside the
split keeps the records on it. A magic inside a payload is never on the chain.

Payloads are digested in the first scan. Only records that a magic in their own
payload or the end of a split cuts up are gathered in a second one.
"""

from __future__ import annotations

import sys
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.store import stored
from postloom.session import scratch_path

# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Width of the ranges by which cut records find their lines.
RANGE = 1 << 16
#: Up to so many repeated payloads (40 bytes each) are broadcast; more are joined by shuffle.
FEW_PAYLOADS = 200_000


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: 20 bits, or 5 hex digits, make 4 letters."""
    digits = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id bigint, url string, html string) below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the
    largest page_id are responses, the others revisit it. A null html is an empty
    payload, a null page_id is smaller than any other, a null url is left out;
    blanks and control characters in urls are percent-encoded. Rows alike in
    page_id and payload are written alike. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # Only payloads that occur again matter; few of them need not move the pages.
    again = rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = stored(again.withColumn("repeated", F.lit(True)), "warc-repeated")
    small = again.limit(FEW_PAYLOADS + 1).count() <= FEW_PAYLOADS
    rows = rows.join(F.broadcast(again) if small else again, "digest", "left").withColumn("size", F.octet_length("html"))
    revisit = F.coalesce("repeated", F.lit(False)) & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    rows = rows.withColumn("revisit", revisit)
    nl = "\r\n"
    http = F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}{nl}")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", " ", "%20"), r"[\x00-\x1F\x7F]", "%0A")
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html")))
    head = F.concat_ws(
        nl,
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name("largest"))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    record = rows.withColumn("block", block).select(F.concat(F.lit(MAGIC.decode()), head, F.lit(END.decode()), F.col("block")).alias("value"))
    record.write.option("lineSep", END.decode()).text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon:
            out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _page(name: str | None) -> int | None:
    """The page_id in <urn:page:ID:DIGEST>."""
    part = (name or "").split(":")
    return int(part[2]) if len(part) == 4 and part[2].lstrip("-").isdigit() else None


_CANDIDATE = (
    "file string, block bigint, total bigint, at bigint, head bigint, content bigint, next bigint, out bigint, whole boolean, "
    "record_type string, page_id bigint, url string, refers_to bigint, declared string, length bigint, payload_bytes bigint, payload_digest string"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _candidates(lines: DataFrame, with_payload: bool) -> DataFrame:
    """A row per line behind a magic, and one per split with its summed line lengths (at is null)."""

    def payload_of(block: bytes) -> bytes:
        return block.partition(END)[2]

    def parse(line: bytes, at: int) -> list:
        cut = line.find(END)
        got = _fields(line[:cut]) if cut >= 0 else {}
        content = got.get("content-length", "")
        if not content.isdigit():
            return [at, None, None, None, None, False, *[None] * 9]
        head, size = cut + len(END), int(content)
        end = at + len(MAGIC) + head + size + len(END)
        whole = len(line) >= head + size
        payload = payload_of(line[head : head + size]) if whole else None
        length = got.get("x-payload-length", "")
        return [
            at, head, size, end, None, whole, got.get("warc-type"), _page(got.get("warc-record-id")), got.get("warc-target-uri"), _page(got.get("warc-refers-to")),
            got.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(length) if length.isdigit() else None,
            None if payload is None else len(payload), None if payload is None else b32encode(sha1(payload).digest()).decode(), payload,
        ]

    names = [x.split()[0] for x in _CANDIDATE.split(", ")] + ["payload"] * with_payload
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in _CANDIDATE.split(", ")] + [pa.binary()] * with_payload

    def flush(split: tuple[str, int], total: int, found: list[list]) -> pa.RecordBatch:
        # Successors lie behind their records, so the chain's exit is known from the back.
        exits: dict[int, int | None] = {}
        for row in reversed(found):
            row[4] = exits.get(row[3], row[3])
            exits[row[0]] = row[4]
        found.append([None] * 15)
        rows = [[*split, total, *row] for row in found]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, found = None, 0, []
        for batch in batches:
            for file, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if split != (file, block):
                    if split:
                        yield flush(split, at, found)
                    split, at, found = (file, block), 0, []
                value = line.as_py()
                if block or at:  # all lines but the one before a file's first magic
                    found.append(parse(value, at - len(MAGIC)))
                at += len(value) + len(MAGIC)
        if split:
            yield flush(split, at, found)

    return lines.mapInArrow(rows, _CANDIDATE + ", payload binary" * with_payload)


def _entries(nodes: DataFrame, hops: int) -> DataFrame:
    """(file, start): exits that the chain from offset 0 reaches, by pointer jumping."""
    reached = nodes.where("start = 0").select("file", "start")
    jump = nodes.select("file", "start", "leads")
    done = 1
    while done < hops:
        step = reached.join(jump, ["file", "start"]).select("file", F.col("leads").alias("start"))
        reached = stored(reached.union(step).distinct(), "warc-reached")
        far = jump.select("file", F.col("start").alias("leads"), F.col("leads").alias("beyond"))
        jump = stored(jump.join(far, ["file", "leads"]).select("file", "start", F.col("beyond").alias("leads")), "warc-jump")
        done *= 2
    return reached


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(file, start, record_type, page_id, url, refers_to, payload_bytes, payload_digest[, payload]), one row per record.

    Bytes and digest of a response are those of the payload read; a revisit
    carries those its headers declare. Only records on the chain of successors
    from the start of each file count; where a chain breaks or a record is cut
    off by the end of its file, the rest of that file gives no rows.
    """
    lines = _lines(spark, path)
    found = stored(_candidates(lines, with_payload), "warc-candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored(
        found.where("at is null").select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.count("*").over(Window.partitionBy("file")).alias("hops")),
        "warc-splits",
    )
    placed = (
        found.where("at is not null and next is not null")
        .join(splits.drop("hops"), ["file", "block"])
        .withColumns({"start": F.col("base") + F.col("at"), "leads": F.col("base") + F.col("out"), "end": F.col("base") + F.col("next")})
        .drop("base", "total")
    )
    ends = placed.select("file", F.col("leads").alias("start")).union(splits.select("file", F.lit(0).cast("bigint"))).distinct()
    nodes = stored(placed.select("file", "block", "start", "leads").join(ends, ["file", "start"]), "warc-nodes")
    hops = splits.agg(F.max("hops")).head()[0] or 0
    entries = _entries(nodes, hops).join(nodes.select("file", "start", "block"), ["file", "start"])
    chain = placed.join(entries.select("file", "block", F.col("start").alias("entry")), ["file", "block"])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        keep, expected = [], rows["entry"].min()
        for start, end in zip(rows["start"], rows["end"], strict=True):
            keep.append(start == expected)
            expected = end if keep[-1] else expected
        return rows[keep]

    records = stored(chain.groupBy("file", "block").applyInPandas(walk, chain.schema), "warc-records")
    out = ["file", "start", "record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", *["payload"] * with_payload]
    cut = records.where("not whole")
    if not cut.isEmpty():
        records = records.where("whole").select(*records.columns).unionByName(_gathered(cut, lines, splits, with_payload), allowMissingColumns=True)
    revisit = F.col("record_type") == "revisit"
    return records.withColumns(
        {"payload_bytes": F.when(revisit, F.col("length")).otherwise(F.col("payload_bytes")), "payload_digest": F.when(revisit, F.col("declared")).otherwise(F.col("payload_digest"))}
    ).select(*out)


def _gathered(cut: DataFrame, lines: DataFrame, splits: DataFrame, with_payload: bool) -> DataFrame:
    """Records of which the own line holds only the first part, with all their lines."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            places = []
            for file, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if split != (file, block):
                    split, at = (file, block), 0
                places.append(at)
                at += len(line.as_buffer()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["file", "block", "line", "at"])

    def ranges(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / RANGE), F.floor(last / RANGE)))

    body = F.col("from") + F.col("head") + F.col("content")
    wanted = cut.withColumn("from", F.col("start") + len(MAGIC)).withColumn("to", body)
    wanted = wanted.withColumn("range", ranges(F.col("from"), F.col("to"))).select("file", "start", "head", "content", "from", "to", "range")
    parts = lines.mapInArrow(place, "file string, block bigint, line binary, at bigint").join(splits.drop("hops"), ["file", "block"])
    parts = parts.withColumn("here", F.col("base") + F.col("at")).withColumn("stop", F.col("here") + F.octet_length("line"))
    parts = parts.select("file", "here", "stop", "line", ranges(F.col("here"), F.col("stop")).alias("range"))
    met = parts.join(wanted, ["file", "range"]).where("here <= to and stop >= from")
    met = met.where(F.col("range") == F.greatest(F.floor(F.col("here") / RANGE), F.floor(F.col("from") / RANGE)))
    whole = met.groupBy("file", "start", "head", "content").agg(F.array_sort(F.collect_list(F.struct("here", "line"))).alias("lines"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = MAGIC.join(x["line"] for x in row["lines"])
                if len(raw) >= row["head"] + row["content"]:
                    payload = raw[row["head"] : row["head"] + row["content"]].partition(END)[2]
                    out.append((row["file"], row["start"], len(payload), b32encode(sha1(payload).digest()).decode(), payload))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "start", "payload_bytes", "payload_digest", "payload"])

    made = whole.mapInArrow(join, "file string, start bigint, payload_bytes bigint, payload_digest string, payload binary")
    made = made if with_payload else made.drop("payload")
    return cut.drop("payload_bytes", "payload_digest", "payload").join(made, ["file", "start"])


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages``, as read back from archives."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
