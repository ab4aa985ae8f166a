"""WARC: writing records, and reading archives whose records are told from look-alikes.

An archive is read in splits. Each task cuts its splits at every record magic,
also where that stands inside a payload, and emits for each candidate its offset and
the offset of its successor as its header gives it. Chains within a split are followed
there; what remains are links from split to split, which pointer jumping resolves from
the start of each file. A last pass over the small candidate table keeps what lies on a
verified chain. A payload that was cut at look-alikes is put together again from its pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctual.llm.common import drop_stored, join_dealt, small_side, stored

MAGIC = "WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# possessive, so that a long line is read once
_FIELD = re.compile(rb"(?m)^([A-Za-z-]++): *+([^\r\n]*+)\r$")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each row of pages, in as many archives as pages has partitions.

    Of equal payloads of at least min_bytes bytes that with the smallest id is a response, the others are revisits
    that name it. A null html is an empty payload, a null url a missing target. Ids are whole numbers. Rows without an id are left out; rows
    that repeat an id and payload are responses, or revisits, alike; rows that repeat an id with another payload are pages of their own.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), F.lit(r"[\x00-\x20]"), F.lit("")).alias("url"), html.cast("binary").alias("html"))
    pages = pages.withColumn("sha", F.sha1("html"))
    keys = pages.where(F.octet_length("html") >= min_bytes).select("id", "sha")
    first = stored(keys.groupBy("sha").agg(F.min("id").alias("refers_to"), F.max("id").alias("most"), F.count("*").alias("_w")).where("most > refers_to"), "first")
    several = keys.join(small_side(first.select("sha")), "sha", "left_semi")
    revisits = stored(join_dealt(several, first.select("sha", "refers_to"), "sha", first.select("sha", "_w"), "id").where("id > refers_to").distinct(), "revisits")

    def run(batches):
        for batch in batches:
            lines = []
            for doc, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                block = _HTTP if refers_to is not None else _HTTP + html
                fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{doc}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{base32_sha1(html)}"), ("Payload-Length", len(html))]
                if refers_to is not None:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
                fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
                lines.append(MAGIC.encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])

    records = pages.join(small_side(revisits), ["id", "sha"], "left").select("id", "url", "html", "refers_to").mapInArrow(run, "value binary")
    # the writer ends each record with its second line end
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").text(out)


def _header(chunk: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Fields and length of the header that chunk, which follows a magic, begins with; None if it has none."""
    end = chunk.find(b"\r\n\r\n")
    fields = dict(_FIELD.findall(chunk[: end + 2])) if end >= 0 else {}
    return (fields, end + 4) if fields.get(b"Content-Length", b"").isdigit() and b"WARC-Type" in fields else None


_META = "file string, block long, at long, size long, head int, length long, jump long, to long, leaves boolean"
_RECORD = "record_id string, record_type string, url string, digest string, full_length long, refers_to string, payload_bytes long, payload_sha1 string"


def _payload(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batches):
    """(file, block), then its chunks with their places from where the split begins."""
    now, at = None, 0
    for batch in batches:
        for value, file, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (file, block) != now:
                now, at = (file, block), 0
            yield now, at, value
            at += len(value) + len(MAGIC)


def _candidates(batches):
    """Every chunk: place in its split, header, where its record would end (`to`, from the split's begin), and whether and
    to what place the chain from there leaves the split (`leaves`, `jump`)."""
    names = [x.split()[0] for x in f"{_META}, {_RECORD}".split(", ")]

    def flush(key, rows, size):
        exits: dict[int, int | None] = {}
        for row in reversed(rows):
            to = row[4]
            exits[row[0]] = None if to is None else to if to >= size else exits.get(to)
        columns = [[key[0]] * len(rows), [key[1]] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [exits[r[0]] for r in rows], [r[4] for r in rows], [exits[r[0]] is not None for r in rows], *([r[5][k] for r in rows] for k in range(8))]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    now, rows, size = None, [], 0
    for key, at, value in _splits(batches):
        if key != now:
            if rows:
                yield flush(now, rows, size)
            now, rows = key, []
        size = at + len(value) + len(MAGIC)
        head = _header(value)
        if head is None:
            rows.append((at, len(value), None, None, None, (None,) * 8))
            continue
        fields, length = head[0], int(head[0][b"Content-Length"])
        text = lambda k, f=fields: f[k].decode("utf-8", "replace") if k in f else None
        whole = head[1] + length + 4 == len(value)
        payload = _payload(value[head[1] : head[1] + length]) if whole else b""
        full = text(b"Payload-Length")
        own = (text(b"WARC-Record-ID"), text(b"WARC-Type"), text(b"WARC-Target-URI"), (text(b"WARC-Payload-Digest") or "").removeprefix("sha1:"), int(full) if full and full.isdigit() else None, text(b"WARC-Refers-To"), len(payload) if whole else None, base32_sha1(payload) if whole else None)
        # a successor's place is that behind its magic, as all places are
        rows.append((at, len(value), head[1], length, at + head[1] + length + 4 + len(MAGIC), own))
    if rows:
        yield flush(now, rows, size)


def _entries(jumps: DataFrame) -> DataFrame:
    """file, at: where verified chains enter splits. jumps: file, at -> to (absolute places); chains begin at the first magic."""
    jumps = stored(jumps, "jumps")
    reached = jumps.where(F.col("at") == len(MAGIC)).select("file", "at").distinct()
    n = reached.count()
    while n:
        grown = stored(reached.unionByName(jumps.join(reached, ["file", "at"], "left_semi").select("file", F.col("to").alias("at"))).distinct(), "reached")
        now = grown.count()
        if now == n:
            return grown
        n, reached = now, grown
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        old, jumps = jumps, stored(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("further").alias("to")), "jumps")
        drop_stored(old)
    return reached


def _on_chain(pdf):
    """Of one split's candidates: those that the chain from an entry passes."""
    follow = dict(zip(pdf["at"].tolist(), pdf["to"].tolist(), strict=True))
    on = set()
    for at in pdf.loc[pdf["entry"], "at"].tolist():
        while at in follow and at not in on and follow[at] == follow[at]:
            on.add(at)
            at = int(follow[at])
    return pdf.assign(real=pdf["at"].isin(on))[["file", "block", "at", "real"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each verified record of the archives in path.

    record_id, record_type, url, digest and full_length (of the full payload, as the header says), refers_to,
    payload_bytes and payload_sha1 (of the payload that the record holds). Records behind a broken or
    missing header are not on a chain and are left out, as are look-alikes in payloads and a last record that its file cuts short.
    """
    found = stored(_chunks(spark, path).mapInArrow(_candidates, f"{_META}, {_RECORD}"), "candidates")
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    begins = stored(sizes.select("file", "block", F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin")), "begins")
    lengths = stored(sizes.groupBy("file").agg((F.sum("bytes") - len(MAGIC)).alias("file_bytes")), "lengths")
    placed = found.join(small_side(begins), ["file", "block"])
    jumps = placed.where("leaves").select("file", (F.col("begin") + F.col("at")).alias("at"), (F.col("begin") + F.col("jump")).alias("to"))
    starts = placed.where(F.col("begin") + F.col("at") == len(MAGIC)).select("file", F.lit(len(MAGIC)).cast("long").alias("at"))
    entries = _entries(jumps).unionByName(starts).distinct().withColumn("entry", F.lit(True))
    asked = placed.where("head is not null").select("file", "block", "begin", "at", "to").withColumn("abs", F.col("begin") + F.col("at"))
    entered = asked.join(entries.withColumnRenamed("at", "abs"), ["file", "abs"], "left").select("file", "block", "at", "to", F.coalesce("entry", F.lit(False)).alias("entry"))
    # a group is one split, so its size is bounded by spark.sql.files.maxPartitionBytes
    real = entered.groupBy("file", "block").applyInPandas(_on_chain, "file string, block long, at long, real boolean").where("real")
    records = stored(placed.join(real.drop("real"), ["file", "block", "at"]).withColumn("abs", F.col("begin") + F.col("at")), "records")
    records = records.join(small_side(lengths), "file").where(F.col("abs") + F.col("head") + F.col("length") <= F.col("file_bytes"))
    names = [x.split()[0] for x in _RECORD.split(", ")]
    if records.where("payload_bytes is null").isEmpty():
        return records.select(*names)
    return records.where("payload_bytes is not null").select(*names).unionByName(_joined(spark, path, placed, records.where("payload_bytes is null"), names))


def _joined(spark: SparkSession, path: str, placed: DataFrame, cut: DataFrame, names: list[str]) -> DataFrame:
    """Records whose payload holds look-alikes: their pieces are read again and put in order; a group is one record."""
    ends = cut.select("file", F.col("abs").alias("first"), (F.col("abs") + F.col("head") + F.col("length")).alias("end"))
    pieces = placed.select("file", "block", "at", (F.col("begin") + F.col("at")).alias("abs"), "begin").join(ends.withColumnRenamed("first", "abs"), ["file", "abs"], "left")
    before = Window.partitionBy("file").orderBy("abs")
    own = pieces.withColumns({"first": F.last(F.when(F.col("end").isNotNull(), F.col("abs")), ignorenulls=True).over(before), "until": F.last("end", ignorenulls=True).over(before)})
    wanted = stored(own.where("abs <= until").select("file", "block", "at", "abs", "first"), "pieces")

    def run(batches):
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "block", "at", "value"])
        for (file, block), at, value in _splits(batches):
            rows.append((file, block, at, value))
            size += len(value)
            if size > 4_000_000 or len(rows) >= 1000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    texts = _chunks(spark, path).mapInArrow(run, "file string, block long, at long, value binary").join(small_side(wanted), ["file", "block", "at"])

    def join(pdf):
        data = MAGIC.encode().join(pdf.sort_values("abs")["value"])
        head = _header(data)
        payload = _payload(data[head[1] : head[1] + int(head[0][b"Content-Length"])])
        return pdf.iloc[:1][["file", "first"]].assign(n=len(payload), sha=base32_sha1(payload))

    whole = texts.select("file", "first", "abs", "value").groupBy("file", "first").applyInPandas(join, "file string, first long, n long, sha string")
    both = cut.join(whole.withColumnRenamed("first", "abs"), ["file", "abs"])
    return both.withColumns({"payload_bytes": F.col("n"), "payload_sha1": F.col("sha")}).select(*names)


def digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of what read_archives() gives of our own archives."""
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?[0-9]+)>", 1)
    whole = F.col("record_type") == "response"
    return records.select(number("record_id").cast("long").alias("page_id"), F.when(whole, F.col("payload_bytes")).otherwise(F.col("full_length")).alias("payload_bytes"), F.when(whole, F.col("payload_sha1")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).cast("long").alias("refers_to"))
