"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm.shared import stored

MAGIC = b"WARC/1.0\r"
BREAK = "\r\n"
END = 4
"""Bytes between a record's content and the next record."""
PIECE = ("file string, block long, rel long, size long, starts boolean, head long, content long, type string, record string, url string, "
         "digest string, refers string, full long, found string, data binary")
SUMMARY = [f.split()[0] for f in PIECE.split(", ")]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC/1.0 record per row below `folder`, several plain files.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at
    least `least_bytes` bytes the one with the smallest id becomes a response and the
    others revisits that name it and carry no payload; rows that repeat that id and
    payload are responses too. All smaller payloads are responses. Repeated rows get a
    record each, line breaks in an url are written as %0D and %0A, null ids and urls are
    left empty, other columns are ignored, an empty table gives no records.

    Digests are grouped without the pages; the list of revisits is written first, so its
    size is known when the pages are joined with it.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    large = p.where((F.col("size") >= least_bytes) & F.col("id").isNotNull()).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    revisits = stored(large.distinct().join(first, "digest").where("id <> first"), "revisits")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{BREAK}{name}: "), value)
    urn = lambda c: F.concat(F.lit("<urn:page:"), text(c), F.lit(">"))
    again = F.col("first").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(MAGIC.decode().strip()), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, line("WARC-Refers-To", urn("first"))).otherwise(F.lit("")),
        line("X-Payload-Length", text("size")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK * 2), block)
    # the writer ends every value with what stands between two records
    p.join(revisits, ["id", "digest"], "left").select(record.alias("value")).write.option("lineSep", BREAK * 2).text(folder)


def header(raw: bytes) -> dict | None:
    """Fields of a header, and where it ends; None if it is cut or says no length."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in raw[:end].split(b"\r\n")[1:])}
    if not re.fullmatch(rb"\d{1,18}", field.get(b"content-length", b"")):
        return None
    said = lambda name: field[name].decode("utf-8", "replace") if name in field else None
    return {"head": end + 4, "content": int(field[b"content-length"]), "type": said(b"warc-type"), "record": said(b"warc-record-id"),
            "url": said(b"warc-target-uri"), "digest": said(b"warc-payload-digest"), "refers": said(b"warc-refers-to"),
            "full": int(field[b"x-payload-length"]) if field.get(b"x-payload-length", b"").isdigit() else None}


def cut(lines: list[bytes], starts: list[int], light: bool) -> list[dict]:
    """Pieces of one part of a file, cut before every line that could start a record.

    A piece that is exactly one record, and in no span of an earlier one, keeps only the
    digest of its content (if `light`); the others keep their bytes.
    """
    out, rel, reach = [], 0, 0
    edges = [0, *[s for s in starts if s], len(lines)]
    for a, b in zip(edges, edges[1:]):
        data = b"\n".join(lines[a:b]) + b"\n"
        begins = bool(starts) and a == starts[0] or a > 0
        found = header(data) if begins else None
        row = dict.fromkeys(SUMMARY) | {"rel": rel, "size": len(data), "starts": begins} | (found or {})
        span = found["head"] + found["content"] + END if found else 0
        if light and span == len(data) and rel >= reach:
            row["found"] = hashlib.sha256(data[found["head"]:-END]).hexdigest()
        else:
            row["data"] = data
        reach = max(reach, rel + span)
        rel += len(data)
        out.append(row)
    return out


def scanned(spark: SparkSession, folder: str, light: bool) -> DataFrame:
    """Pieces of all archives, each task cutting its own parts of files."""
    lines = spark.read.option("lineSep", "\n").text(folder).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, starts = None, [], []

        def flush() -> pa.RecordBatch:
            # up to the last start: what follows it may go on in the next batch
            return pa.RecordBatch.from_pylist([r | {"file": at[0], "block": at[1]} for r in cut(held, starts, light)], schema=schema)

        for batch in batches:
            for line, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    if at:
                        yield flush()
                    at, held, starts = (file, block), [], []
                if line == MAGIC:
                    starts.append(len(held))
                held.append(line)
        if at:
            yield flush()

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in PIECE.split(", "))])
    return lines.mapInArrow(scan, PIECE)


def placed(pieces: DataFrame) -> DataFrame:
    """Pieces with their place `off` in the file; a header cut by a part's end is completed."""
    parts = pieces.groupBy("file", "block").agg(F.sum("size").alias("length"))
    order = Window.partitionBy("file").orderBy("block")
    parts = parts.select("file", "block", (F.sum("length").over(order) - F.col("length")).alias("base"), "length", F.lead("block").over(order).alias("after"))
    whole = pieces.join(parts, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel"))
    leads = pieces.where("not starts").select("file", F.col("block").alias("after"), F.col("data").alias("next"))

    def complete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r | (header(bytes(r["data"]) + bytes(r["next"])) or {}) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*SUMMARY, "off"]).astype({"head": "Int64", "content": "Int64", "full": "Int64"})

    # only the last piece of a part can have such a header
    torn = F.col("starts") & F.col("head").isNull() & (F.col("rel") + F.col("size") == F.col("length"))
    fixed = whole.where(torn).join(leads, ["file", "after"], "left").select(*SUMMARY, "off", F.coalesce("next", F.lit(b"")).alias("next")) \
        .mapInPandas(complete, PIECE + ", off long")
    return whole.where(~torn).select(*SUMMARY, "off").union(fixed)


def reachable(pieces: DataFrame) -> DataFrame:
    """(file, off) of the records that the chain from the start of their file reaches.

    Every candidate points to where the next record must start. Within a part of a file
    the chains are followed in one task, to the first place beyond the part. Between
    parts pointers are jumped: each round doubles the parts that a pointer passes, so the
    rounds are the logarithm of the parts of the largest file. Then each part marks its
    records from the place where the chain enters it.
    """
    cands = pieces.where("starts and head is not null").select("file", "block", "off", (F.col("off") + F.col("head") + F.col("content") + END).alias("next"))

    def leave(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("off", ascending=False, ignore_index=True)
        out: dict[int, int] = {}
        for off, following in zip(group["off"], group["next"]):
            out[off] = out.get(following, following)
        return group.assign(exit=group["off"].map(out))

    chains = stored(cands.groupBy("file", "block").applyInPandas(leave, "file string, block long, off long, next long, exit long"), "chains")
    most = chains.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 1
    reach = chains.where("off = 0").select("file", "off")
    jump = chains.select("file", "off", F.col("exit").alias("to"))
    for _ in range((most - 1).bit_length()):
        onward = jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
        reach = stored(reach.union(reach.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))).distinct(), "reach")
        jump = stored(jump.join(onward, ["file", "to"]).select("file", "off", F.col("far").alias("to")), "jump")
    enters = chains.select("file", "block", "off").join(reach, ["file", "off"]).groupBy("file", "block").agg(F.min("off").alias("enter"))

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        following = dict(zip(group["off"], group["next"]))
        at, found = int(group["enter"].iloc[0]), []
        while at in following:
            found.append(at)
            at = following[at]
        return pd.DataFrame({"file": group["file"].iloc[0], "off": found})

    return chains.join(enters, ["file", "block"]).select("file", "block", "off", "next", "enter") \
        .groupBy("file", "block").applyInPandas(mark, "file string, off long")


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below `folder`, in any split of their files into tasks.

    (record, type, url, digest, refers, full, size, found, payload): the header's fields,
    then size and SHA-256 of the content as read; payload is null unless asked for. Lines
    that look like the start of a record inside a payload are candidates too, but the
    chain of record lengths from the start of the file never points to them, or points
    past them. A file is read until its chain breaks. A header may go over one border
    between parts. Contents that go over borders are put together from their pieces.
    An empty folder gives no records.
    """
    pieces = stored(placed(stored(scanned(spark, folder, not payloads), "pieces")), "pieces")
    known = pieces.join(reachable(pieces).withColumn("real", F.lit(True)), ["file", "off"], "left")
    known = known.withColumn("owner", F.max(F.when(F.col("real"), F.col("off"))).over(Window.partitionBy("file").orderBy("off")))
    fields = ["record", "type", "url", "digest", "refers", "full"]
    whole = known.where("real and found is not null").select(*fields, F.col("content").alias("size"), "found", F.lit(None).cast("binary").alias("payload"))
    torn = stored(known.where("owner is not null and not (coalesce(real, false) and found is not null)")
                  .select("file", "owner", "off", "size", "data", "head", "content", "real", *fields), "torn")
    # a record's last piece holds what follows it up to the next start, so sizes may be larger
    data = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", F.hex("data").alias("hex")))), lambda x: x["hex"]), "")
    own = lambda c: F.max(F.when(F.col("real"), F.col(c))).alias(c)
    parts = torn.groupBy("file", "owner").agg(
        data.alias("hex"), F.count(F.when(F.col("data").isNull(), 1)).alias("missing"), *map(own, ["head", "content", *fields]))
    parts = parts.where("content is not null")
    if not payloads and parts.where("missing > 0").limit(1).count():
        # a whole record inside the payload of one that goes over a border
        return read_warc(spark, folder, True).withColumn("payload", F.lit(None).cast("binary"))
    content = F.expr("substring(unhex(hex), cast(head + 1 as int), cast(content as int))")
    parts = parts.withColumn("payload", content).select(
        *fields, F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("found"),
        F.col("payload") if payloads else F.lit(None).cast("binary").alias("payload"))
    return whole.union(parts)


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Writes the pages as WARC below `folder`, reads them back and returns one row per page.

    (id, payload_bytes, payload_digest, record_type, refers_to, intact): size and digest
    of a response are those of the content as read, of a revisit those of its header;
    intact tells whether content and header agree.
    """
    write_warc(pages, folder, id_col, url_col, html_col, least_bytes)
    number = lambda c: F.nullif(F.regexp_extract(c, "urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")
    stated = F.substring_index("digest", ":", -1)
    again = F.col("type") == "revisit"
    return read_warc(pages.sparkSession, folder).select(
        number("record").alias(id_col), F.when(again, F.col("full")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(again, stated).otherwise(F.col("found")).alias("payload_digest"), F.col("type").alias("record_type"),
        number("refers").alias("refers_to"), (again | (F.col("found") == stated)).alias("intact"))
