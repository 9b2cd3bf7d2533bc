"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

A reading task looks for every occurrence of the record magic, inside payloads too, and emits the candidates' offsets with the
offset of their successor as their length header gives it. Pointer jumping from the start of each file then marks the offsets
that are reached: each round doubles the reach, so it takes as many rounds as the number of records has binary digits. A magic
inside a payload isn't reached and goes.

Records are written by Spark's text writer whose line end is the end of a record, so archives go to any store that Spark
writes. A file holds ``records_per_file`` records at most.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.sources.staging import settle, stage_root

MAGIC = b"WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
RECORDS_PER_FILE = 4000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # of base32


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: each 5 hex digits are 4 letters."""
    hexed = F.sha1(payload)
    group = [F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(_ALPHABET), F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in group for s in (15, 10, 5, 0)])


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads of at least so many bytes the smallest page_id is the response.

    A page without an id refers to the response if there is one. Repeated rows of the response are responses too.
    """
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    groups = keyed.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Payloads that occur once need no partner, so the table is as small as copies are rare, and its size is known.
    out = keyed.join(settle(groups.where("n > 1").drop("n"), "copied-payloads"), "digest", "left")
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\r\n"))).otherwise(F.lit(""))


def record_text(payload: str = "payload") -> Column:
    """A whole record without the end mark. A revisit has no block; the payload's digest and length are in its header."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col(payload))
    return F.concat(
        F.lit(MAGIC.decode()),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.format_string("<urn:page:%s>", F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col(payload)))),
        _header("X-Payload-Length", F.octet_length(payload).cast("string")),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write page_id, url, payload, refers_to as archives. An empty table gives archives without records."""
    text = records.select(record_text().alias("value"))
    text.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path)


_MAGIC = re.compile(re.escape(MAGIC))
_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]{1,18})\r\n", re.I)

CANDIDATES = "file string, at long, successor long, file_bytes long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_holds boolean"


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


def _head(content: bytes, at: int, end: int) -> dict[str, tuple[str, int]]:
    """Header lines by lower-case name: the last value, and where its line begins."""
    head = {}
    for line in content[at:end].split(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.lower()] = value.strip(), at
        at += len(line) + 2
    return head


def candidates(content: bytes) -> Iterator[dict]:
    """Every place that looks like a record, with the offset that its length leads to; cut-off records are left out.

    A header is as long as it is. Magics before the same blank line share it, its header lines and its block, so that a content
    full of magics is still read once.
    """
    end, size, head, hashed, own = -1, None, None, None, ""
    for m in _MAGIC.finditer(content):
        at = m.start()
        if end < at:
            end = content.find(b"\r\n\r\n", at)
            if end < 0:
                return
            size, head = _LENGTH.search(content, at, end + 2), None
        elif size is not None and size.start() < at:
            size = _LENGTH.search(content, at, end + 2)
        if size is None:
            continue
        body = end + 4
        successor = body + int(size[1]) + len(RECORD_END)
        if successor > len(content) or content[successor - 4 : successor] != RECORD_END.encode():
            continue
        start = at + len(MAGIC)
        if head is None:
            head = _head(content, start, end)
        field = lambda name: v[0] if (v := head.get(name)) and v[1] >= start else None  # noqa: B023, E731
        if hashed != (body, successor):
            hashed, own = (body, successor), base64.b32encode(hashlib.sha1(memoryview(content)[body : successor - 4]).digest()).decode()
        claimed = (field("warc-payload-digest") or "").removeprefix("sha1:")
        kind = field("warc-type") or ""
        length = field("x-payload-length") or ""
        yield {
            "at": at,
            "successor": successor,
            "page_id": _page(field("warc-record-id")),
            "url": field("warc-target-uri"),
            "record_type": kind,
            "refers_to": _page(field("warc-refers-to")),
            "payload_bytes": int(length) if kind == "revisit" and length.isdigit() else successor - 4 - body,
            "payload_digest": claimed if kind == "revisit" else own,
            "digest_holds": kind == "revisit" or not claimed or claimed == own,
        }


def reached(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which offsets the chain from offset 0 visits, by pointer jumping. ``at`` is sorted; the chain ends where it finds none."""
    n = len(at)
    place = np.searchsorted(at, successor)
    hop = np.where((place < n) & (at[np.minimum(place, n - 1)] == successor), place, n) if n else np.zeros(0, np.int64)
    hop = np.append(hop, n)  # n: nowhere
    mark = np.zeros(n + 1, bool)
    if n and at[0] == 0:
        mark[0] = True
    while True:
        before = mark.sum()
        mark[hop[mark]] = True
        mark[n] = False
        if mark.sum() == before:
            return mark[:n]
        hop = hop[hop]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: file, at, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, digest_holds (a response's digest header, if any, is that of its payload).

    Offsets and sizes are bytes. Reading ends at the first place of a file where no whole record follows. Files are read whole,
    up to 2 GB each.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in CANDIDATES.split(", ")]

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                found = [{"file": file, "file_bytes": len(content), **c} for c in candidates(bytes(content))]
                if found:
                    yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        return group[reached(group["at"].to_numpy(), group["successor"].to_numpy())]

    # A group is one file's candidates: bounded by the size of a file.
    chain = files.mapInPandas(emitted, CANDIDATES).groupBy("file").applyInPandas(chained, CANDIDATES)
    return chain.select("file", "at", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_holds")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared stage folder and read them back: one row per page.

    Null html is an empty payload, null url no header, null page_id an empty record id. Repeated rows give a record each, other
    columns are ignored, an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{stage_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(with_revisits(pages, min_revisit_bytes), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
