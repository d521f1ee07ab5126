"""WARC archives and a Merkle audit of their replicas.

A record's digest is the SHA-256 of its bytes.  Records are grouped by fixed offset
ranges of their archive, ranges by sixteens, and so on; a node's digest covers its
children in order, so two equal roots mean two equal archives.  The audit compares roots
and descends only below nodes that differ, down to the records at fault.  Everything is
DataFrame aggregation and joins; a group never holds more than one range of records or
sixteen nodes.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import scratch

RANGE_BYTES, FANOUT = 1 << 20, 16
#: Archives of the pages without an id.
NAMELESS = 4096
CRLF = "\r\n"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.0 response record; a null url or html is empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head, body, F.lit(CRLF + CRLF)).cast("binary")


def archive(pages: DataFrame, per_archive: int = 1024, keep: tuple[str, ...] = ("page_id", "url", "html"), **computed: Column) -> DataFrame:
    """archive, byte_offset, n_bytes, the ``keep`` and ``computed`` columns: pages laid out as WARC archives.

    An archive holds the pages of ``per_archive`` consecutive ids, in order of id, then
    url and the body's SHA-256; equal pages stand beside each other.  Pages without an id
    are dealt by their body's digest to NAMELESS archives with negative numbers.  What is
    ``computed`` is so before pages move, so digests travel instead of bodies unless html
    is kept.
    """
    body = F.sha2(F.coalesce("html", F.lit("")), 256)
    size = F.octet_length(record_bytes(F.col("page_id"), F.col("url"), F.col("html"))).cast("long")
    number = F.coalesce(F.floor(F.col("page_id") / per_archive), -1 - F.conv(F.substring("_body", 1, 8), 16, 10).cast("long") % NAMELESS).cast("long")
    rows = pages.select("page_id", "url", "html", size.alias("n_bytes"), body.alias("_body"), *(c.alias(n) for n, c in computed.items()))
    rows = rows.select(number.alias("archive"), "n_bytes", "_body", F.col("page_id").alias("_id"), F.col("url").alias("_url"), *keep, *computed)
    before = Window.partitionBy("archive").orderBy("_id", "_url", "_body").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("archive", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).cast("long").alias("byte_offset"), "n_bytes", *keep, *computed)


def parse(stream: BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes, str]]:
    """(offset, length, headers, body, SHA-256) of each record of a WARC stream, one record in memory at a time.

    Records begin at lines that begin with WARC/; other lines between them are skipped.
    """
    at = 0
    while line := stream.readline(1 << 16):
        begin, at = at, at + len(line)
        if not line.startswith(b"WARC/"):
            continue
        digest, headers = hashlib.sha256(line), {}
        while line := stream.readline(1 << 16):
            at += len(line)
            digest.update(line)
            if not line.strip():
                break
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        number = re.fullmatch(r"\d+", headers.get("content-length", ""))
        body = stream.read(int(number[0])) if number else b""
        end = stream.read(4)
        digest.update(body + end)
        at += len(body) + len(end)
        yield begin, at - begin, headers, body, digest.hexdigest()


def read(spark: SparkSession, path: str) -> DataFrame:
    """archive (file name), byte_offset, n_bytes, url, body, digest of the records below ``path``.

    Files are plain or gzipped, offsets those of the plain bytes.  A task holds a file as
    stored (2 GB at most) and one unpacked record.  A record is cut off where its file ends.
    """
    scratch.on_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                stored = io.BufferedReader(pa.BufferReader(raw))
                for at, size, headers, body, digest in parse(gzip.open(stored) if raw[:2].to_pybytes() == b"\x1f\x8b" else stored):
                    yield pa.RecordBatch.from_pydict({
                        "archive": [name], "byte_offset": pa.array([at], pa.int64()), "n_bytes": pa.array([size], pa.int64()),
                        "url": pa.array([headers.get("warc-target-uri")], pa.string()), "body": pa.array([body], pa.binary()), "digest": [digest],
                    })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, byte_offset long, n_bytes long, url string, body binary, digest string")


def leaves(records: DataFrame, digest: Column) -> DataFrame:
    """archive, byte_offset, n_bytes, digest of each record."""
    return records.select("archive", "byte_offset", "n_bytes", digest.alias("digest"))


def _above(nodes: DataFrame, node: Column, order: str, label: Column) -> DataFrame:
    """One level up: the digest of each node's children in order."""
    grouped = nodes.withColumn("parent", node).groupBy("archive", "parent").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("d")))).alias("c"))
    return grouped.select("archive", F.col("parent").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: x["d"]), "\n"), 256).alias("digest"))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Levels of the tree from ranges (first) to one root per archive (last)."""
    own = F.concat_ws(" ", "byte_offset", "n_bytes", "digest")
    levels = [_above(records, F.floor(F.col("byte_offset") / RANGE_BYTES), "byte_offset", own)]
    for _ in range(height):
        levels.append(_above(levels[-1], F.floor(F.col("node") / FANOUT), "node", F.concat_ws(" ", "node", "digest")))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("digest", "da").join(b.withColumnRenamed("digest", "db"), ["archive", "node"], "full")
    return both.where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "node")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """archive, byte_offset, n_bytes, state, digest_a, digest_b of the records at fault.

    ``first`` and ``second`` hold archive, byte_offset, n_bytes, digest of two replicas.
    ``state`` is changed (other bytes at that offset), missing (only in ``first``) or
    extra (only in ``second``); ``n_bytes`` is of ``first`` where there.  Records repeated
    at one offset are compared as the sorted list of their digests.  Rows with a null
    archive or offset take no part.  Equal replicas, and two empty ones, give no rows.
    """
    whole = lambda df: scratch.write(df.where("archive is not null and byte_offset is not null").groupBy("archive", "byte_offset").agg(F.max("n_bytes").alias("n_bytes"), F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("digest")), "leaves")
    a, b = whole(first), whole(second)
    last = max(df.agg(F.max("byte_offset")).first()[0] or 0 for df in (a, b)) // RANGE_BYTES
    height = 0
    while FANOUT**height <= last:
        height += 1
    above, below = tree(a, height), tree(b, height)
    bad = _differing(above[-1], below[-1])
    for level in range(height - 1, -1, -1):
        under = lambda df: df.withColumn("up", F.floor(F.col("node") / FANOUT)).join(bad.withColumnRenamed("node", "up"), ["archive", "up"], "left_semi").drop("up")  # noqa: B023, E731
        bad = _differing(under(above[level]), under(below[level]))
    bad = scratch.write(bad, "differing")
    near = lambda df, s: df.withColumn("node", F.floor(F.col("byte_offset") / RANGE_BYTES)).join(bad, ["archive", "node"], "left_semi").select("archive", "byte_offset", F.col("n_bytes").alias(f"n_{s}"), F.col("digest").alias(f"digest_{s}"))
    both = near(a, "a").join(near(b, "b"), ["archive", "byte_offset"], "full").where("not (digest_a <=> digest_b)")
    state = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return both.select("archive", "byte_offset", F.coalesce("n_a", "n_b").alias("n_bytes"), state.alias("state"), "digest_a", "digest_b")
