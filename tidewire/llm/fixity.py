"""WARC fixity audit with Merkle trees.

Every record is hashed; records are the leaves of a tree per file, at their offsets. A node of the lowest level covers a
range of 2 ** RANGE_BITS offsets, one above it 2 ** FANOUT_BITS nodes below, and hashes the positions and hashes of what is there.
Two replicas are compared from the roots down: only the children of nodes that differ are read at each level, and
what is left at the bottom are the corrupt, missing and extra records.

Nodes are found by shifting offsets, so no file meets in one task: a group has at most 65536 offsets at the lowest level (some
hundred records of a WARC file) and 16 nodes above.

Cases: null payloads hash like no other; records are matched by file and offset, and records at one
offset count as one made of all their hashes and how often each is there; a record without offset has a reserved place
given by its hash, so a changed one is one missing and one extra, with offset null; a null file
is the file of the empty name; a replica without records lacks all of the other's; no records give no rows; payloads of any length
are hashed whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm._shared import stored

#: log2 of the children of a node.
FANOUT_BITS = 4
#: log2 of the offset that one leaf range spans at the lowest level.
RANGE_BITS = 16


def warc_record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC resource record, as text."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            offsets, payloads, size = [], [], 0
            for offset, payload in warc_records(content.as_buffer().to_pybytes()):
                offsets.append(offset)
                payloads.append(payload)
                size += len(payload)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(offsets)), pa.array(offsets, pa.int64()), pa.array(payloads, pa.binary())], names=["file", "offset", "payload"])
                    offsets, payloads, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(payloads, pa.binary())], names=["file", "offset", "payload"])


def warc_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record with its header) of a WARC file, plain or with one gzip member for each record; a torn last record is given as it is."""
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\x1f\x8b":
            member, parts, to = zlib.decompressobj(wbits=31), [], at
            try:
                while not member.eof and to < len(content):
                    parts.append(member.decompress(content[to : to + 65536]))
                    to = min(to + 65536, len(content))
            except zlib.error:
                yield at, content[at:]
                return
            yield at, b"".join(parts)
            at = to - len(member.unused_data)
            continue
        head = content.find(b"\r\n\r\n", at)
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", content[at:head]) if head >= 0 else None
        end = head + 8 + int(length[1]) if length else len(content)
        yield at, content[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file: its name, offset, payload) of every record of the WARC files (.warc, .warc.gz) below a path; a file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    return named.mapInArrow(_parsed, "file string, offset long, payload binary")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, payload) -> file, at, hash of what is at each place; negative places are those of records without offset."""
    digest = F.when(F.col("payload").isNull(), F.sha2(F.lit("\u0000null"), 256)).otherwise(F.sha2(F.col("payload").cast("binary"), 256))
    hashed = records.select(F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.col("offset").cast("long").alias("at"), digest.alias("hash"))
    # the first 62 bits of the hash, below zero: no offset is there
    reserved = F.lit(-1) - F.shiftright(F.conv(F.substring("hash", 1, 16), 16, -10).cast("long"), 2).bitwiseAND(F.lit((1 << 62) - 1))
    each = hashed.withColumn("at", F.coalesce("at", reserved)).groupBy("file", "at", "hash").agg(F.count("*").alias("n"))
    said = F.concat(F.col("hash"), F.when(F.col("n") > 1, F.concat(F.lit("*"), F.col("n").cast("string"))).otherwise(F.lit("")))
    return each.groupBy("file", "at").agg(F.array_join(F.sort_array(F.collect_list(said)), ",").alias("hash"))


def _parents(nodes: DataFrame, bits: int) -> DataFrame:
    """Nodes (file, at, hash) -> the nodes above them, each over 2 ** bits positions."""
    child = F.struct("at", "hash")
    above = nodes.groupBy("file", F.shiftright("at", bits).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    said = F.array_join(F.transform("c", lambda x: F.concat(x.at.cast("string"), F.lit("="), x.hash)), ";")
    return above.select("file", F.col("up").alias("at"), F.sha2(said, 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of a Merkle tree per file, records first, the files' roots last."""
    level = stored(leaves(records))
    levels = [level]
    top = level.agg(F.max("at")).first()[0] or 0
    bits, reach = RANGE_BITS, 0
    while top >> reach or len(levels) == 1:
        level = stored(_parents(level, bits))
        levels.append(level)
        reach += bits
        bits = FANOUT_BITS
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Where two trees differ: file, offset, status (changed, missing or extra in the second).

    Trees of unequal height are compared from the lower one's roots; the taller one has a range there
    that the other lacks, which a file's differing root shows.
    """
    depth = min(len(ours), len(theirs))
    open_ = None
    for level in reversed(range(depth)):
        a, b = ours[level], theirs[level].select("file", "at", F.col("hash").alias("other"))
        if open_ is not None:
            bits = RANGE_BITS if level == 0 else FANOUT_BITS
            a, b = (x.withColumn("up", F.shiftright("at", bits)).join(open_, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        differ = a.join(b, ["file", "at"], "full").where(~F.col("hash").eqNullSafe(F.col("other")))
        open_ = stored(differ.select("file", F.col("at").alias("up")) if level else differ)
    status = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return open_.select("file", F.when(F.col("at") >= 0, F.col("at")).alias("offset"), status.alias("status"))
