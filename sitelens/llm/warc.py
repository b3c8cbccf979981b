"""Merkle fixity audit of WARC replicas.

Records are hashed where they are read; only (file, offset, length, digest)
travels.  In each file the records that start in one range of ``RANGE`` bytes
form a leaf range, ``FANOUT`` ranges form the next node, and so on up to the
file's root; files hang under a 16-bit key of their name, keys under nodes of
``NAMES``, and these under the root.  Ranges are cut by offset, not by count, so the trees of two
replicas line up even where one lacks a record.

The audit compares the two roots and descends: at each level only the
children of nodes that differ are compared, first across files by joins, then
down the levels of each file.  The leaf ranges of both replicas are
checkpointed, so records are read and hashed once: equal replicas end at their
roots, and a few bad records open a few ranges.

Defined results: a record that one replica lacks is ``missing`` or ``extra``;
one that differs is ``corrupt``.  Rows with a null file or offset have no
place in a tree and are left out by ``leaves``; a null record counts as empty.  Repeated
rows (same file and offset) are one place that holds several records; the
place is ``corrupt`` if the two replicas' lists differ.  Columns other than those
named are not read, whatever their names.  An empty replica lacks every record.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelens.llm.common import cut, session

RANGE, FANOUT, FILE_LEVELS, NAMES = 1 << 18, 16, 4, 256
PLACE = ["file", "offset"]
FOUND = "file string, offset long, kind string, length_a long, length_b long, digest_a string, digest_b string"


def record(uri: Column, payload: Column) -> Column:
    """One WARC record as text (nulls: empty)."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def place(records: DataFrame, file: str = "file", order: str = "record_id") -> DataFrame:
    """``records`` (file, record_id, length, digest) with each one's offset,
    as if written one after the other.  A file is bounded by its writer."""
    upto = F.sum("length").over(W.partitionBy(file).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return records.withColumn("offset", upto - F.col("length"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record) of uncompressed WARC files on any storage."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    session(files)

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, rows = 0, []
                while (head := raw.find(b"\r\n\r\n", at)) >= 0:
                    size = 0
                    for line in raw[at:head].split(b"\r\n"):
                        key, _, value = line.partition(b":")
                        if key.strip().lower() == b"content-length" and value.strip().isdigit():
                            size = int(value)
                    end = min(head + 4 + size + 4, len(raw))
                    rows.append((at, raw[at:end]))
                    at = end
                if at < len(raw):
                    rows.append((at, raw[at:]))  # a torn tail is a record as well
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "file": [name] * len(rows), "offset": pa.array([r[0] for r in rows], pa.int64()),
                        "record": pa.array([r[1] for r in rows], pa.binary())})

    return files.mapInArrow(run, "file string, offset long, record binary")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, digest) of records (file, offset, record)."""
    body = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    return records.where("file IS NOT NULL AND offset IS NOT NULL").select(
        F.col("file").cast("string").alias("file"), F.col("offset").cast("long").alias("offset"),
        F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"))


def _hash(nodes: Column) -> Column:
    """Hash of a node over its ordered children."""
    return F.sha2(F.to_json(nodes), 256)


def ranges(found: DataFrame) -> DataFrame:
    """(file, node, hash, places): each leaf range with what starts in it, in
    order.  ``found`` is as ``leaves`` gives it; a range is bounded in bytes."""
    return (found.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node"))
            .agg(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))).alias("places"))
            .withColumn("hash", _hash(F.col("places"))))


def file_levels(leaf_ranges: DataFrame) -> list[DataFrame]:
    """(file, node, hash) of the leaf ranges, of the levels above them, and of
    the files (node 0): every node is hashed over its children alone."""
    listed = F.array_sort(F.collect_list(F.struct("node", "hash")))
    out = [cut(leaf_ranges.select("file", "node", "hash"))]
    for k in range(FILE_LEVELS):
        up = F.floor(F.col("node") / FANOUT) if k + 1 < FILE_LEVELS else F.lit(0).cast("long")
        out.append(out[-1].groupBy("file", up.alias("up")).agg(_hash(listed).alias("hash"))
                   .select("file", F.col("up").alias("node"), "hash"))
    return out


def name_levels(files: DataFrame) -> list[DataFrame]:
    """(node, hash) above the files: by name key, by NAMES keys, root."""
    key = F.pmod(F.xxhash64("file"), F.lit(NAMES ** 2)).cast("long")
    levels = [files.groupBy(key.alias("node")).agg(_hash(F.array_sort(F.collect_list(F.struct("file", "hash")))).alias("hash"))]
    for _ in range(2):
        listed = F.array_sort(F.collect_list(F.struct("node", "hash")))
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / NAMES).alias("up")).agg(_hash(listed).alias("hash"))
                      .select(F.col("up").alias("node"), "hash"))
    return levels


def _differ(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    x, y = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return x.join(y, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Where two replicas, as ``leaves`` gives them, differ: file, offset,
    kind, length_a, length_b, digest_a, digest_b (lists joined by a comma
    where a place holds several records).

    Each replica is read once, for its leaf ranges; these are kept, and only
    the differing ones are opened again."""
    kept = [cut(ranges(x)) for x in (one, other)]
    levels = [file_levels(x) for x in kept]
    names = [[cut(x) for x in name_levels(t[-1])] for t in levels]
    bad = None
    for x, y in zip(*(reversed(t) for t in names)):
        if bad is not None:
            up = bad.withColumnRenamed("node", "up")
            x, y = (t.join(up, F.floor(t["node"] / NAMES) == up["up"], "left_semi") for t in (x, y))
        bad = cut(_differ(x, y, ["node"], "hash"))
        if bad.isEmpty():
            return one.sparkSession.createDataFrame([], FOUND)
    # Files under differing names, then down each file's levels.
    under = bad.withColumnRenamed("node", "name")
    key = F.pmod(F.xxhash64("file"), F.lit(NAMES ** 2)).cast("long")
    inside = [t[-1].join(under, key == under["name"], "left_semi") for t in levels]
    bad = cut(_differ(*inside, ["file", "node"], "hash"))
    for k in reversed(range(FILE_LEVELS)):
        up = F.floor(F.col("node") / FANOUT) if k + 1 < FILE_LEVELS else F.lit(0).cast("long")
        above = bad.withColumnRenamed("node", "up")
        inside = [t[k].withColumn("up", up).join(above, ["file", "up"], "left_semi") for t in levels]
        bad = cut(_differ(*inside, ["file", "node"], "hash"))

    def records(x, suffix):
        listed = F.array_sort(F.collect_list(F.struct("length", "digest")))
        return (x.join(bad, ["file", "node"], "left_semi").select("file", F.explode("places").alias("p")).select("file", "p.*")
                .groupBy(*PLACE).agg(F.sum("length").alias(f"length_{suffix}"), listed.alias("all"))
                .select(*PLACE, f"length_{suffix}", F.array_join(F.col("all.digest"), ",").alias(f"digest_{suffix}")))

    both = records(kept[0], "a").join(records(kept[1], "b"), PLACE, "full")
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select(
        *PLACE, kind.alias("kind"), "length_a", "length_b", "digest_a", "digest_b")
