"""Uniform shuffle into shards of exact sizes by a communication matrix.

Rows are dealt into source partitions by a seeded hash.  How many rows go from
each partition to each shard is drawn from the multivariate hypergeometric
law that a uniform shuffle follows, so every shard gets exactly its size.
Then each partition permutes its rows and cuts them by its row of the matrix,
the rows are exchanged, and each shard permutes what it has got, in blocks of
a second hash, into gapless slots.

Only DataFrame operations touch the rows.  The driver sees the partitions'
row counts and the matrix, ``MOST_PARTITIONS`` times the shards at most; the
frame made of it is therefore small enough to broadcast by construction.

Defined results: null ids and texts are rows like any others, empty input
gives no rows.  Rows that agree in all key columns are interchangeable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOST_PARTITIONS = 4096
ROWS_PER_PARTITION = 20_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without return, by inversion of the law over
    12 standard deviations around its mode; of any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    n = good + bad
    sd = (draws * (good / n) * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    x = np.arange(max(low, mode - int(12 * sd) - 20), min(high, mode + int(12 * sd) + 20) + 1, dtype=np.float64)
    step = np.log((good - x[:-1]) / (x[:-1] + 1)) + np.log((draws - x[:-1]) / (bad - draws + x[:-1] + 1))
    law = np.concatenate(([0.0], np.cumsum(step)))
    law = np.cumsum(np.exp(law - law.max()))
    return int(x[min(np.searchsorted(law, rng.random() * law[-1], "right"), len(x) - 1)])


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard: row sums ``counts``, column sums ``sizes``."""
    rng, room, out = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for s, r in enumerate(room):
            rest -= r
            x = hypergeometric(rng, r, rest, left)
            row.append(x)
            left -= x
        room = [r - x for r, x in zip(room, row)]
        out.append(row)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def uniform_shards(rows: DataFrame, keys: list[Column], shards: int = 8, seed: int = 20240607) -> DataFrame:
    """``rows`` with shard (0 to shards - 1) and slot (gapless from 0 in it).

    ``keys`` identify a row; they alone, with the seed, decide its place.
    Columns named shard or slot are replaced.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    body = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    base = rows.select(body, F.xxhash64(F.lit(seed), *keys).alias("order1"), F.xxhash64(F.lit(seed + 1), *keys).alias("order2"))
    total = rows.count()
    parts = min(MOST_PARTITIONS, max(8, -(-total // ROWS_PER_PARTITION)))
    base = base.withColumn("part", F.pmod(F.xxhash64("order1"), F.lit(parts)).cast("int"))
    counts = dict(base.groupBy("part").count().collect())
    counts = [counts.get(p, 0) for p in range(parts)]
    drawn = matrix(counts, shard_sizes(sum(counts), shards), seed)
    cells = spark.createDataFrame([(p, np.cumsum(r).tolist()) for p, r in enumerate(drawn)], "part int, upto array<long>")
    # Permute locally and cut by the matrix.
    rank = F.row_number().over(W.partitionBy("part").orderBy("order1", "order2"))
    sent = (base.withColumn("rank", rank.cast("long")).join(F.broadcast(cells), "part")
            .withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank")))))
    # Exchange, and permute again in blocks.
    blocks = max(1, parts // shards)
    got = sent.select("row", "shard", "order2", "order1", F.pmod(F.xxhash64("order2"), F.lit(blocks)).cast("int").alias("block"))
    size = got.groupBy("shard", "block").count()
    before = size.select("shard", "block", (F.sum("count").over(W.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"))
    place = F.row_number().over(W.partitionBy("shard", "block").orderBy("order2", "order1"))
    return (got.withColumn("place", place.cast("long")).join(F.broadcast(before), ["shard", "block"])
            .select("row.*", "shard", (F.col("before") + F.col("place") - 1).alias("slot")))
