"""Ordered scans over sampled ranges: prefix sums, the last value before a
row, and threshold chains.

``ranges`` deals rows by (key, order) into ranges of about equal size, with
splitters that Spark samples (``repartitionByRange``): a key with a third of
all rows fills a third of the ranges, however its values lie.  The dealt rows
are kept in the checkpoint folder, so that a range holds the same rows in every
branch that reads it.

``prefix_sums`` and ``last_before`` work inside each (range, key) and carry one
row a range over the ranges of a key.

``chain`` folds a key's rows in order with one number as state, a threshold: a
row starts a new run if it must, or if it can and its ``x`` exceeds the
threshold, which it then sets to its ``limit``; a clearing row takes the
threshold away.  Each (range, key) is reduced to a transition function
"threshold in -> threshold out": the successors of its possible first starts
are contracted inside the range, and after the first row that must start or
clears, the outcome is the same for all.  One streaming walk over a key's
functions in range order tells each range what comes in (the walk keeps one
threshold and reads, of each range, only rows that can be its first start: up
to the first forced row, and no further than the threshold of its first row);
then each range marks its own rows.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def ranges(df: DataFrame, key: str, order: list[Column], n: int | None = None) -> DataFrame:
    """``df`` with ``_range``: n ranges (the session's shuffle partitions) in
    the order of (key, order)."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, F.col(key), *order).withColumn(RANGE, F.spark_partition_id()).checkpoint(eager=True)


def prefix_sums(df: DataFrame, key: str, order: list[Column], values: Mapping[str, Column], n: int | None = None,
                keep_range: bool = False) -> DataFrame:
    """Inclusive running sums ``values`` (name -> value) per ``key`` in ``order``."""
    dealt = ranges(df, key, order, n)
    inside = Window.partitionBy(key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, RANGE).agg(*[F.sum(v).alias(f"_all_{name}") for name, v in values.items()])
    carry = totals.select(key, RANGE, *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_carry_{name}") for name in values])
    out = dealt.withColumns({name: F.sum(v).over(inside) for name, v in values.items()}).join(carry, [key, RANGE])
    kept = [*df.columns, RANGE] if keep_range else df.columns
    return out.select(*kept, *[(F.col(name) + F.col(f"_carry_{name}")).alias(name) for name in values])


def last_before(df: DataFrame, key: str, order: list[str], value: Column, out: str, n: int | None = None) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` of the rows of its key
    that come strictly before each row."""
    dealt = ranges(df.withColumn("_value", value), key, [F.col(c) for c in order], n)
    inside = Window.partitionBy(key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.where("_value IS NOT NULL").groupBy(key, RANGE).agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    # Ranges without a value carry on what came before them.
    carry = (dealt.select(key, RANGE).distinct().join(ends, [key, RANGE], "left")
             .select(key, RANGE, F.last("_end", ignorenulls=True).over(before).alias("_carry")))
    return (dealt.withColumn("_in", F.last("_value", ignorenulls=True).over(inside)).join(carry, [key, RANGE])
            .select(*df.columns, F.coalesce("_in", "_carry").alias(out)))


NONE, END = -(1 << 63), (1 << 63) - 1
_FLAGS = ("x", "limit", "can", "must", "clear")


def _columns(rows: pa.Table, order: list[str]) -> tuple[pa.Table, list[np.ndarray]]:
    rows = rows.sort_by([(c, "ascending") for c in order])
    return rows, [rows[f"_{c}"].to_numpy() for c in _FLAGS]


def _successors(x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending x of rows that can start: the last start of the chain from
    each row and the number of starts after it."""
    n = len(x)
    nxt = np.maximum(np.searchsorted(x, limit, "right"), np.arange(1, n + 1))
    last = np.where(nxt < n, nxt, np.arange(n))
    more = (nxt < n).astype(np.int64)
    while True:
        far = last[last]
        if (far == last).all():
            return last, more
        more, last = more + more[last], far


def _fold(x, limit, can, must, clear, at: int) -> list[tuple[int, int, int]]:
    """(row, threshold from it on, whether it starts a run) of every change."""
    starts = np.flatnonzero(can & ~must)
    where, values = starts.tolist(), x[starts].tolist()
    resets = np.flatnonzero(must | clear).tolist()
    out, i, r, n = [], 0, 0, len(x)
    while True:
        k = max(bisect_right(values, at), bisect_left(where, i))
        row = min(where[k] if k < len(where) else n, resets[r] if r < len(resets) else n)
        if row == n:
            return out
        r += r < len(resets) and resets[r] == row
        at = NONE if clear[row] else int(limit[row])
        out.append((row, at, int(not clear[row])))
        i = row + 1


def _border(order: list[str]):
    def run(key, rows):
        _, (x, limit, can, must, clear) = _columns(rows, order)
        reset = np.flatnonzero(must | clear)
        end = int(reset[0]) if len(reset) else len(x)
        after = _fold(*(c[end:] for c in (x, limit, can, must, clear)), END)
        tail = sum(s for _, _, s in after)
        pre = np.flatnonzero(can[:end])
        px, pl = x[pre], limit[pre]
        last, more = _successors(px, pl)
        # No threshold that comes in exceeds the first row's own.
        m = min(len(px), 1 + int(np.searchsorted(px[:-1], limit[0], "right")))
        out = np.full(m, after[-1][1], np.int64) if after else pl[last[:m]]
        n = m + 1
        return pa.table([
            pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array([*px[:m].tolist(), END], pa.int64()),
            pa.array([*out.tolist(), after[-1][1] if after else None], pa.int64()), pa.array([*(more[:m] + 1 + tail).tolist(), tail], pa.int64())],
            ["key", RANGE, "x", "limit", "starts"])
    return run


def _walk(batches):
    """(key, range, threshold that enters, starts before) from border rows
    sorted by key, range and x; one threshold is held."""
    key = where = None
    at, parts, entered = NONE, 0, True
    for batch in batches:
        keys = batch.column(0).dictionary_encode()
        code, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
        spot, x, limit, starts = (batch.column(i) for i in range(1, 5))
        spot, x, starts = spot.to_numpy(), x.to_numpy(), starts.to_numpy()
        edges = (np.flatnonzero((code[1:] != code[:-1]) | (spot[1:] != spot[:-1])) + 1).tolist()
        out = []
        for a, b in zip([0, *edges], [*edges, len(x)]):
            if a == b:
                continue
            if names[code[a]] != key:
                key, where, at, parts = names[code[a]], None, NONE, 0
            if spot[a] != where:
                where, entered = spot[a], False
                out.append((key, int(where), at, parts))
            j = a + int(np.searchsorted(x[a:b], at, "right"))
            if not entered and j < b:
                entered, parts = True, parts + int(starts[j])
                at = limit[j].as_py() if limit[j].is_valid else at
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                         ["_key", RANGE, "enters", "before"])


def _mark(order: list[str]):
    def run(key, rows, entry):
        rows, flags = _columns(rows, order)
        at, part, n = entry["enters"][0].as_py(), entry["before"][0].as_py(), rows.num_rows
        found = _fold(*flags, at)
        start = np.zeros(n, np.int64)
        start[[r for r, _, _ in found]] = [s for _, _, s in found]
        # The threshold before a row: that of the last change above it.
        edge = [0, *[r + 1 for r, _, _ in found], n]
        enters = np.repeat(np.array([at, *[a for _, a, _ in found]], np.int64), np.diff(edge))
        return (rows.drop_columns(["_key", RANGE, *[f"_{c}" for c in _FLAGS]])
                .append_column("part", pa.array(np.cumsum(start) + part)).append_column("enters", pa.array(enters)))
    return run


def chain(df: DataFrame, key: str, order: list[str], x: Column, limit: Column, can: Column | None = None,
          must: Column | None = None, clear: Column | None = None) -> DataFrame:
    """``df`` (with ``_range``, of ``ranges`` or ``prefix_sums``) with ``part``,
    the number of starts up to each row, and ``enters``, the threshold in force
    before it (null: none).

    ``x`` and ``limit`` do not fall along the order (columns of ``df``,
    ascending).  ``can`` defaults to true, ``must`` and ``clear`` to false; a
    null flag is false.  Keys are not null.
    """
    flag = lambda c, default: F.lit(default) if c is None else F.coalesce(c, F.lit(False))
    must, clear = flag(must, False), flag(clear, False)
    rows = df.withColumns({"_key": F.col(key), "_x": x.cast("long"), "_limit": limit.cast("long"), "_can": flag(can, True) & ~clear,
                           "_must": must & ~clear, "_clear": clear})
    by = rows.groupBy("_key", RANGE)
    border = by.applyInArrow(_border(order), f"key string, {RANGE} int, x long, limit long, starts long")
    walked = (border.repartition("key").sortWithinPartitions("key", RANGE, "x")
              .mapInArrow(_walk, f"_key string, {RANGE} int, enters long, before long"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != RANGE)
    marked = by.cogroup(walked.groupBy("_key", RANGE)).applyInArrow(_mark(order), f"{kept}, part long, enters long")
    return marked.withColumn("enters", F.when(F.col("enters") > NONE, F.col("enters")))


# The functions travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
