"""Exact dedup that splits heavy hitters from the rest.

Texts are equal when identical after each run of space and 0x09-0x0D becomes
one space; a text stands for its SHA-256.  Digests are taken in one pass over
the texts and kept as a small table.  Every partition folds its digests into a
Misra-Gries summary of ``COUNTERS`` counters; the summaries, added up, hold
every digest with more than rows / ``HEAVY`` rows.  Candidates are counted
exactly and the verified ones, with their winner, are broadcast: their rows are
marked where they lie.  All other digests are rare by proof and go through one
ordinary exchange.

Bounds: a counter never exceeds the true count and is short of it by at most
rows / (COUNTERS + 1), so candidates are fewer than HEAVY / (1 - HEAVY /
(COUNTERS + 1)) rows of 60 bytes, whatever the input; a digest in the exchange
has at most rows / HEAVY rows.

Defined results: a null text counts as empty.  The row with the smallest id
stays, null ids come last; of several such rows exactly one, whichever.
``keep_id`` is null where all ids of a group are.  Blanks at the ends count
(one space).  An empty table gives an empty result.  Other columns play no
part; those to carry travel as one struct, so no name clashes.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import column, cut, session

HEAVY, COUNTERS = 1024, 4096
BLANKS = r"[ \t\n\x0B\f\r]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, digest, carried), one row a document, kept in the shared folder."""
    carried = F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])
    return cut(docs.select(
        F.monotonically_increasing_id().alias("row"), column(docs, id_col, "doc_id", "bigint"),
        F.unhex(F.sha2(normalised(F.col(f"`{text_col}`").cast("string")), 256)).alias("digest"), carried.alias("carried")))


def fold(summary: Counter, more: Counter, counters: int) -> Counter:
    """Misra-Gries merge: add up, then take the first counter beyond the room
    from all; a counter's loss stays within rows / (counters + 1)."""
    summary.update(more)
    if len(summary) > counters:
        beyond = sorted(summary.values(), reverse=True)[counters]
        summary = Counter({k: n - beyond for k, n in summary.items() if n > beyond})
    return summary


def _summarise(counters: int):
    def run(batches):
        summary = Counter()
        for batch in batches:
            summary = fold(summary, Counter(batch.column(0).to_pylist()), counters)
        if summary:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(summary), pa.binary()), pa.array(list(summary.values()), pa.int64())], ["digest", "least"])
    return run


def heavy_hitters(rows: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """(digest, group_size, first) of every digest with more than 1 / ``heavy``
    of ``rows``: exact counts, and the exact smallest (no id, doc_id, row)."""
    if counters < 2 * heavy:
        raise ValueError("counters must be twice the heavy hitters at least")
    session(rows)
    total = rows.count()
    least = total / heavy
    candidates = (rows.select("digest").mapInArrow(_summarise(counters), "digest binary, least long")
                  .groupBy("digest").agg(F.sum("least").alias("least"))
                  .where(F.col("least") > least - total / (counters + 1)).select("digest"))
    return (rows.join(F.broadcast(candidates), "digest").groupBy("digest")
            .agg(*[c.alias(name) for name, c in _size_and_first()]).where(F.col("group_size") > least))


def _size_and_first() -> list[tuple[str, Column]]:
    """Aggregates of a group: its rows and its first (no id, doc_id, row)."""
    return [("group_size", F.count("*")), ("first", F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")))]


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
         heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, carried) of every row."""
    rows = digests(docs, id_col, text_col, carry)
    winners = cut(heavy_hitters(rows, heavy, counters))
    same = Window.partitionBy("digest")
    hot = rows.join(F.broadcast(winners), "digest")
    rest = (rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
            .withColumns({name: c.over(same) for name, c in _size_and_first()}))
    return hot.unionByName(rest).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "digest", "carried")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return mark(docs, id_col, text_col, tuple(docs.columns)).where("kept").select("carried.*")
