"""Substring dedup by fixed-block anchors.

Every text is cut into reference blocks of ``block`` words that do not
overlap; every rolling window of ``block`` words probes them.  A repeat of
``window`` >= 2 * block - 1 words holds a whole reference block, so each
repeat has a hit.  Hits are then extended: around each one the windows of
``window`` words are compared across documents by a 96-bit hash, and the
windows that the smaller document also has, merged, are the maximal exact
repeats.

The exchanges carry packed arrays (hash, document, position), not rows per
word: a bucket is a hash range, so a common passage spreads over as many
buckets as it has words.  No pair of documents is ever made: a bucket keeps
the smallest document of each hash.

Defined results: words are runs of bytes other than space and 0x09-0x0D; a
null or empty text has none.  Rows with a null id are kept whole and are no
reference.  Rows that repeat an id are each judged by their own text, and do
not remove each other's words.  Ties cannot arise: only a strictly smaller id
counts.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import textops as X
from sitelens.llm.common import buckets, column, frees, session, slices

WINDOW, BLOCK = 50, 25
# Text that is packed together: one cell for each bucket.
PACKED_BYTES = 2 << 20
_HITS = "doc_id long, pos array<int>"
_SPANS = "doc_id long, text_key int, pos array<int>"


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _probes(window: int, block: int, n_buckets: int):
    """All rolling windows of ``block`` words, packed by bucket."""
    def run(batches):
        for part, texts in slices(batches, max_bytes=PACKED_BYTES):
            ids = _column(part, "doc_id").to_numpy()
            w = X.words(texts)
            at, text = X.fits(w.first, block)
            long_enough = np.diff(w.first) >= window
            keep = long_enough[text]
            at, text = at[keep], text[keep]
            if not len(at):
                continue
            h = X.rolling(w.hashes, block)[at]
            order, rows = X.by_bucket(X.bucket_of(h, n_buckets))
            h = h.astype(np.uint32)[order]
            doc, pos = ids[text[order]], (at - w.first[text])[order]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                "h": pa.array([h[i:j].tobytes() for _, i, j in rows], pa.binary()),
                "doc": pa.array([X.pack(doc[i:j]) for _, i, j in rows], pa.binary()),
                "pos": pa.array([X.pack(pos[i:j]) for _, i, j in rows], pa.binary())})
    return run


def _lists(doc: np.ndarray, keys: list[np.ndarray], pos: np.ndarray) -> list[np.ndarray]:
    """Order by document; the positions of each as a list."""
    order = np.lexsort((pos, *keys, doc))
    doc, pos, keys = doc[order], pos[order], [k[order] for k in keys]
    changed = doc[1:] != doc[:-1]
    for k in keys:
        changed |= k[1:] != k[:-1]
    at = X.groups(changed)
    return [doc[at], *[k[at] for k in keys], np.split(pos.astype(np.int32), at[1:])]


def _find_hits(block: int):
    """Of one bucket: probes whose hash is a reference block of another document."""
    @frees
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["h"]])
        doc = np.concatenate([X.unpack(b) for b in pdf["doc"]])
        pos = np.concatenate([X.unpack(b) for b in pdf["pos"]])
        order = np.argsort(h, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        at = X.groups(h[1:] != h[:-1])
        size = np.diff(np.append(at, len(h)))
        anchor = pos % block == 0
        least = np.repeat(np.minimum.reduceat(np.where(anchor, doc, np.iinfo(np.int64).max), at), size)
        most = np.repeat(np.maximum.reduceat(doc, at), size)
        hit = (doc > least) | (anchor & (doc < most))
        if not hit.any():
            return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "pos": pd.Series([], dtype=object)})
        doc, pos = _lists(doc[hit], [], pos[hit])
        return pd.DataFrame({"doc_id": doc, "pos": pos})
    return run


def _candidates(window: int, block: int, n_buckets: int):
    """The windows around the hits, packed by bucket."""
    def run(batches):
        for part, texts in slices(batches, max_bytes=PACKED_BYTES):
            ids, keys = _column(part, "doc_id").to_numpy(), _column(part, "text_key").to_numpy()
            w = X.words(texts)
            n = np.diff(w.first)
            hits = _column(part, "hits")
            p = hits.flatten().to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(texts)), hits.value_lengths().to_numpy())
            low, high = np.maximum(p - (window - block), 0), np.minimum(p, n[text] - window)
            ok = low <= high
            low, high = (low + w.first[text])[ok], (high + w.first[text])[ok]
            edge = np.zeros(w.first[-1] + 1, np.int32)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            at = np.flatnonzero(np.cumsum(edge) > 0)
            if not len(at):
                continue
            a, b = X.rolling(w.hashes, window, 1)[at], X.rolling(w.hashes, window, 2)[at].astype(np.uint32)
            text = np.searchsorted(w.first, at, "right") - 1
            order, rows = X.by_bucket(X.bucket_of(a, n_buckets))
            a, b, at, text = a[order], b[order], at[order], text[order]
            doc, key, pos = ids[text], keys[text], at - w.first[text]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([x for x, _, _ in rows], pa.int32()),
                "a": pa.array([a[i:j].tobytes() for _, i, j in rows], pa.binary()),
                "b": pa.array([b[i:j].tobytes() for _, i, j in rows], pa.binary()),
                "doc": pa.array([X.pack(doc[i:j]) for _, i, j in rows], pa.binary()),
                "key": pa.array([X.pack(key[i:j]) for _, i, j in rows], pa.binary()),
                "pos": pa.array([X.pack(pos[i:j]) for _, i, j in rows], pa.binary())})
    return run


@frees
def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: windows that a document with a smaller id also has."""
    a = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["a"]])
    b = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["b"]])
    doc, key, pos = (np.concatenate([X.unpack(x) for x in pdf[c]]) for c in ("doc", "key", "pos"))
    order = np.lexsort((b, a))
    a, b, doc, key, pos = a[order], b[order], doc[order], key[order], pos[order]
    at = X.groups((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    least = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(a))))
    hit = doc > least
    if not hit.any():
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "text_key": np.zeros(0, np.int32), "pos": pd.Series([], dtype=object)})
    doc, key, pos = _lists(doc[hit], [key[hit]], pos[hit])
    return pd.DataFrame({"doc_id": doc, "text_key": key.astype(np.int32), "pos": pos})


def _strip(window: int, schema: pa.Schema, untouched: bool):
    """Remove the words of the repeats; spans are word ranges [start, end)."""
    def one(text: bytes, key: int, repeats):
        found = text.split()
        start = [p for r in repeats or () if r["text_key"] == key for p in r["pos"]]
        if not start:
            return len(found), 0, [], text if untouched else b" ".join(found)
        start = np.sort(np.asarray(start, np.int64))
        last = np.append(np.flatnonzero(np.diff(start) > window), len(start) - 1)
        begin = start[np.append(0, last[:-1] + 1)]
        end = start[last] + window
        keep = np.ones(len(found), bool)
        for i, j in zip(begin, end):
            keep[i:j] = False
        return len(found), int((~keep).sum()), [{"start": int(i), "end": int(j)} for i, j in zip(begin, end)], b" ".join(compress(found, keep))

    def run(batches):
        for part, texts in slices(batches):
            rows = [one(*x) for x in zip(texts, _column(part, "text_key").to_pylist(), _column(part, "repeats").to_pylist())]
            n, removed, spans, kept = zip(*rows)
            if untouched:
                kept = [k if valid else None for k, valid in zip(kept, _column(part, "text").is_valid().to_pylist())]
            new = {"n_words": n, "n_removed": removed, "spans": spans,
                   "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [_column(part, f.name) if f.name not in new else new[f.name] if f.name == "kept_text"
                 else pa.array(new[f.name], f.type) for f in schema], schema=schema)
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW, block: int = BLOCK, carry: tuple[str, ...] = (),
                    untouched: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, spans, kept_text and
    the ``carry`` columns (as struct ``carried``).

    A word goes if one of the ``window`` consecutive words that cover it also
    start in a document with a smaller id.  kept_text: kept words joined by
    one space; with ``untouched`` a text that loses none stays as it is.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole reference block: window >= 2 * block - 1")
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = session(docs)
    n_buckets = buckets(spark)
    base = docs.select(
        column(docs, id_col, "doc_id", "bigint"), column(docs, text_col, "text", "string"),
        F.hash(F.col(text_col)).alias("text_key"),
        F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("carried"))
    known = base.where("doc_id IS NOT NULL")
    hits = (known.select("doc_id", "text")
            .mapInArrow(_probes(window, block, n_buckets), "bucket int, h binary, doc binary, pos binary")
            .groupBy("bucket").applyInPandas(_find_hits(block), _HITS)
            .groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("hits")))
    # One exchange of the texts by id serves both joins below.
    dealt = known.repartition("doc_id")
    repeats = (dealt.join(hits, "doc_id").select("doc_id", "text", "text_key", "hits")
               .mapInArrow(_candidates(window, block, n_buckets),
                           "bucket int, a binary, b binary, doc binary, key binary, pos binary")
               .groupBy("bucket").applyInPandas(_repeated, _SPANS)
               .groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "pos")).alias("repeats")))
    kind = "array<struct<text_key:int,pos:array<int>>>"
    ready = (dealt.join(repeats, "doc_id", "left")
             .unionByName(base.where("doc_id IS NULL").withColumn("repeats", F.lit(None).cast(kind))))
    out = ready.select("doc_id", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("n_removed"),
                       F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
                       F.lit(None).cast("string").alias("kept_text"), "carried").schema
    return ready.mapInArrow(_strip(window, to_arrow_schema(out), untouched), out)
