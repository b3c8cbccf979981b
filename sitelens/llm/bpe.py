"""Byte-level BPE encoding and decoding in overlapping chunks.

A text is cut into chunks of ``step`` characters that overlap the next one.
Every chunk is pre-tokenised by itself, in parallel, from wherever it starts.
A piece depends only on where it starts and on the text after it, so as soon
as the pieces of two overlapping chunks share one border, they agree from
there on: the chunks are stitched at that border.  Where a run is so long that
no border falls into the overlap, the pieces are carried on over the next
chunks until they meet.  The stitched segments are then encoded, again in
parallel, and joined.  A text of one chunk needs no stitching and is encoded
where it was read; only longer texts are exchanged, each different one once.

Pieces are merged here by rank; the vocabulary file holds the ranks.  Decoding
joins the tokens' bytes.

Defined results: a null or empty text has no tokens; special tokens are
ordinary text.  A column named like the result is replaced by it; all other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitelens.llm.common import packed, release, session

STEP, OVERLAP = 32_768, 512
# Characters that a piece's start may look ahead (the longest contraction).
LOOK = 3
# A worker's memory of merged pieces: it is emptied when it is full.
MEMORY = 250_000


class Vocabulary(dict):
    """Pre-token to its token ids (as int32 bytes), merged on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        self.table = pa.array(table, pa.large_binary())

    def __missing__(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        one = self.ranks.get(raw)
        found = array("i", [one] if one is not None else self._short(raw) if len(raw) <= 48 else self._merge(raw)).tobytes()
        if len(self) >= MEMORY:
            self.clear()
        if len(text) < 256:
            self[text] = found
        return found

    def _short(self, raw: bytes) -> list[int]:
        """Merges of the lowest rank, leftmost first, until none applies."""
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [get(raw[i:i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge(self, raw: bytes) -> list[int]:
        """The same for long pieces, in n log n."""
        n = len(raw)
        end = list(range(1, n + 1))       # of the part that starts at i
        before = list(range(-1, n - 1))   # start of the part before
        alive = [True] * n

        def rank(i: int):
            j = end[i]
            return self.ranks.get(raw[i:end[j]]) if j < n else None

        heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two parts has changed since
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            for k in (i, before[i]):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = end[i]
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(rows: list[bytes]) -> pa.Array:
    edges = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _bytes(lists: pa.Array, table: pa.Array) -> pa.Array:
    """The joined bytes of each list of ids; null lists: none."""
    flat = table.take(lists.flatten())
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
    byte = np.concatenate(([0], np.cumsum(pc.binary_length(flat).to_numpy())))[at].astype(np.int64)
    joined = flat.buffers()[2] or b""
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(byte), pa.py_buffer(joined)]).cast(pa.binary())


def _encode_rows(path: str, pattern: str, schema: pa.Schema, at_once: int = 1 << 20):
    """Texts (or segments) to token ids, and back to bytes if the schema has
    them; the text column goes."""
    def run(batches):
        vocab, find = vocabulary(path), regex.compile(pattern).findall
        ids = vocab.__getitem__
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            begin = 0
            while begin < batch.num_rows:
                rows, size, end = [], 0, begin
                while end < batch.num_rows and size < at_once:
                    text = texts[end].as_py() or ""
                    rows.append(b"".join(map(ids, find(text))))
                    size += len(text)
                    end += 1
                part = batch.slice(begin, end - begin)
                tokens = _lists(rows)
                yield pa.RecordBatch.from_arrays(
                    [tokens if f.name == "tokens" else _bytes(tokens, vocab.table) if f.name == "decoded"
                     else part.column(part.schema.get_field_index(f.name)) for f in schema], schema=schema)
                begin = end
        release()
    return run


def _cut(step: int, overlap: int):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, max(len(text), 1), step)
                for i in starts:
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "start": pa.array([i], pa.int64()), "last": [i == starts[-1]],
                        "text": [text[i:i + step + overlap]]})
    return run


def reliable(find, text: str, start: int, last: bool) -> list[int]:
    """Borders of the pieces of ``text`` that the text after it cannot change,
    counted in the whole text from ``start``."""
    size, out = len(text), [start]
    for m in find(text):
        if not last and (m.end() >= size or m.start() + LOOK > size):
            break
        out.append(start + m.end())
    return out


def _borders(pattern: str, step: int, overlap: int):
    """Pre-tokenise each chunk; keep its borders in the overlaps."""
    def run(batches):
        find = regex.compile(pattern).finditer
        for batch in batches:
            rows = batch.to_pydict()
            head, tail = [], []
            for start, last, text in zip(rows["start"], rows["last"], rows["text"]):
                all_ = reliable(find, text, start, last)
                head.append([b for b in all_ if b <= start + overlap])
                tail.append([b for b in all_ if b >= start + step])
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0), "start": batch.column(1), "last": batch.column(2), "text": batch.column(3),
                "head": pa.array(head, pa.list_(pa.int64())), "tail": pa.array(tail, pa.list_(pa.int64()))})
    return run


def _stitch(pattern: str, step: int, overlap: int):
    """Of one text: its segments, cut where neighbouring chunks meet."""
    find = regex.compile(pattern).finditer

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        texts, head, tail = pdf["text"].tolist(), pdf["head"].tolist(), pdf["tail"].tolist()
        n = len(texts)
        total = (n - 1) * step + len(texts[-1])

        def span(a: int, b: int) -> str:
            """The whole text's characters a to b."""
            first, out = a // step, []
            for c in range(first, n):
                if c * step >= b:
                    break
                low = max(a - c * step, 0)
                high = min(b - c * step, step if c < n - 1 else len(texts[c]))
                out.append(texts[c][low:high])
            return "".join(out)

        cuts, c, true = [0], 0, tail[0]
        while c < n - 1:
            met = set(true).intersection(head[c + 1].tolist())
            if met:
                cuts.append(min(met))
                true = tail[c + 1]
                c += 1
                continue
            # No common border: carry the pieces on, twice as far each time.
            at, ahead = cuts[-1], 2
            while True:
                to = min((c + 1 + ahead) * step, total)
                known = reliable(find, span(at, to), at, to == total)
                meets = [(k, set(known).intersection(head[k].tolist())) for k in range(c + 1, min(c + 1 + ahead, n))]
                meets = [(k, m) for k, m in meets if m]
                if meets or to == total:
                    break
                ahead *= 2
            if not meets:
                break
            c, met = meets[0]
            cuts.append(min(met))
            true = tail[c]
        ends = [*cuts[1:], total]
        return pd.DataFrame({"key": pdf["key"].iloc[0], "segment": range(len(cuts)),
                             "text": [span(a, b) for a, b in zip(cuts, ends)]})
    return run


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "tokens",
           step: int = STEP, overlap: int = OVERLAP, carry: tuple[str, ...] | None = None,
           decoded: str | None = None) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with the token ids of each text as
    ``out`` array<int>; with ``decoded`` also the bytes that they decode to."""
    session(docs)
    base = packed(docs, text_col, out, carry)
    ids = T.StructField("tokens", T.ArrayType(T.IntegerType(), True))
    back = [T.StructField("decoded", T.BinaryType())] if decoded else []
    done = T.StructType([base.schema["row"], ids, *back])
    long_ = F.coalesce(F.length("text"), F.lit(0)) > step
    short = base.where(~long_).mapInArrow(_encode_rows(path, pattern, to_arrow_schema(done)), done)
    more = base.where(long_).withColumn("key", F.sha2("text", 256))
    chunks = (more.select("key", "text").dropDuplicates(["key"])
              .mapInArrow(_cut(step, overlap), "key string, start long, last boolean, text string")
              .repartition("key", "start")
              .mapInArrow(_borders(pattern, step, overlap),
                          "key string, start long, last boolean, text string, head array<long>, tail array<long>"))
    piece = T.StructType([T.StructField("key", T.StringType()), T.StructField("segment", T.LongType()), ids])
    tokens = (chunks.groupBy("key").applyInPandas(_stitch(pattern, step, overlap), "key string, segment long, text string")
              .repartition("key", "segment")
              .mapInArrow(_encode_rows(path, pattern, to_arrow_schema(piece)), piece)
              .groupBy("key").agg(F.flatten(F.transform(
                  F.array_sort(F.collect_list(F.struct("segment", "tokens"))), lambda s: s["tokens"])).alias("tokens")))
    joined = more.select("row", "key").join(tokens, "key").select("row", "tokens")
    if decoded:
        joined = decode(joined, path)
    both = short.unionByName(joined)
    return both.select("row.*", F.col("tokens").alias(out), *[F.col("decoded").alias(d) for d in [decoded] if d])


def decode(tokens: DataFrame, path: str, tokens_col: str = "tokens", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of each list of ids as ``out``; null lists: no bytes."""
    session(tokens)
    names = [c for c in tokens.columns if c not in (out, tokens_col)]
    # The lists travel once; the result brings them back beside the bytes.
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    base = tokens.select(row.alias("row"), F.col(f"`{tokens_col}`").alias("tokens"))
    done = T.StructType([base.schema["row"], base.schema["tokens"], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        table = vocabulary(path).table
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("tokens"))
            begin = 0
            while begin < batch.num_rows:
                # Rows of some millions of tokens at a time.
                sizes = np.cumsum(lists.slice(begin).value_lengths().fill_null(0).to_numpy())
                end = begin + max(1, int(np.searchsorted(sizes, 1 << 21, "right")))
                part = lists.slice(begin, end - begin)
                raw = _bytes(part, table)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("row")).slice(begin, end - begin), part, raw],
                    names=["row", "tokens", "decoded"])
                begin = end

    return base.mapInArrow(run, done).select(*[F.col("row")[c].alias(c) for c in names], F.col("tokens").alias(tokens_col), F.col("decoded").alias(out))
