"""MinHash near-dedup with HyperMinHash registers.

1. Every text becomes a 128-bit key of its lower-cased word sequence and a
   sketch: ``REGISTERS`` buckets, each with the least hash of the shingles
   that fall into it, stored as a leading-zero count (4 bits) and the mantissa
   bits after it (4 bits).  Buckets that stay empty are filled in further
   rounds that deal more copies of every shingle, so a register agrees between
   two sets with the probability of their Jaccard similarity at any set size.
2. Texts with equal keys collapse to one node: copies are never paired.
3. Bands of ``ROWS`` registers are hashed.  Within a band bucket nodes are
   compared with the bucket's first node only.  Where the nodes that share a
   first node then fall into several components, those outside the largest are
   compared with all others in blocks, in the tasks: every colliding pair is
   compared or already connected, and no bucket emits its pairs.
4. Pairs whose register agreement, corrected for accidental collisions, is
   clearly below the threshold are dropped; the rest is decided on full sets.
5. Links are unioned by ``graph.components``.

A pair at similarity 0.75 is missed with probability 8e-6: with 60 bands of 6
registers it shares no bucket with probability 8e-6, and its estimate falls
below the cutoff (``MARGIN`` deviations, 0.613) with probability 4e-9.

Defined results: words are runs of bytes other than space and 0x09-0x0D with
A-Z lower-cased.  Under ``shingle`` words the whole sequence is the one
shingle; null, empty and blank texts have an empty set and link with nothing.
A row with a null id takes part, but its id is never the smallest.  Rows that
repeat an id are the same document: with equal texts they are kept or dropped
together.  Columns other than the two named are not read, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelens.llm import textops as X
from sitelens.llm.common import buckets, column, cut, frees, session, slices
from sitelens.llm.graph import components

SHINGLE, THRESHOLD = 5, 75  # per cent
BANDS, ROWS = 60, 6
REGISTERS = BANDS * ROWS
ZERO_BITS, MANTISSA_BITS = 4, 4
MARGIN = 6  # standard deviations of the estimate below the threshold
CHUNK = 1024  # nodes of a star on either side of a block
TARGET, STRANGER, LEAD = 0, 1, 2
BROADCAST_ROWS = 100_000
U = X.U


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, X.Words]:
    """(hash, text ordinal) of every shingle, with repeats, in text order."""
    w = X.words(texts, lower=True)
    at, text = X.fits(w.first, n)
    h = X.rolling(w.hashes, n)[at] if len(at) else np.zeros(0, U)
    few = np.flatnonzero((np.diff(w.first) < n) & (np.diff(w.first) > 0))
    if len(few):
        short = np.array([int(X.mix(_sequence(w, 3)[i:i + 1])[0]) for i in few], U)
        h, text = np.concatenate([h, short]), np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    return h, text, w


def _sequence(w: X.Words, salt: int) -> np.ndarray:
    """Hash of each text's whole word sequence; 0 for no words."""
    up, down = X.powers(len(w.hashes) + 1)
    total = np.zeros(len(w.hashes) + 1, U)
    np.cumsum(X.mix(w.hashes + U(salt)) * up[:len(w.hashes)], out=total[1:])
    n = np.diff(w.first)
    h = X.mix((total[w.first[1:]] - total[w.first[:-1]]) * down[w.first[:-1]] + n.astype(U) * U(0x9E3779B97F4A7C15))
    return np.where(n > 0, h, U(0))


def distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if not len(h):
        return h, text
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], text[keep]


def sketch(h: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Registers (n_texts, REGISTERS) of distinct shingles; texts without any: 0."""
    least = np.full(n_texts * REGISTERS, np.iinfo(np.uint64).max, U)
    empty = np.zeros(n_texts, np.int64)
    empty[np.unique(text)] = REGISTERS
    copies = range(0, 1)
    while len(h):
        fresh = np.full_like(least, np.iinfo(np.uint64).max)
        for c in copies:
            v = X.mix(h + U((c + 1) * 0xA0761D6478BD642F % 2**64))
            slot = ((v >> U(40)) * U(REGISTERS) >> U(24)).astype(np.int64) + text * REGISTERS
            np.minimum.at(fresh, slot, X.mix(v))
        open_ = least == np.iinfo(np.uint64).max
        least[open_] = fresh[open_]
        left = (least.reshape(n_texts, REGISTERS) == np.iinfo(np.uint64).max).any(1)
        keep = left[text]
        h, text = h[keep], text[keep]
        copies = range(copies.stop, 2 * copies.stop)
    # Leading zeros of the upper bits, then the bits after the first one.
    high = (least >> U(11)).astype(np.float64)
    _, exponent = np.frexp(high)
    zeros = np.minimum(53 - exponent, 2 ** ZERO_BITS - 1)
    shift = np.clip(least.dtype.itemsize * 8 - 1 - zeros - MANTISSA_BITS, 0, 63).astype(U)
    mantissa = (least >> shift) & U(2 ** MANTISSA_BITS - 1)
    return ((zeros.astype(np.uint8) << MANTISSA_BITS) | mantissa.astype(np.uint8)).reshape(n_texts, REGISTERS)


@functools.lru_cache(maxsize=65536)
def accidental(a: int, b: int) -> float:
    """Probability that registers of unrelated sets of about 2**(a/4) and
    2**(b/4) shingles agree: equal leading zeros, then equal mantissas."""
    def law(x: int) -> np.ndarray:
        per = max(2.0 ** (x / 4) / REGISTERS, 1.0)
        edge = 2.0 ** -np.arange(2 ** ZERO_BITS + 1)
        edge[-1] = 0
        at_least = 1 - (1 - edge) ** per  # the least of ``per`` uniform values is under the edge
        return at_least[:-1] - at_least[1:]
    return float((law(a) * law(b)).sum() / 2 ** MANTISSA_BITS)


def estimate(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers."""
    a, b = (np.rint(4 * np.log2(np.maximum(n, 1))).astype(int) for n in (n_a, n_b))
    chance = np.array([accidental(*x) for x in zip(a.tolist(), b.tolist())])
    return (agree - chance) / (1 - chance)


def _sketches(shingle: int):
    def run(batches):
        for part, texts in slices(batches):
            h, text, w = shingles(texts, shingle)
            h, text = distinct(h, text)
            regs = sketch(h, text, len(texts))
            n = np.bincount(text, minlength=len(texts))
            yield pa.RecordBatch.from_pydict({
                "doc_id": _column(part, "doc_id"), "n_shingles": pa.array(n, pa.int64()),
                "node": pa.array(_sequence(w, 1).view(np.int64)), "check": pa.array(_sequence(w, 2).view(np.int64)),
                "sketch": pa.array([r.tobytes() for r in regs], pa.binary())})
    return run


def _sets(shingle: int):
    def run(batches):
        for part, texts in slices(batches):
            h, text, w = shingles(texts, shingle)
            h, text = distinct(h, text)
            edges = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_sequence(w, 1).view(np.int64)), pa.array(_sequence(w, 2).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(edges), pa.array(h.view(np.int64)))],
                ["node", "check", "shingles"])
    return run


def _cutoff(threshold: int) -> float:
    t = threshold / 100
    return t - MARGIN * (t * (1 - t) / REGISTERS) ** 0.5


def _likely(threshold: int):
    """Pairs whose corrected estimate does not rule the threshold out."""
    least = _cutoff(threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(_column(batch, c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            agree = (a == b).mean(1)
            found = estimate(agree, _column(batch, "n_a").to_numpy(), _column(batch, "n_b").to_numpy())
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(found >= least))
    return run


def _band_entries(n_buckets: int):
    """Band hashes of each batch of nodes, packed by bucket.  Nodes of one
    batch that share a band are told apart here (bucket -1), and only the
    first of them is sent on: a large group sends one entry for each batch."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = _column(batch, "node").to_numpy()
            regs = np.frombuffer(b"".join(_column(batch, "sketch").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
            h = np.broadcast_to(X.mix(np.arange(1, BANDS + 1, dtype=U)), regs.shape[:2])
            for r in range(ROWS):
                h = X.mix(h ^ (regs[:, :, r].astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
            h = h.ravel()
            key = (X.bucket_of(h, n_buckets).astype(np.int64) << 32) | (h & U(0xFFFFFFFF)).astype(np.int64)
            owner = np.repeat(node, BANDS)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            at = X.groups(key[1:] != key[:-1])
            size = np.diff(np.append(at, len(key)))
            many = np.repeat(size > 1, size)
            sent_key, sent_node = key[at], owner[at]
            order, rows = X.by_bucket((sent_key >> 32).astype(np.int32))
            low, sent_node = sent_key[order].astype(np.uint32), sent_node[order]
            cells = [(-1, key[many].tobytes(), owner[many].tobytes()),
                     *((b, low[i:j].tobytes(), sent_node[i:j].tobytes()) for b, i, j in rows)]
            yield pa.RecordBatch.from_pydict(dict(zip(
                ("bucket", "h", "nodes"), (pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.binary(), pa.binary()))))))
    return run


@frees
def _shared_bands(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the bands that several batches have sent."""
    h = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["h"]])
    node = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["nodes"]])
    order = np.argsort(h, kind="stable")
    h, node = h[order], node[order]
    at = X.groups(h[1:] != h[:-1])
    size = np.diff(np.append(at, len(h)))
    many = np.repeat(size > 1, size)
    return pd.DataFrame({"key": (np.int64(pdf["bucket"].iloc[0]) << np.int64(32)) | h[many].astype(np.int64), "node": node[many]})


def _local_bands(batches):
    for batch in batches:
        for h, nodes in zip(_column(batch, "h").to_pylist(), _column(batch, "nodes").to_pylist()):
            if h:
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.frombuffer(h, np.int64)), "node": pa.array(np.frombuffer(nodes, np.int64))})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * |intersection| >= threshold * |union| of their
    shingle sets; component_id is the smallest id reachable, kept tells
    whether it is the row's own.
    """
    spark = session(docs)
    base = docs.select(column(docs, id_col, "doc_id", "bigint"), column(docs, text_col, "text", "string"))
    rows = cut(base.mapInArrow(_sketches(shingle), "doc_id long, n_shingles long, node long, check long, sketch binary"))
    nodes = cut(rows.where("n_shingles > 0").groupBy("node", "check")
                .agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")))
    sent = cut(nodes.select("node", "sketch").mapInArrow(_band_entries(buckets(spark)), "bucket int, h binary, nodes binary"))
    shared = (sent.where("bucket >= 0").groupBy("bucket").applyInPandas(_shared_bands, "key long, node long")
              .unionByName(sent.where("bucket < 0").select("h", "nodes").mapInArrow(_local_bands, "key long, node long"))
              .distinct())
    shared = cut(shared)
    firsts = shared.groupBy("key").agg(F.min("node").alias("a"))
    pairs = cut(shared.join(firsts, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    edges = _confirm(base, nodes, _estimated(nodes, pairs, threshold), shingle, threshold)
    labels = components(edges)
    more = _across(base, nodes, pairs, labels, shingle, threshold)
    if more is not None:
        labels = components(edges.unionByName(more))
    mine = rows.select("doc_id", "n_shingles", "node").join(labels.withColumnRenamed("id", "node"), "node", "left") \
        .withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    least = mine.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    return mine.join(least, "component", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _estimated(nodes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sketches do not rule the threshold out."""
    def side(x):
        return nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    return cut(pairs.join(side("a"), "a").join(side("b"), "b")
               .where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
               .mapInArrow(_likely(threshold), "a long, b long, n_a long, n_b long"))


def _blocks(pairs: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """(a, block, against, role, node, component): who is compared with whom.

    Nodes that collide have the first node of their bucket in common, so all
    colliding pairs meet in its star.  In a star of several components the
    members of the largest need no look among themselves: only the others, the
    strangers, lead, and everyone is a target.  Targets lie in one block of
    ``chunk`` for each ``chunk`` strangers, strangers are copied to each block of
    targets; one stranger among m members makes about m rows.
    Roles: ``TARGET``, ``STRANGER`` (a target that leads elsewhere), ``LEAD``.
    """
    told = (pairs.select("a", F.col("b").alias("node")).unionByName(pairs.select("a", F.col("a").alias("node")).distinct())
            .join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = (told.groupBy("a", "component").agg(F.count("*").alias("size"))
             .groupBy("a").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("members"))
             .where("members > top.size AND members > 2"))
    strange = F.col("component") != F.col("top.component")
    blocks = F.ceil(F.col("members") / chunk).cast("int")
    againsts = F.ceil((F.col("members") - F.col("top.size")) / chunk).cast("int")
    told = cut(told.join(mixed, "a").select(
        "a", "node", "component", strange.alias("strange"), blocks.alias("blocks"), againsts.alias("againsts"),
        F.pmod(F.hash("node"), blocks).alias("block"), F.pmod(F.hash("node", F.lit(1)), againsts).alias("against")))
    targets = told.select("a", "block", F.explode(F.sequence(F.lit(0), F.col("againsts") - 1)).alias("against"),
                          F.when(F.col("strange"), STRANGER).otherwise(TARGET).alias("role"), "node", "component")
    leads = told.where("strange").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "against",
                                         F.lit(LEAD).alias("role"), "node", "component")
    return targets.unionByName(leads)


def _across(base: DataFrame, nodes: DataFrame, pairs: DataFrame, labels: DataFrame, shingle: int, threshold: int) -> DataFrame | None:
    """Links between components among the nodes that share a first node,
    compared in the tasks; only links become rows."""
    told = cut(_blocks(pairs, labels, CHUNK))
    if told.isEmpty():
        return None
    cells = told.join(nodes.select("node", "n", "sketch"), "node").join(_sets_of(base, nodes, told.select("node").distinct(), shingle), "node")
    return cut(cells.groupBy("a", "block", "against").applyInPandas(_compare(threshold), "a long, b long"))


def _compare(threshold: int):
    """Of one block: links between different components, as a forest."""
    least = _cutoff(threshold)

    @frees
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, n, of, role = (pdf[c].to_numpy() for c in ("node", "n", "component", "role"))
        regs = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, REGISTERS)
        sets = [np.asarray(x, np.int64).view(U) for x in pdf["shingles"]]  # sorted as unsigned
        parent = {int(c): int(c) for c in of}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = []
        for i in np.flatnonzero(role == LEAD):
            # Two strangers lead against each other in two blocks; one look is enough.
            ok = (role == TARGET) | ((role == STRANGER) & (node > node[i]))
            ok &= (of != of[i]) & (100 * np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]))
            ok = np.flatnonzero(ok)
            if not len(ok):
                continue
            for j in ok[estimate((regs[ok] == regs[i]).mean(1), np.full(len(ok), n[i]), n[ok]) >= least]:
                x, y = find(int(of[i])), find(int(of[j]))
                if x == y:
                    continue
                at = np.searchsorted(sets[j], sets[i])
                both = int((sets[j][np.minimum(at, len(sets[j]) - 1)] == sets[i]).sum())
                if 100 * both >= threshold * (n[i] + n[j] - both):
                    parent[x] = y
                    links.append((node[i], node[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
    return run


def _sets_of(base: DataFrame, nodes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the full sets, sorted, of the nodes in ``ids``."""
    wanted = cut(nodes.join(ids, "node").select("doc_id", "node", "check"))
    # Three numbers a row: sent to all only up to a fixed count, else both sides are exchanged.
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = F.broadcast if few else (lambda df: df)
    same = base["doc_id"].eqNullSafe(wanted["doc_id"])
    return (base.join(some(wanted.select("doc_id")), same, "left_semi")
            .mapInArrow(_sets(shingle), "node long, check long, shingles array<long>")
            .join(some(wanted.select("node", "check")), ["node", "check"], "left_semi")
            .groupBy("node").agg(F.any_value("shingles").alias("shingles")))


def _confirm(base: DataFrame, nodes: DataFrame, near: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The likely pairs that link, decided on full sets."""
    ids = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(base, nodes, ids, shingle)
    return cut(near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
               .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
               .withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
               .where(f"100 * both >= {threshold} * (n_a + n_b - both)").select("a", "b"))
