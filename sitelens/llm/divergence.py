"""How far the sources of a language diverge from it and from each other.

In-mapper stripes: a partition folds whole documents into stripes, term ->
source -> (document frequency, count), and spills them when they hold
``MOST_ENTRIES`` entries.  Stripes meet by (lang, term), where they are merged
entry by entry, so that a frequent term is a stream of sums and never a list of
spills.  The merged stripes that are frequent enough are dealt to blocks of
about ``CELLS`` (term, source) cells; a block sees all sources of its language
and emits divergences directly: one sum for each pair of sources, and its own
``top`` terms of each source.  With more than 1,000 sources in a language a
block is worked on in slices of its sources, each of about ``PAIRS`` pairs.

For a group (lang, source) and the language itself: N is the count of all kept
terms, V the number of kept terms, p = 1 + floor(10**9 * (count + 1) / (N + V)),
and the divergence of p from q is floor((p - q)**2 / q).  All integers, exact:
the division is taken in three steps of 1000, so counts up to 9 * 10**15 fit.

Cost: terms * sources**2 of a language; a task holds CELLS cells and PAIRS sums.

Defined results: null text, lang or source is ''.  A document is a row, so
repeated rows count each.  A group without terms takes part with counts of 0; a
language without kept terms has pairs of 0 and no terms.  Ties rank by item in
UTF-8 order.  An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import cut, release, session

MIN_DOCS, TOP = 3, 200
MOST_ENTRIES = 1 << 19
CELLS, PAIRS = 1 << 17, 1 << 20
ROWS = 1 << 15
SEGMENT = 1 << 20

# Bytes of terms, A-Z lower-cased; all else becomes a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STRIPE = "lang string, term string, sources array<string>, docs array<bigint>, counts array<bigint>"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of a bounded part of it each."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        part = text[at:end].translate(_TERM)
        while end < len(text) and part[-1] != 32:  # a term goes on
            more = text[end:end + SEGMENT].translate(_TERM)
            gap = more.find(b" ")
            part += more if gap < 0 else more[:gap]
            end += len(more) if gap < 0 else gap
            if gap >= 0:
                break
        yield part.split()
        at = end


class Stripes:
    """Stripes of one partition: counts and document frequencies by group."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        df, n = self.groups.setdefault((lang, source), (Counter(), Counter()))
        seen: set[bytes] = set()
        for part in terms(text):
            n.update(part)
            seen.update(part)
        df.update(seen)

    def entries(self) -> int:
        return sum(len(df) for df, _ in self.groups.values())

    def spill(self) -> Iterator[pa.RecordBatch]:
        by_lang = defaultdict(list)
        for (lang, source), counts in self.groups.items():
            by_lang[lang].append((source, *counts))
        self.groups = {}
        for lang, found in by_lang.items():
            stripes = defaultdict(lambda: ([], [], []))
            for source, df, n in found:
                for term, docs in df.items():
                    s = stripes[term]
                    s[0].append(source)
                    s[1].append(docs)
                    s[2].append(n[term])
            keys = list(stripes)
            for at in range(0, len(keys), ROWS):
                part = keys[at:at + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                     *[pa.array([stripes[k][i] for k in part], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]],
                    ["lang", "term", "sources", "docs", "counts"])


def _fold(most_entries: int):
    def run(batches):
        stripes, held = Stripes(), 0
        for batch in batches:
            lang, source, text = (batch.column(i) for i in range(3))
            for i, (a, b) in enumerate(zip(lang.to_pylist(), source.to_pylist())):
                stripes.add(a, b, text[i].as_buffer().to_pybytes())
                held += 1
                # Texts are counted between looks, entries at each look.
                if held >= 256 or len(text[i].as_buffer()) > SEGMENT:
                    held = 0
                    if stripes.entries() >= most_entries:
                        yield from stripes.spill()
        yield from stripes.spill()
        release()
    return run


def merged_stripes(docs: DataFrame, min_docs: int = MIN_DOCS, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(lang, term, stripe array<struct<source, count>>) of the terms in at
    least ``min_docs`` documents of their language."""
    spilled = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_fold(most_entries), _STRIPE)
    return (spilled.repartition("lang", "term")
            .select("lang", "term", F.explode(F.arrays_zip("sources", "docs", "counts")).alias("e"))
            .groupBy("lang", "term", F.col("e.sources").alias("source")).agg(F.sum("e.docs").alias("docs"), F.sum("e.counts").alias("n"))
            .groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("stripe"))
            .where(F.col("docs") >= min_docs).drop("docs"))


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), exact in 64 bits."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    # A share of 1 needs no remainder: count + 1 <= total always.
    return out + 1


def _emit(top: int):
    out = ("lang", "source", "part", "item", "value")

    def table(lang, sources, part, items, values):
        n = len(values)
        return pa.table([pa.array([lang] * n, pa.string()), pa.array(sources, pa.string()), pa.array([part] * n, pa.string()),
                         pa.array(items, pa.string()), pa.array(values, pa.int64())], out)

    def run(key, stripes: pa.Table, groups: pa.Table) -> pa.Table:
        lang, mine = key[0].as_py(), key[2].as_py()
        groups = groups.sort_by("source")
        names, slices = groups["source"].to_pylist(), groups["slices"][0].as_py()
        v, n = groups["v"][0].as_py(), np.array(groups["n"].to_pylist(), np.int64)
        items = stripes["term"].to_pylist()
        count = np.zeros((len(items), len(names)), np.int64)
        if items:
            place = {s: i for i, s in enumerate(names)}
            lists = stripes["sources"].combine_chunks()
            row = np.repeat(np.arange(len(items)), np.diff(lists.offsets.to_numpy()))
            count[row, [place[s] for s in lists.flatten().to_pylist()]] = stripes["counts"].combine_chunks().flatten().to_numpy()
        total = n + v
        p = share(count, total) if items else count
        q = share(count.sum(axis=1), n.sum() + v) if items else n[:0]
        found = []
        for g in range(mine, len(names), slices):
            d = p[:, g, None] - p
            others = [i for i in range(len(names)) if i != g]
            found.append(table(lang, [names[g]] * len(others), "pair", [names[i] for i in others], (d * d // np.maximum(p, 1)).sum(axis=0)[others]))
            up = np.flatnonzero((count[:, g] > 0) & (p[:, g] > q))
            value = (p[up, g] - q[up]) ** 2 // q[up]
            if len(up) > top:  # ties at the border stay
                least = np.partition(value, len(value) - top)[len(value) - top]
                up, value = up[value >= least], value[value >= least]
            found.append(table(lang, [names[g]] * len(up), "term", [items[i] for i in up], value))
        return pa.concat_tables(found) if found else table(lang, [], "pair", [], n[:0])
    return run


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS,
                pairs: int = PAIRS, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text)."""
    session(docs)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(merged_stripes(docs, min_docs, most_entries))
    n = kept.select("lang", F.explode("stripe").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = (docs.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    groups = cut(groups)
    cut_up = groups.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") * F.max("v") / F.lit(cells))).cast("int").alias("blocks"),
        F.ceil(F.count("*") * F.count("*") / F.lit(pairs)).cast("int").alias("slices"))
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    left = (kept.join(cut_up, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), every, "term",
        F.col("stripe.source").alias("sources"), F.col("stripe.n").alias("counts")))
    right = (groups.join(cut_up, "lang").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
             .select("lang", "block", every, "slices", "source", "n", "v"))
    by = ("lang", "block", "slice")
    found = cut(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _emit(top), "lang string, source string, part string, item string, value bigint"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    among = (found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
             .withColumn("rank", F.row_number().over(order)))
    ranked = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return among.unionByName(ranked)
