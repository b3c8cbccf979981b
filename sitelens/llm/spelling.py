"""Spelling variants: rare words joined to frequent words one edit away.

Near words differ by one inserted, deleted or replaced code point.  If they
have m code points (the shorter one) they share their first or their last
floor(m / 2); so every word goes, for m = its length and one less, to the group
of its first half and, reversed, to that of its last half.  A group is a piece
of a sorted vocabulary.  Groups of more than ``MOST`` words are split by the
same rule applied to what their words do not share yet, until one code point
is left, where the alphabet bounds them; so no group grows with the corpus.

Inside a group the sorted list is scanned by dynamic programming: the rows of
the edit matrix, banded to one off the diagonal, belong to ranges of words that
share a prefix, so the rows of one word are those of the next up to their
common prefix (LCP), and a range whose shared prefix is already more than one
edit away is skipped whole.  All queries of many groups advance one code point
at a time as numpy arrays.

Words: runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased.  ``noise``: a run
whose crc32 of ``<id>:<run>`` is a multiple of 199 loses one code point first.

Defined results: null texts have no words; a null id reads as empty in the
checksum.  Repeated rows count each.  Of near words with equal counts the
smallest in code-point order is the form.  A form has five times its variant's
count, so chains of forms end.  An empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import column, cut, release, session

MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
MOST = 4096
MOST_WORDS = 1 << 19
CHUNK = 1 << 14
SEGMENT = 1 << 20
ROWS = 1 << 16


def runs(text: bytes, least: int) -> Iterator[list[str]]:
    """The lower-cased runs of ``least`` letters or more, in lists of a bounded
    part of the text each."""
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall
    at = 0
    while at < len(text):
        end = at + SEGMENT
        while end < len(text) and text[end] not in b" \n":
            end += 1
        yield find(text[at:end].lower().decode(errors="replace"))
        at = end


def _count(min_length: int, every: int, most_words: int):
    def table(held: Counter) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for at in range(0, len(words), ROWS):
            part = words[at:at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])

    def run(batches):
        held = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in runs(text.as_buffer().to_pybytes() if text.is_valid else b"", min_length):
                    for word, n in Counter(part).items():
                        h = crc32(word.encode(), start)
                        if every and h % every == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1:]
                        if len(word) >= min_length:
                            held[word] += n
                if len(held) >= most_words:
                    yield from table(held)
                    held = Counter()
        yield from table(held)
        release()
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, noise: bool = False, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    session(docs)
    texts = docs.select(column(docs, id_col, "doc_id", "bigint"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return (texts.mapInArrow(_count(min_length, EVERY if noise else 0, most_words), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


# ------------------------------------------------------------------ the scan

_FAR = np.int8(2)


def scan(flat: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, m: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, word) exactly one edit apart, query of length m.

    Words lie in ``flat`` from ``start``, ``size`` letters each, sorted inside
    their ``group`` (consecutive); those of a group share ``shared`` letters.
    """
    n = len(start)
    fresh = np.ones(n, bool)
    fresh[1:] = group[1:] != group[:-1]
    # Letters that each word shares with the one before it; -1 opens a group.
    lcp = np.full(n, shared, np.int64)
    open_ = np.flatnonzero(~fresh)
    d = shared
    while len(open_):
        both = np.minimum(size[open_], size[open_ - 1]) > d
        open_ = open_[both]
        open_ = open_[flat[start[open_] + d] == flat[start[open_ - 1] + d]]
        d += 1
        lcp[open_] = d
    lcp[fresh] = -1
    first = np.flatnonzero(fresh)
    end = np.append(first[1:], n)
    # States: a range of words that share d letters, a query, and the matrix
    # cells left of, on and right of the diagonal.
    query = np.flatnonzero(size == m)
    of = np.searchsorted(first, query, "right") - 1
    lo, hi = first[of], end[of]
    cells = [np.full(len(query), c if shared + k <= m and shared + k >= 0 else 2, np.int8) for k, c in ((-1, 1), (0, 0), (1, 1))]
    out_q, out_w = [], []

    def differs(j):
        return (flat[start[query] + j] != letter).astype(np.int8) if 0 <= j < m else _FAR

    d = shared
    while len(query):
        done = size[lo] == d
        if done.any():
            k = m - d
            if -1 <= k <= 1:
                hit = done & (cells[k + 1] == 1)
                out_q.append(query[hit])
                out_w.append(lo[hit])
            lo = lo + done
            more = lo < hi
            query, lo, hi, cells = query[more], lo[more], hi[more], [c[more] for c in cells]
        # Ranges that share d + 1 letters start where the LCP is d or less.
        starts = np.flatnonzero(lcp <= d)
        a, b = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        many = b - a
        state = np.repeat(np.arange(len(query)), many)
        at = np.arange(len(state)) - np.repeat(np.cumsum(many) - many, many) + a[state]
        query, lo, hi = query[state], starts[at], np.minimum(np.append(starts[1:], n)[at], hi[state])
        left, on, right = (c[state] for c in cells)
        letter = flat[start[lo] + d]
        n0 = np.minimum(on + 1, left + differs(d - 1))
        n1 = np.minimum(np.minimum(right, n0) + 1, on + differs(d)) if d + 1 <= m else np.full_like(n0, _FAR)
        n2 = np.minimum(n1 + 1, right + differs(d + 1)) if d + 2 <= m else np.full_like(n0, _FAR)
        near = np.minimum(np.minimum(n0, n1), n2) <= 1
        query, lo, hi = query[near], lo[near], hi[near]
        cells = [np.minimum(c[near], _FAR) for c in (n0, n1, n2)]
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_w])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows (m, shared, key, reverse, body, n) sorted by m,
    shared, key and body: chunks of whole groups of one m and shared."""
    def work(held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = held.combine_chunks()
        group = held["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        body = held["body"].combine_chunks()
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
        flat = np.frombuffer(body.buffers()[2] or b"\0", np.uint8)
        q, w = scan(flat, offsets[:-1], np.diff(offsets), group, held["m"][0].as_py(), held["shared"][0].as_py())
        back = held["reverse"].to_numpy()
        size, n = np.diff(offsets), held["n"].to_numpy()
        longer = size[w] > size[q]
        q, w = np.concatenate([q, w[longer]]), np.concatenate([w, q[longer]])
        raw = flat.tobytes()
        words = {i: raw[offsets[i]:offsets[i + 1]][::-1 if back[i] else 1].decode("latin-1") for i in np.unique(q).tolist()}
        for at in range(0, len(q), ROWS):
            a, b = q[at:at + ROWS].tolist(), w[at:at + ROWS].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in a], pa.string()), pa.array([words[i] for i in b], pa.string()),
                                              pa.array(n[b], pa.int64())], ["word", "near", "near_n"])

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < CHUNK:
            continue
        # Whole groups, one m and shared at a time; the last group may go on.
        keys = [np.asarray(held[c].to_numpy()) for c in ("m", "shared")]
        key = held["key"].combine_chunks().to_numpy(zero_copy_only=False)
        kind = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
        edge = np.flatnonzero(kind | (key[1:] != key[:-1])) + 1
        kinds = set((np.flatnonzero(kind) + 1).tolist())
        at = 0
        for i in edge.tolist():
            if i in kinds or i - at >= CHUNK:
                yield from work(held.slice(at, i - at))
                at = i
        if len(edge) and edge[-1] > at:
            yield from work(held.slice(at, edge[-1] - at))
            at = int(edge[-1])
        held = held.slice(at)
    if held is not None and held.num_rows:
        kind = np.flatnonzero((np.diff(held["m"].to_numpy()) != 0) | (np.diff(held["shared"].to_numpy()) != 0)) + 1
        for a, b in zip([0, *kind.tolist()], [*kind.tolist(), held.num_rows]):
            yield from work(held.slice(a, b - a))
    release()


_ENTRY = "m int, path string, pre int, post int, prefix string, suffix string, word string, n bigint"
_KEY = ("m", "path", "prefix", "suffix")


def _halves(m, pre, post, path, word="word"):
    """The two groups that a word of a group goes to next."""
    half = F.floor((m - pre - post) / 2).cast("int")
    return F.array(*[F.struct(
        m.alias("m"), F.concat(path, F.lit(s)).alias("path"), (pre + (half if s == "p" else 0)).cast("int").alias("pre"),
        (post + (half if s == "s" else 0)).cast("int").alias("post"),
        F.substring(F.col(word), F.lit(1), pre + (half if s == "p" else 0)).alias("prefix"),
        F.substring(F.reverse(F.col(word)), F.lit(1), post + (half if s == "s" else 0)).alias("suffix")) for s in "ps"])


def near_words(vocab: DataFrame, min_length: int = MIN_LENGTH, most: int = MOST) -> DataFrame:
    """(word, near, near_n) of every two words (word, n) one edit apart, in
    both directions, each once."""
    session(vocab)
    size = F.length("word")
    start = vocab.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= min_length)).alias("m"))
    entries = start.select("word", "n", F.explode(_halves(F.col("m"), F.lit(0), F.lit(0), F.lit(""))).alias("e")).select("e.*", "word", "n")
    ready = None
    while True:
        # Few keys pass: at most entries / most of them.
        hot = cut(entries.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.max(F.col("m") - F.col("pre") - F.col("post")).alias("rest"))
                  .where((F.col("rows") > most) & (F.col("rest") > 1)).select(*_KEY))
        if hot.isEmpty():
            ready = entries if ready is None else ready.unionByName(entries)
            break
        cold = entries.join(hot, list(_KEY), "left_anti")
        ready = cold if ready is None else ready.unionByName(cold)
        entries = cut(entries.join(hot, list(_KEY), "left_semi").select(
            "word", "n", F.explode(_halves(F.col("m"), F.col("pre"), F.col("post"), F.col("path"))).alias("e")).select("e.*", "word", "n"))
    back = F.col("post") > F.col("pre")
    key = F.concat_ws("\t", "path", "prefix", "suffix")
    dealt = (ready.select("m", F.greatest("pre", "post").alias("shared"), key.alias("key"), back.alias("reverse"),
                          F.encode(F.when(back, F.reverse("word")).otherwise(F.col("word")), "ISO-8859-1").alias("body"), "n")
             .repartition("m", "key").sortWithinPartitions("m", "shared", "key", "body"))
    return (dealt.mapInArrow(_pairs, "word string, near string, near_n bigint")
            .repartition("word").dropDuplicates(["word", "near"]))


def _roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of words with a form: pointers doubled until none moves."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        far = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        at = cut(at.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError(f"forms did not settle in {max_rounds} rounds")


def variants(vocab: DataFrame, min_length: int = MIN_LENGTH, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocab`` (word, n)."""
    vocab = cut(vocab)
    near = (near_words(vocab, min_length, most).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    found = cut(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")))
    roots = _roots(found.where("f IS NOT NULL").select("word", "f.form"))
    return found.join(roots, "word", "left").select(
        "word", "f.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "f.form_n")
