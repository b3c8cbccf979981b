"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items are made canonical: letters and digits
only, lower case.  Numbers and units become typed placeholders, so a question
keeps its template when its values change.  Windows of ``WINDOW`` template
words are hashed and looked up in the benchmark's; windows with fewer than
``LITERALS`` literal words say too little as templates and are looked up with
their words as they are.  Whether a word is a name shows in its
case and place only, which a copy may change: every window is looked up with
its title-case words as they are, all as names, and as names where they begin
no sentence or line.  An alignment with one such window is then compared in
full, word by word, with any title-case word as a possible name.  For every alignment of a
document with an item the slots are then checked: each value of the item must
stand for one value of the document, and the other way round.  Slots that
break this take only their windows with them; a word counts as covered where
as many windows are consistent as are not.  An item is found if the covered
words are ``COVERAGE`` of its words.

The benchmark is taken in blocks of ``BLOCK_BYTES`` at most, each one
broadcast by itself: that bounds what is broadcast whatever the benchmark's
size.  Documents are read in one pass per block, never exchanged.

Defined results: null and empty texts and items match nothing.  Items shorter
than a window are one window of their own length, down to one word.  In
scripts without spaces each character is a word.  Items with equal texts are each reported.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm import textops as X
from sitelens.llm.common import column, packed, session, slices, unpacked

WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
BLOCK_BYTES = 8 << 20
U = X.U

# Unit and number words, and the placeholder of each type.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces
pound pounds ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days
week weeks month months year years dollar dollars euro euros cent cents percent degree degrees celsius
fahrenheit watt watts volt volts joule joules kmh mph""".split()
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
billion""".split()
LITERAL, NUMBER, NAME, UNIT = range(4)

# Value of each byte in a word's hash: letters in lower case, digits, bytes of
# other scripts; 0 for bytes that do not count.
_VALUE = X.LOWER_VALUE.copy()
_VALUE[[b for b in range(128) if not chr(b).isalnum()]] = 0
_DIGIT, _UPPER, _LOWER = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((48, 57), (65, 90), (97, 122)))
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _unspaced(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a word is cut before each byte, whether the byte is part of a
    mark): scripts written without spaces have a word for each character
    (Han, Kana, Thai, Lao, Burmese, Khmer), ideographic and full-width marks
    none."""
    cut, mark = np.zeros((2, len(buf)), bool)
    at = np.flatnonzero(buf >= 0xE0)
    if not len(at):
        return cut, mark
    b = buf[np.minimum(at[None] + np.arange(3)[:, None], len(buf) - 1)].astype(int)
    code = (b[0] << 16) | (b[1] << 8) | b[2]
    within = lambda *ranges: np.logical_or.reduce([(code >= lo) & (code <= hi) for lo, hi in ranges])
    marks = within((0xE38080, 0xE38084), (0xE38088, 0xE380BF), (0xEFBC81, 0xEFBC8F), (0xEFBC9A, 0xEFBCA0),
                   (0xEFBCBB, 0xEFBD80), (0xEFBD9B, 0xEFBDA5))
    three = marks | within((0xE30000, 0xE9FFFF), (0xE0B800, 0xE0BBFF), (0xE18000, 0xE182FF), (0xE19E00, 0xE19FFF))
    four = within((0xF0A000, 0xF0B3FF))
    for i, n in ((at[three], 3), (at[four], 4)):
        cut[i] = True
        cut[np.minimum(i + n, len(buf) - 1)] = True
    for k in range(3):
        mark[np.minimum(at[marks] + k, len(buf) - 1)] = True
    return cut, mark


class Template:
    """Canonical words of a batch of texts."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8).copy()
        offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
        # Accented capitals of two bytes (C3 80 to C3 9E) in lower case.
        wide = np.zeros(len(buf), bool)
        wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        upper = _UPPER[buf]
        upper[:-1] |= wide[1:]
        low = buf.copy()
        low[wide] += 0x20
        sep = X.SEPARATOR[buf]
        before = np.ones_like(sep)
        before[1:] = sep[:-1]
        cut, mark = _unspaced(buf)
        start, stop = np.flatnonzero((before | cut) & ~sep), np.flatnonzero((sep | cut) & ~before)
        value = np.where(mark, U(0), _VALUE[low])
        counts = value != 0
        # Place of each counting byte among the counting bytes: marks inside a word do not matter.
        place = np.concatenate(([0], np.cumsum(counts)))
        up, down = X.powers(int(place[-1]) + 1)
        total = np.zeros(len(buf) + 1, U)
        np.cumsum(np.where(counts, value * up[place[:-1]], U(0)), out=total[1:])
        size = place[stop] - place[start]
        h = X.mix((total[stop] - total[start]) * down[place[start]] + size.astype(U))
        digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
        lines = np.concatenate(([0], np.cumsum(buf == 10)))
        end_before = np.concatenate(([0], stop[:-1])) if len(stop) else stop
        opens = (lines[start] > lines[end_before]) | _STOP[buf[np.maximum(end_before - 1, 0)]]
        text = np.searchsorted(offset, start, "right") - 1
        opens[np.flatnonzero(np.diff(text, prepend=-1))] = True
        # Second letter: a title-case word is a name, one in capitals is not.
        second = np.minimum(start + 1 + wide[np.minimum(start + 1, len(buf) - 1)], len(buf) - 1)
        title = upper[start] & (_LOWER[buf[second]] | (buf[second] == 0xC3)) if len(start) else np.zeros(0, bool)
        kind = np.zeros(len(h), np.int8)
        kind[np.isin(h, _UNIT_HASHES)] = UNIT
        kind[(digits[stop] > digits[start]) | np.isin(h, _NUMBER_HASHES)] = NUMBER
        real = size > 0
        self.value, self.kind, self.text = h[real], kind[real], text[real]
        # Words that may be names: all in title case, and those that no sentence or line begins with.
        self.title = title[real] & (self.kind == LITERAL)
        self.inner = self.title & ~opens[real]
        self.word = (np.arange(len(h)) - np.searchsorted(start, offset)[text])[real]  # index among the text's words
        self.template = np.where(self.kind == LITERAL, self.value, _PLACEHOLDER[self.kind])
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def windows(self, n: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, index, text) of the windows with enough literal words, with
        no word taken for a name, all that may be one, and the inner ones; of
        the other windows as they are."""
        every, texts = X.fits(self.first, n)
        out = [(np.zeros(0, U), every[:0], texts[:0])]
        count = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[every + n] - c[every]
        plain, title, inner = (count(x) for x in (self.kind == LITERAL, self.title, self.inner))
        for name, keep in ((None, plain >= literals), (self.title, (title > 0) & (plain - title >= literals)),
                           (self.inner, (inner > 0) & (inner < title) & (plain - inner >= literals))):
            if keep.any():
                template = self.template if name is None else np.where(name, _PLACEHOLDER[NAME], self.template)
                out.append((X.rolling(template, n, n)[every[keep]], every[keep], texts[keep]))
        keep = plain < literals
        if keep.any():
            out.append((X.rolling(self.value, n, n)[every[keep]], every[keep], texts[keep]))
        return tuple(np.concatenate(x) for x in zip(*out))


_PLACEHOLDER = X.mix(np.arange(1, 5, dtype=U) * U(0x632BE59BD9B4E019))
_UNIT_HASHES = _NUMBER_HASHES = np.zeros(0, U)
_UNIT_HASHES, _NUMBER_HASHES = Template([" ".join(UNITS).encode()]).value, Template([" ".join(NUMBERS).encode()]).value


def conflicting(item: np.ndarray, doc: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Slots whose values do not stand for each other one to one, by type.
    A value's partner is its most frequent one, of equals the value itself;
    slots with another partner conflict, without a partner all of them do."""
    out = np.zeros(len(kind), bool)
    slots = np.flatnonzero(kind != LITERAL)
    if (item[slots] == doc[slots]).all():
        return out
    pairs = list(zip(kind[slots].tolist(), item[slots].tolist(), doc[slots].tolist()))
    votes: dict[tuple, list] = {}
    for (k, a, b), n in Counter(pairs).items():
        votes.setdefault((k, 0, a), []).append((n, a == b, b))
        votes.setdefault((k, 1, b), []).append((n, a == b, a))
    best = {}
    for key, v in votes.items():
        v.sort()
        best[key] = v[-1][2] if len(v) == 1 or v[-1][:2] > v[-2][:2] else None
    out[slots] = [best[k, 0, a] != b or best[k, 1, b] != a for k, a, b in pairs]
    return out


def covering(start: np.ndarray, n: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Words over which windows (start, length) without a wrong slot lie, and
    at least as many as windows with one."""
    bad = np.concatenate(([0], np.cumsum(wrong)))
    good = bad[start + n] == bad[start]
    count = np.zeros((2, len(wrong) + 1), np.int64)
    np.add.at(count, (good.astype(int), start), 1)
    np.add.at(count, (good.astype(int), start + n), -1)
    down, up = np.cumsum(count[:, :-1], 1)
    return (up > 0) & (up >= down)


def _index(items: list[tuple[int, bytes]], window: int, literals: int):
    """Of one block: its templates, and by window length the sorted hashes
    with (item ordinal, place in the item)."""
    t = Template([x or b"" for _, x in items])
    size = np.diff(t.first)
    tables = {}
    for n in sorted({min(window, int(s)) for s in size if s > 0}):
        h, at, text = t.windows(n, literals)
        keep = (size[text] >= window) if n == window else size[text] == n
        h, at, text = h[keep], at[keep], text[keep]
        order = np.argsort(h, kind="stable")
        if len(order):
            tables[n] = (h[order], text[order], (at - t.first[text])[order])
    return t, size, [i for i, _ in items], tables


def _aligned(bench: Template, i: int, docs: Template, d: int, shift: int, window: int, literals: int) -> tuple[np.ndarray, int]:
    """Words of item ``i`` that document ``d`` covers at this shift, and how
    many of their slots changed.  Unequal words stand for each other if both
    are numbers or units, or if one of them may be a name."""
    size = int(bench.first[i + 1] - bench.first[i])
    low, high = max(0, -shift), min(size, int(docs.first[d + 1] - docs.first[d]) - shift)
    x, y = (slice(t.first[k] + m + low, t.first[k] + m + high) for t, k, m in ((bench, i, 0), (docs, d, shift)))
    same = bench.value[x] == docs.value[y]
    kind = np.where((bench.kind[x] == LITERAL) & (bench.title[x] | docs.title[y]), NAME, bench.kind[x])
    fits = np.where(bench.kind[x] == docs.kind[y], same | (kind != LITERAL), False)
    n = min(window, size)
    total = lambda v: (c := np.concatenate(([0], np.cumsum(v))))[n:] - c[:-n]
    enough = (total(same & (bench.kind[x] == LITERAL)) >= literals) | (total(same) == n)
    start = np.flatnonzero((total(fits) == n) & enough)
    over = np.zeros(len(same) + 1, np.int64)
    np.add.at(over, start, 1)
    np.add.at(over, start + n, -1)
    kind[np.cumsum(over[:-1]) == 0] = LITERAL  # words of no window are no slots
    wrong = conflicting(bench.value[x], docs.value[y], kind)
    # Where case and place leave open whether it is a name, a wrong one is just another word.
    unsure = wrong & (kind == NAME) & ~(bench.inner[x] & docs.inner[y])
    if unsure.any():
        wrong &= ~unsure
        start = np.flatnonzero((total(fits & (same | ~unsure)) == n) & enough)
    p = np.flatnonzero(covering(start, np.full(len(start), n), wrong))
    return p + low, int(((kind != LITERAL) & ~same)[p].sum())


def _matches(texts: list[bytes], index, coverage: float, window: int, literals: int) -> list[list[dict]]:
    bench, size, item_ids, tables = index
    out: list[list[dict]] = [[] for _ in texts]
    docs = Template(texts)
    hits = []
    for n, (keys, item, place) in tables.items():
        h, at, text = docs.windows(n, literals)
        low = np.searchsorted(keys, h)
        found = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h)
        low, high = low[found], np.searchsorted(keys, h[found], "right")
        each = high - low
        entry = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
        found = np.repeat(found, each)
        hits.append(np.stack([text[found], item[entry], at[found] - docs.first[text[found]] - place[entry]], 1))
    hits = np.concatenate(hits) if hits else np.zeros((0, 3), np.int64)
    if not len(hits):
        return out
    hits = hits[np.lexsort(hits.T[::-1])]
    hits = hits[X.groups((hits[1:] != hits[:-1]).any(1))]
    edge = X.groups((hits[1:, :2] != hits[:-1, :2]).any(1))
    for a, b in zip(edge, [*edge[1:], len(hits)]):
        d, i = int(hits[a, 0]), int(hits[a, 1])
        covered = np.zeros(size[i], bool)
        where, slots = [], 0
        if size[i] < min(literals, window):  # each hit is a whole copy
            covered[:] = True
            of_doc = docs.first[d] + hits[[a, b - 1], 2] + (0, size[i] - 1)
            where = [int(docs.word[of_doc[0]]), int(docs.word[of_doc[1]]) + 1]
            shifts = ()
        else:
            shifts = hits[a:b, 2].tolist()
        for shift in shifts:
            p, changed = _aligned(bench, i, docs, d, shift, window, literals)
            if len(p):
                covered[p] = True
                of_doc = docs.first[d] + shift + p
                where += [int(docs.word[of_doc[0]]), int(docs.word[of_doc[-1]]) + 1]
                slots += changed
        if where and covered.mean() >= coverage:
            out[d].append({"item_id": item_ids[i], "n_covered": int(covered.sum()), "n_item": int(size[i]),
                           "n_changed": slots, "start": min(where), "end": max(where)})
    return out


MATCHES = "array<struct<item_id:bigint,n_covered:bigint,n_item:bigint,n_changed:bigint,start:bigint,end:bigint>>"


def blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple[int, bytes]]]:
    """The benchmark's items in lists of bounded size, one fetched at a time."""
    base = bench.select(column(bench, id_col, "item_id", "bigint"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * int(total) // block_bytes))
    for b in range(n):
        part = base.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else base
        yield sorted(((r[0], None if r[1] is None else bytes(r[1])) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))


def flag(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
         window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE,
         block_bytes: int = BLOCK_BYTES, out: str = "matches", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with the items found in each text as ``out``: item_id,
    n_covered of n_item words, n_changed slots, and the first and last + 1
    word of the place.  A column of that name is replaced."""
    spark = session(docs)
    rows = packed(docs, text_col, out, carry).withColumn("matches", F.lit(None).cast(MATCHES))
    schema = rows.schema
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in schema["matches"].dataType.elementType.fields]))

    def search(shared):
        def run(batches):
            index = _index(shared.value, window, literals)
            for part, texts in slices(batches):
                found = _matches(texts, index, coverage, window, literals)
                had = part.column(2).to_pylist()
                both = [sorted([*(h or ()), *f], key=lambda m: (m["item_id"] is None, m["item_id"])) for h, f in zip(had, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, kind)], names=["row", "text", "matches"])
        return run

    for block in blocks(bench, item_id_col, item_text_col, block_bytes):
        rows = rows.mapInArrow(search(spark.sparkContext.broadcast(block)), T.StructType(schema.fields))
    return unpacked(rows, "matches", out)
