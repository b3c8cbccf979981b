"""Exact dedup, spelling variants and source divergence against brute force,
and on the odd cases: nulls, empty and very long texts, ties, repeated rows,
empty tables, clashing names, hot groups."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from sitelens.llm import divergence, exact_dedup, spelling

SCHEMA = "doc_id long, text string, lang string, source string, digest string, row string, word string, n string"
CLASH = ("c", "r", "w", "n")


def _frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def _say(rng, n, letters="abcdefgh", longest=6):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n))


# ---------------------------------------------------------------- exact dedup

def _copies():
    rng = random.Random(3)
    long = _say(rng, 30000)
    rows = [(i, t) for i, t in enumerate([None, "", " ", "\t\n ", "a b", "a\x0b\fb", "a b ", " a b", "A b", "a b", long, long.replace(" ", "\n\t"), long + "x"])]
    rows += [(100 + i, "hot  text") for i in range(300)] + [(50 + i, _say(rng, 2, "ab", 1)) for i in range(60)]
    rows += [(None, "no id"), (None, "no id"), (None, "a b"), (4, "a b"), (7, "seven"), (7, "seven"), (7, "another")]
    rng.shuffle(rows)
    return [(i, t, None, "s") for i, t in rows]


@pytest.mark.parametrize("heavy, counters", [(exact_dedup.HEAVY, exact_dedup.COUNTERS), (4, 8), (1, 2)])
def test_exact_dedup(spark, heavy, counters):
    rows = _copies()
    frame = _frame(spark, rows).repartition(7)
    got = exact_dedup.mark(frame, carry=("text", "digest", "row"), heavy=heavy, counters=counters).collect()
    norm = lambda t: re.sub("[ \t\n\x0b\f\r]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter((i, min((j for j in groups[norm(t)] if j is not None), default=None), len(groups[norm(t)]),
                    hashlib.sha256(norm(t).encode()).digest(), t, "c", "r") for i, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest), *r.carried) for r in got) == want
    stay = Counter(norm(r.carried.text) for r in got if r.kept)
    assert stay == Counter(dict.fromkeys(groups, 1))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.drop_duplicates(frame, "doc_id", "text")
    assert kept.columns == frame.columns and kept.count() == len(groups)


def test_exact_dedup_heavy_hitters_are_bounded_and_exact(spark):
    rng = random.Random(8)
    values = ["h1"] * 400 + ["h2"] * 150 + [f"t{i}" for i in range(450)]
    rng.shuffle(values)
    docs = _frame(spark, [(i, v, "", "") for i, v in enumerate(values)]).repartition(9)
    rows = exact_dedup.digests(docs)
    got = {bytes(r.digest): r.group_size for r in exact_dedup.heavy_hitters(rows, heavy=10, counters=20).collect()}
    assert got == {hashlib.sha256(k.encode()).digest(): n for k, n in (("h1", 400), ("h2", 150))}
    with pytest.raises(ValueError):
        exact_dedup.heavy_hitters(rows, heavy=10, counters=19)
    assert exact_dedup.mark(docs.limit(0)).count() == 0


def test_misra_gries_merge_keeps_its_bound():
    rng = random.Random(1)
    for counters in (1, 3, 10):
        truth, summary = Counter(), Counter()
        for _ in range(40):
            more = Counter(int(rng.paretovariate(0.8)) for _ in range(rng.randint(0, 60)))
            truth.update(more)
            summary = exact_dedup.fold(summary, Counter(more), counters)
            assert len(summary) <= counters
            lost = sum(truth.values()) / (counters + 1)
            assert all(0 <= truth[k] - summary[k] <= lost for k in truth)


# ------------------------------------------------------------------- spelling

def _near(a, b):
    """One inserted, deleted or replaced code point, by trying them all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_scan_against_all_pairs():
    rng = random.Random(4)
    for trial in range(60):
        m, shared = rng.randint(1, 9), 0
        start = "".join(rng.choices("abé", k=rng.randint(0, m - 1)))
        shared = len(start)
        groups = [sorted({start + "".join(rng.choices("abé", k=k - shared)) for k in rng.choices([m, m + 1], k=rng.randint(1, 25)) if k >= shared}) for _ in range(4)]
        words = [w for g in groups for w in g]
        at = np.repeat(np.arange(4), [len(g) for g in groups])
        raw = [w.encode("latin-1") for w in words]
        size = np.array([len(w) for w in raw])
        q, w = spelling.scan(np.frombuffer(b"".join(raw) or b"\0", np.uint8), np.cumsum(size) - size, size, at, m, shared)
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if at[i] == at[j] and len(a) == m and _near(a, b)}
        assert set(zip(q.tolist(), w.tolist())) == want and len(q) == len(want)


@pytest.mark.parametrize("most", [spelling.MOST, 3])
def test_variants(spark, most):
    rng = random.Random(6)
    words = {"".join(rng.choices("abÿ", k=rng.randint(6, 8))) for _ in range(150)}
    words |= {"z" * 700, "z" * 350 + "y" + "z" * 349, "z" * 701, "colour", "color", "colours", "coloursé"}
    counts = {w: rng.choice([5, 5, 25, 25, 125, 700, 10**12]) for w in sorted(words)}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5), 5, most=most).collect()}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    assert sum(f is not None for f in form.values()) > 20 and set(got) == words
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        assert (r.form, r.root, r.n, r.n_near, r.form_n) == (form[w], root, counts[w], len(near[w]), counts.get(form[w]))


def test_vocabulary(spark):
    rng = random.Random(2)
    rows = [(i, _say(rng, 400, "abÀéÉ×Ab", 9), "", "") for i in range(40)]
    rows += [(None, "Nothing " * 300, "", ""), (1, None, "", ""), (2, "", "", ""), (3, "word-wide\tWordWide'WORDWIDE " * 50000, "", ""), (3, "word-wide", "", "")]
    for noise in (True, False):
        want, gone = Counter(), 0
        for i, t, *_ in rows:
            for raw in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
                h = crc32(f"{'' if i is None else i}:{w}".encode())
                if noise and h % 199 == 0:
                    k, gone = h % len(w), gone + 1
                    w = w[:k] + w[k + 1:]
                want[w] += len(w) >= 6
        want = {w: n for w, n in want.items() if n >= 5}
        assert not noise or gone
        for most in (spelling.MOST_WORDS, 1):
            got = spelling.vocabulary(_frame(spark, rows).repartition(3), noise=noise, most_words=most)
            assert {r.word: r.n for r in got.collect()} == want
    empty = spelling.vocabulary(_frame(spark, []))
    assert spelling.variants(empty).count() == 0


# ----------------------------------------------------------------- divergence

def _divergences(rows, min_docs, top):
    texts = [(lang or "", source or "", ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                                         for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in texts}:
        df = Counter(w for a, _, t in texts if a == lang for w in set(t))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        sources = {s: Counter() for a, s, _ in texts if a == lang}
        for a, s, t in texts:
            if a == lang:
                sources[s].update(w for w in t if w in set(kept))

        def p(counts):
            total = sum(counts.values()) + len(kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // total for w in kept}

        shares = {s: p(c) for s, c in sources.items()}
        whole = p(sum(sources.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(o, sum(f(shares[s][w], shares[o][w]) for w in kept)) for o in sources if o != s]
            term = [(w, f(shares[s][w], whole[w])) for w in kept if sources[s][w] > 0 and shares[s][w] > whole[w]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked[:most], 1)}
    return out


@pytest.mark.parametrize("bounds", [{}, {"cells": 7, "pairs": 5, "most_entries": 1}])
def test_divergences(spark, monkeypatch, bounds):
    rng = random.Random(9)
    monkeypatch.setattr(divergence, "ROWS", 10)
    rows = [(i, _say(rng, rng.randint(0, 60), "abéÉB ", 2), rng.choice(["en", "de", None, ""]), rng.choice(["x", "y", "z", None, "q"])) for i in range(120)]
    rows += [(900, None, "en", "silent"), (901, "12 34 !", "fr", "only digits"), (902, "rare words", "fr", "x"), (903, "x" * 5000 + " ab " * 400000, "en", "x"),
             (903, "ab ab", "en", "x"), (903, "ab ab", "en", "x"), (None, "日本 日本 ab", "ja", None), (1, "日本", "ja", "y"), (1, "日本", "ja", "y")]
    got = [tuple(r) for r in divergence.divergences(_frame(spark, rows).repartition(5), top=4, **bounds).collect()]
    assert len(got) == len(set(got)) and set(got) == _divergences(rows, 3, 4)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(_frame(spark, [])).count() == 0
    alone = divergence.divergences(_frame(spark, [(1, "one two", "en", "s")])).collect()
    assert alone == []


def test_terms_across_segments(monkeypatch):
    text = ("Ab1cdé " * 40 + "Q" * 100 + "..z").encode()
    whole = re.findall(rb"[a-z\x80-\xff]+", text.lower())
    for segment in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "SEGMENT", segment)
        assert [t for part in divergence.terms(text) for t in part] == whole


def test_shares_are_exact():
    rng = random.Random(0)
    for _ in range(200):
        total = rng.randint(1, 9 * 10**15)
        count = np.array([rng.randint(0, total - 1), 0, total - 1], np.int64)
        assert divergence.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]
