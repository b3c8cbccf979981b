"""Stupid-backoff scores of documents against all other documents.

Documents are dealt into groups by a hash of their id and text.  A group
explodes its n-grams of every order and sends each distinct one, with its
count, to the hash bucket that owns it (packed: sorted hashes as differences).
The buckets are the count tables: each sums what all groups have sent and
answers every group with the totals of its n-grams, in the order sent.  The
group joins the answers to its exploded n-grams and sums per document.  What
is gathered grows with the corpus, and nothing passes through the driver.

Score of a word after its context, counts taken without the document itself:
the longest context with a count gives count(context word) / count(context);
each step to a shorter one costs a factor ``ALPHA``; a word never seen
elsewhere counts 1 / (words elsewhere + 1).  Log scores are rounded to
millionths and summed as integers, so the order of adding does not matter.

Defined results: words are runs of bytes other than space and 0x09-0x0D,
unchanged.  Null, empty and blank texts have no words, a sum of 0 and a null
mean.  Rows with equal id and text are separate documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import textops as X
from sitelens.llm.common import buckets, column, session

ORDER, ALPHA = 2, 0.4
DOCS_PER_GROUP = 2000
U = X.U


def _grams(texts: list[bytes], order: int):
    """For n = 1 to order: (hash, word index, text ordinal) of every n-gram."""
    w = X.words(texts)
    out = []
    for n in range(1, order + 1):
        at, text = X.fits(w.first, n)
        out.append((X.rolling(w.hashes, n, n)[at] if len(at) else np.zeros(0, U), at, text))
    return w, out


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [b"" if x is None else x for x in pdf["text"]]


def _request(order: int, n_buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {k: [] for k in ("bucket", "n", "grp", "keys", "counts")}
        _, grams = _grams(_texts(pdf), order)
        for n, (h, _, _) in enumerate(grams, 1):
            keys, counts = np.unique(h, return_counts=True)
            # A bucket is a range of hashes, so sorted hashes are in bucket order.
            edges = np.searchsorted(X.bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
            for b, (i, j) in enumerate(zip(edges, edges[1:])):
                rows["bucket"].append(b)
                rows["n"].append(n)
                rows["grp"].append(pdf["grp"].iloc[0])
                rows["keys"].append(X.pack(keys[i:j].view(np.int64)))
                rows["counts"].append(X.pack(counts[i:j]))
        return pd.DataFrame(rows)
    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket and order: each group's n-grams with the corpus counts."""
    keys, counts = [X.unpack(b) for b in pdf["keys"]], [X.unpack(b) for b in pdf["counts"]]
    owned, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(owned), np.int64)
    np.add.at(total, index, np.concatenate(counts))
    answer = np.split(total[index], np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"grp": pdf["grp"], "n": pdf["n"], "bucket": pdf["bucket"],
                         "all": int(total.sum()), "totals": [X.pack(a) for a in answer]})


def _per_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each entry's hash occurs in its text."""
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    at = X.groups((hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])) if len(hs) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(hs)))
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(size, size)
    return out


def _score(order: int, alpha: float):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(docs)
        w, grams = _grams(texts, order)
        n_words = np.diff(w.first)
        total_words = int(answers.loc[answers["n"] == 1, "all"].sum())
        text = grams[0][2]
        elsewhere = total_words - n_words[text]
        # counts[n][i]: of the n-gram that starts at word i, without its own text
        counts = {}
        for n, (h, at, of) in enumerate(grams, 1):
            got = answers[answers["n"] == n].sort_values("bucket")
            totals = np.concatenate([X.unpack(b) for b in got["totals"]]) if len(got) else np.zeros(0, np.int64)
            keys = np.unique(h)
            c = np.zeros(len(w.hashes), np.int64)
            c[at] = totals[np.searchsorted(keys, h)] - _per_text(h, of)
            counts[n] = c
        place = np.arange(len(text)) - w.first[text]  # words before it in its text
        reach = np.minimum(place + 1, order)          # longest n-gram that can end here
        score, level = np.zeros(len(text)), np.full(len(text), -1)
        index = np.arange(len(text))
        for n in range(order, 0, -1):
            open_ = index[(level < 0) & (reach >= n)]
            c = counts[n][open_ - n + 1]
            seen = open_[c > 0]
            below = counts[n - 1][seen - n + 1] if n > 1 else elsewhere[seen]
            score[seen] = np.log(alpha ** (reach[seen] - n) * (c[c > 0] / below))
            level[seen] = n
        none = level < 0
        score[none] = np.log(alpha ** reach[none] * (1 / (elsewhere[none] + 1)))
        level[none] = 0
        micro = np.rint(score * 1e6).astype(np.int64)
        sums = np.zeros(len(texts), np.int64)
        np.add.at(sums, text, micro)
        by = [np.bincount(text[level == n], minlength=len(texts)) for n in range(order + 1)]
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_words": n_words, "log_score_micro": sums,
                             "n_unseen": by[0], "n_by_order": list(np.stack(by[1:], 1))})
    return run


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, log_score_micro (natural log, in
    millionths, summed), mean_log, n_unseen words and n_by_order (words scored
    by 1-grams, 2-grams, ...)."""
    spark = session(docs)
    n_groups = max(16, -(-docs.count() // DOCS_PER_GROUP))
    n_buckets = buckets(spark)
    base = docs.select(column(docs, id_col, "doc_id", "bigint"), column(docs, text_col, "text", "string"))
    base = base.select("doc_id", F.col("text").cast("binary").alias("text"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int").alias("grp"))
    asked = base.groupBy("grp").applyInPandas(
        _request(order, n_buckets), "bucket int, n int, grp int, keys binary, counts binary")
    answers = asked.groupBy("bucket", "n").applyInPandas(
        _count, "grp int, n int, bucket int, all long, totals binary")
    scored = base.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(
        _score(order, alpha), "doc_id long, n_words long, log_score_micro long, n_unseen long, n_by_order array<long>")
    return scored.withColumn("mean_log", F.col("log_score_micro") / 1e6 / F.nullif("n_words", F.lit(0)))
