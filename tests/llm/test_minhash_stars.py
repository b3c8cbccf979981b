"""Near duplicates across the components of a star: brute force and sizes."""

import random

from sitelens.llm import minhash


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    found = [(d, sets(t)) for d, t in rows]
    label = {i: i for i in range(len(rows))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(found):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, (d, s) in enumerate(found))


def test_mixed_stars_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 8)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        # Copies of one text with edits at few or many places: similarities from 0.4 to 1.
        w = list(base)
        for p in rnd.sample(range(90), rnd.choice([0, 1, 1, 2, 3, 4])):
            w[p] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(150, ""), (151, None), (152, "one two"), (153, "ONE  two"), (154, "é " * 30_000)]
    df = spark.createDataFrame([(*r, 5, "s", 1) for r in rows], "doc_id long, text string, node long, sketch string, a int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == brute(rows)
    assert len({c for _, _, c, _ in got}) > 6


def test_one_stranger_makes_linear_rows(spark):
    m = 5000
    pairs = spark.range(1, m + 1).selectExpr("0L AS a", "id AS b")
    labels = spark.range(0, m).selectExpr("id", "0L AS component")
    told = minhash._blocks(pairs, labels, 128)
    k = -(-(m + 1) // 128)
    assert told.count() == m + 1 + k
    assert told.where(f"role = {minhash.LEAD}").select("node").distinct().collect()[0][0] == m
    assert told.groupBy("a", "block", "against").count().agg({"count": "max"}).first()[0] < 2 * 128
    assert minhash._blocks(pairs.where(f"b < {m}"), labels, 128).count() == 0


def test_every_pair_across_components_meets_once(spark):
    rnd = random.Random(3)
    of = {i: rnd.choice([0, 0, 0, 7, 8, 9]) for i in range(1, 60)} | {0: 0}
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long")
    labels = spark.createDataFrame(list(of.items()), "id long, component long")
    cells = {}
    for r in minhash._blocks(pairs, labels, 8).collect():
        cells.setdefault((r.block, r.against), []).append(r)
    met = []
    for rows in cells.values():
        for x in (r for r in rows if r.role == minhash.LEAD):
            for y in rows:
                if of[x.node] != of[y.node] and (y.role == minhash.TARGET or y.role == minhash.STRANGER and y.node > x.node):
                    met.append(tuple(sorted((x.node, y.node))))
    assert sorted(met) == sorted((i, j) for i in of for j in of if i < j and of[i] != of[j])
