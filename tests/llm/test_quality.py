"""The attention model against plain loops and differences, its sample, and
held-out accuracy."""

import math
import os
import random

import numpy as np
import pytest

from sitelens.llm import quality as Q

SF = "/root/testdata/sf0.01"


def _toy(seed=0):
    rng = np.random.default_rng(seed)
    model = Q.Attention(rng, Q.FEATURES)
    sizes = [3, 1, 5, 2]
    return model, rng.normal(size=(sum(sizes), Q.FEATURES)), np.repeat(np.arange(4), sizes), np.array([1.0, 0.0, 1.0, 0.0])


def test_forward_matches_a_loop():
    model, x, bag, y = _toy()
    w = {k: v.tolist() for k, v in model.w.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    got = model.forward(x, bag, 5)[0]
    for b in range(5):
        z = [[math.tanh(w["enc0"][j] + sum(row[i] * w["enc"][i][j] for i in range(Q.FEATURES))) for j in range(Q.HIDDEN)] for row in x[bag == b].tolist()]
        e = [sum(w["att"][k] * math.tanh(w["tanh0"][k] + sum(v[j] * w["tanh"][j][k] for j in range(Q.HIDDEN)))
                 * sig(w["gate0"][k] + sum(v[j] * w["gate"][j][k] for j in range(Q.HIDDEN))) for k in range(Q.ATTENTION)) for v in z]
        total = sum(math.exp(v) for v in e)
        m = [sum(math.exp(a) / total * v[j] for a, v in zip(e, z)) for j in range(Q.HIDDEN)] if z else [0.0] * Q.HIDDEN
        assert abs(got[b] - (w["out0"][0] + sum(m[j] * w["out"][j] for j in range(Q.HIDDEN)))) < 1e-9


def test_gradients_match_differences():
    model, x, bag, y = _toy(1)
    weight = np.array([0.1, 0.4, 0.2, 0.3])

    def loss():
        s = model.forward(x, bag, len(y))[0]
        return float(((np.logaddexp(0, s) - y * s) * weight).sum())
    grads, rng = model.gradients(x, bag, y, weight), random.Random(2)
    for name, w in model.w.items():
        for _ in range(4):
            at = tuple(rng.randrange(k) for k in w.shape)
            kept, eps = w[at], 1e-6
            w[at] = kept + eps
            up = loss()
            w[at] = kept - eps
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-6, name


def test_every_passage_is_learned_from():
    import pyarrow as pa
    long = " ".join(f"w{i}" for i in range(200 * Q.PASSAGE))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "y": pa.array([1, 0, 1], pa.int32()), "text": ["", long, "a b"]})
    got = [np.frombuffer(b).reshape(-1, Q.FEATURES) for part in Q._bags([batch]) for b in part.column(2).to_pylist()]
    assert [len(g) for g in got] == [0, 200, 1]
    assert np.array_equal(got[1], Q.passages([long.encode()])[0])


def test_model_is_the_same_whatever_the_order(spark):
    rng = random.Random(3)
    rows = [(i, ("plain words make text " if i % 2 else "## $$ %% ") * rng.randint(1, 40), "c", "d") for i in range(60)]
    rows += [(i, "another text of the same id", "e", "f") for i in range(0, 60, 7)] + [(None, "x", "", ""), (3, None, "", "")]
    labels = [(i, i % 2) for i in range(60)] + [(4, 1), (9, 0)]
    models = []
    for seed in (1, 2):
        rng.seed(seed)
        a, b = rng.sample(rows, len(rows)), rng.sample(labels, len(labels))
        docs = spark.createDataFrame(a, "doc_id long, text string, y string, order string").repartition(seed + 2)
        models.append(Q.train(docs, spark.createDataFrame(b, "doc_id long, quality int").repartition(seed)).w)
    assert all(np.array_equal(models[0][k], models[1][k]) for k in models[0])
    few = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), sample_bytes=0)
    assert not any(few.w[k].any() for k in few.w if k != "out0")
    empty = docs.limit(0)
    assert Q.score(empty, few, carry=("y", "order")).count() == 0
    assert Q.train(empty, spark.createDataFrame([], "doc_id long, quality int")).w["out0"][0] == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy(spark):
    from sitelens.llm.queries import op7_quality_mil
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in op7_quality_mil(spark, SF).where("held_out").collect() if r.doc_id in labels]
    assert len(got) > 50 and sum(a == b for a, b in got) >= 0.97 * len(got)
