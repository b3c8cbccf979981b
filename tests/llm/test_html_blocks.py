"""The block labeller: the network against plain loops, long sequences in
pieces, time and memory that grow with the page."""

import math
import random
import time

import numpy as np
import pytest

from sitelens.llm import html_blocks as H


def _loop(model, x):
    """Scores of one page, one number at a time."""
    def direction(d, rows):
        w, u, b = (model.w[k + d].tolist() for k in "xho")
        h, c, out = [0.0] * H.HIDDEN, [0.0] * H.HIDDEN, []
        sig = lambda v: 1 / (1 + math.exp(-v))
        for row in rows:
            z = [b[j] + sum(row[i] * w[i][j] for i in range(H.WIDTH) if row[i]) + sum(h[i] * u[i][j] for i in range(H.HIDDEN)) for j in range(4 * H.HIDDEN)]
            n = H.HIDDEN
            c = [sig(z[k]) * c[k] + sig(z[n + k]) * math.tanh(z[3 * n + k]) for k in range(n)]
            h = [sig(z[2 * n + k]) * math.tanh(c[k]) for k in range(n)]
            out.append(h)
        return out
    rows = x.tolist()
    f, b = direction("f", rows), direction("b", rows[::-1])[::-1]
    o, skip = model.w["out"].tolist(), model.w["skip"].tolist()
    return [sum(v * k for v, k in zip(f[t] + b[t], o)) + sum(v * k for v, k in zip(rows[t], skip)) + float(model.w["bias"][0]) for t in range(len(rows))]


def _pages(n, seed=3):
    rng = np.random.default_rng(seed)
    return [H.blocks(H.make_page(rng)[0]) for _ in range(n)]


def test_network_matches_a_loop():
    model = H.Labeller(np.random.default_rng(1))
    pages = [p for p in _pages(6) if 0 < len(p) < 40][:3]
    x, mask = H._pad([H.features(p) for p in pages])
    scores = model.forward(x, mask)[0]
    for k, p in enumerate(pages):
        assert np.allclose(scores[:len(p), k], _loop(model, H.features(p)), atol=1e-9)
        for step in (1, 5, 1000):
            assert np.allclose(model._long(p, step), scores[:len(p), k], atol=1e-9)


def test_gradients_match_differences():
    model = H.Labeller(np.random.default_rng(2))
    pages = [p for p in _pages(8, 5) if 0 < len(p) < 25][:2]
    x, mask = H._pad([H.features(p) for p in pages])
    y = np.random.default_rng(0).integers(0, 2, mask.shape).astype(float)

    def loss():
        s = model.forward(x, mask)[0]
        return float((np.logaddexp(0, s) - y * s)[mask].sum() / mask.sum())
    grads, rng = model.gradients(x, mask, y), random.Random(1)
    for name, w in model.w.items():
        for _ in range(3):
            at = tuple(rng.randrange(k) for k in w.shape)
            kept, eps = w[at], 1e-6
            w[at] = kept + eps
            up = loss()
            w[at] = kept - eps
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-5, name


def test_long_pages_are_labelled_like_short_ones(monkeypatch):
    model, pages = H.trained(), _pages(12)
    want = model.label(pages)
    monkeypatch.setattr(H, "CELLS", 8)
    assert all((a == b).all() for a, b in zip(model.label(pages), want))


@pytest.mark.parametrize("unit", ["<div>a", "<foo>a", "<p>a<svg>", "<foo><hr>a", "<ul><li>x", "<table><tr><td>x", "<a \">x", "<p>a<textarea>", "</div>a<div>",
                                  "<!-- ", "<p><b>x", "<a '>", "<p class='a b'>x"])
def test_parsing_is_linear(unit):
    def cost(n):
        t0 = time.process_time()
        H.features(H.blocks(unit * (n // len(unit))))
        return time.process_time() - t0
    cost(1000)
    one, two = cost(100_000), cost(200_000)
    assert two < 3 and two < 3 * one + 0.1


def test_a_megabyte_of_open_elements_ends():
    model = H.Labeller(np.random.default_rng(0))
    t0 = time.time()
    H.extract("<div>a" * (1 << 16), model)
    assert time.time() - t0 < 20


def test_elements_close_each_other():
    texts = lambda p: [(b[1], b[0][1]) for b in H.blocks(p)]
    assert texts("<p>a<p>b<div>c</p>d") == [("a", 1), ("b", 1), ("cd", 1)]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == [("a", 3), ("b", 3), ("c", 3), ("d", 0)]
    assert texts("<ul><li>a<ul><li>b</ul><li>c") == [("a", 2), ("b", 4), ("c", 2)]
    assert texts("<foo>a<p>b<hr>c") == [("a", 1), ("b", 2), ("c", 1)]
    assert texts("<td>a<div><tr>b") == [("a", 1), ("b", 3)]


def test_rows_of_any_kind(spark):
    page = "<html><body><article><h1>Title of it</h1><p>Some words stand here.</p></article></body></html>"
    rows = [(1, page, "x", "y"), (1, page, "x", "z"), (2, None, None, None), (3, "", "", ""), (None, page * 3, "r", "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, row string, text string")
    got = H.extract_text(df, carry=("page_id", "row", "text"), out="found").collect()
    assert sorted((r.page_id or 0, r.row or "", r.text or "") for r in got) == sorted((a or 0, c or "", d or "") for a, _, c, d in rows)
    assert len({r.found for r in got if r.page_id == 1}) == 1 and [r.found for r in got if r.page_id in (2, 3)] == ["", ""]
    assert H.extract_text(df.limit(0), carry=("page_id",)).count() == 0


@pytest.mark.parametrize("bounds", [(1, 1), (40, 10**9), (10**9, 2000)])
def test_batches_are_bounded(monkeypatch, bounds):
    import pyarrow as pa
    monkeypatch.setattr(H, "BATCH_BLOCKS", bounds[0])
    monkeypatch.setattr(H, "BATCH_BYTES", bounds[1])
    rng, model = np.random.default_rng(4), H.trained()
    pages = [H.make_page(rng)[0] for _ in range(9)] + [None, ""]
    got = list(H._together(pa.array(pages, pa.string()), model))
    assert [t for _, part in got for t in part] == [H.extract(p, model) for p in pages]
    assert [a for a, _ in got] == [sum(len(p) for _, p in got[:i]) for i in range(len(got))]
