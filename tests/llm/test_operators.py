"""Training-data operators against brute force, and on the odd cases: nulls,
empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import bpe, decontaminate, hnsw, html_blocks, lm_backoff, minhash, quality, shard, substring_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))
    passage, base = say(70), say(300).split()
    near = [" ".join(base[:i] + ["other"] + base[i + 1:]) for i in (20, 150, 250)]
    return [None, "", " \t\n", "Hello", "hello", " ".join(base), *near, " ".join(base), say(30) + " " + passage + "\n" + say(40),
            passage + " " + say(20), say(80) + " " + passage, "one two three four", "ONE two three four", "x" * 5000 + " " + say(20), "For " * 400, say(3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(_texts())] + [(None, "Hello", "en", "s", 0), (3, "Hello", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def _words(t, lower=False):
    raw = (t or "").encode()
    return (raw.lower() if lower else raw).split()


def test_substring_dedup(docs, spark):
    got = {(r.doc_id, r.carried.text): r for r in substring_dedup.substring_dedup(docs, carry=("text", "n_chars")).collect()}
    rows = [(r.doc_id, _words(r.text), r.text) for r in docs.collect()]
    least = {}
    for d, w, _ in rows:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i:i + 50])
                least[k] = min(least.get(k, d), d)
    some = 0
    for d, w, t in rows:
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i:i + 50])] < d:
                keep[i:i + 50] = [False] * 50
        r = got[(d, t)]
        some += r.n_removed
        assert (r.n_words, r.n_removed) == (len(w), len(w) - sum(keep))
        assert r.kept_text.encode() == b" ".join(x for x, k in zip(w, keep) if k)
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert some > 100
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, window=40, block=25)


def test_near_duplicates(docs, spark):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    sets = []
    for r in docs.collect():
        w = _words(r.text, True)
        sets.append((r.doc_id, frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    comp = list(range(len(sets)))
    for _ in sets:
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = []
    for i, (d, s) in enumerate(sets):
        least = min((e for k, (e, _) in enumerate(sets) if comp[k] == comp[i] and e is not None), default=None) if s else d
        want.append((d, len(s), least, d == least))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bpe_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = _texts() + ["a" * 3000, " " * 900 + "x" + "'" * 300 + " 'll " * 90, "é" * 700 + " 12 " * 90 + "\n\n\n" * 99 + "日本" * 300, "<|endoftext|>"] * 2
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    for step, overlap in ((bpe.STEP, bpe.OVERLAP), (200, 16)):
        rows = bpe.encode(frame, path, P.PATTERN, step=step, overlap=overlap, decoded="decoded").collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert list(r.tokens) == enc.encode_ordinary(texts[r.doc_id] or "")
            assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.key == "clash"
    assert bpe.decode(spark.createDataFrame([(1, None)], "i int, tokens array<int>"), path).first().decoded == b""
    assert bpe.encode(frame.limit(0), path, P.PATTERN).count() == 0


def test_warc_audit(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"http://x/{i}", "p" * (i * 997 % 5000)) for i in range(300)]
    base = spark.createDataFrame(rows, "file string, record_id long, url string, html string")
    body = base.withColumn("record", warc.record(F.col("url"), F.col("html")))
    a = warc.place(body.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", F.sha2("record", 256)))
    a = a.select("file", "offset", "record", "record_id")
    b = a.where("record_id <> 7").withColumn("record", F.when(F.col("record_id") == 100, F.lit(None)).otherwise(F.col("record")))
    leaf_a, leaf_b = (warc.leaves(x) for x in (a, b))
    got = {r.kind: (r.file, r.offset) for r in warc.audit(leaf_a, leaf_b).collect()}
    at = {r.record_id: (r.file, r.offset) for r in a.collect()}
    assert got == {"missing": at[7], "corrupt": at[100]}
    assert [r.kind for r in warc.audit(leaf_b, leaf_a).collect()].count("extra") == 1
    assert warc.audit(leaf_a, leaf_a).count() == 0
    assert warc.audit(leaf_a, leaf_a.limit(0)).count() == 300
    one = "".join(r.record for r in a.where("file = 'f1'").orderBy("offset").collect()).encode()
    (tmp_path / "f1.warc").write_bytes(one)
    read = warc.read_warc(spark, str(tmp_path / "f1.warc")).orderBy("offset").collect()
    assert b"".join(bytes(r.record) for r in read) == one and len(read) == 100


def test_decontaminate(spark):
    items = [(0, "Mary had 12 apples and gave Tom 5 apples, so Mary kept 7 of the 12 apples in her basket."), (1, None), (2, ""), (3, "two words")]
    texts = {1: "We know that Mary had 33 apples and gave Bob 9 apples, so Mary kept 24 of the 33 apples in her basket. ok",
             2: "We know that Mary had 33 apples and gave Bob 9 apples, so Mary kept 24 of the 31 apples in her basket. ok",
             3: None, 4: "", 5: "nothing here " * 50, 6: items[0][1].upper()}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 64):
        got = {r.doc_id: [(m.item_id, m.n_changed > 0) for m in r.matches] for r in decontaminate.flag(docs, bench, block_bytes=block_bytes).collect()}
        assert got[1] == [(0, True)] and not any(got[i] for i in (2, 3, 4, 5))
    assert decontaminate.flag(docs, bench.limit(0)).where("size(matches) > 0").count() == 0
    assert decontaminate.flag(docs.limit(0), bench).count() == 0


def _found(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: {m.item_id: m for m in r.matches} for r in decontaminate.flag(docs, bench).collect()}


def test_decontaminate_conflicts_take_only_their_windows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    for at, n in ((20, "5"), (60, "17"), (100, "3"), (140, "17"), (180, "5")):
        words[at] = n
    one, same, none = list(words), list(words), list(words)
    one[140] = "18"
    for at, n in ((20, "4"), (60, "9"), (100, "4"), (140, "9"), (180, "4")):
        same[at] = n
    for at in range(0, 200, 4):
        none[at] = "x"
    got = _found(spark, [" ".join(words)], [" ".join(x) for x in (one, same, none)])
    assert got[0][0].n_covered > 180 and got[1][0].n_covered > 180 and got[1][0].n_changed > 0 and not got[2]


def test_decontaminate_names_in_any_case_and_place(spark):
    janet = "Janet has 5 ducks. Janet sells 3 eggs daily. Janet buys 2 hens weekly. Janet then keeps 9 eggs."
    mary = "Mary had 12 apples and gave Tom 5 apples, so Mary kept 7 of the 12 apples in her basket."
    other = "Maria has 6 ducks. Maria sells 4 eggs daily. Maria buys 7 hens weekly. Maria then keeps 8 eggs."
    bare = lambda t: t.replace(".", "").replace(",", "")
    texts = [other, bare(other), janet.upper(), mary.upper(), mary.lower(), bare(mary), bare(janet), "Zoe " * 30]
    got = _found(spark, [janet, mary], texts)
    assert [sorted(got[d]) for d in range(len(texts))] == [[0], [0], [0], [1], [1], [1], [0], []]
    assert all(m.n_covered == m.n_item for found in got.values() for m in found.values())
    assert got[0][0].n_changed == 8 and got[3][1].n_changed == 0


def test_decontaminate_few_literals_short_and_unspaced(spark):
    items = ["Barack Obama, Angela Merkel, Emmanuel Macron, Justin Trudeau, Shinzo Abe, Theresa May", "12 + 7 = 19, 8 kg = 8000 g, 3 4 5 6 7 8 9 10",
             "blue whale", "42", "\u5c0f\u660e\u67095\u4e2a\u82f9\u679c\uff0c\u4ed6\u7ed9\u4e86\u5c0f\u7ea22\u4e2a\u3002", "\uff0c\u3002"]
    texts = ["We met " + items[0].lower() + " there", "so 12 + 7 = 19, 8 kg = 8000 g, 3 4 5 6 7 8 9 10!", "so 13 + 9 = 21, 7 kg = 7000 g, 4 3 5 6 7 8 9 11!",
             "the Blue whale sings to a blue whale", "It is 42.", "\u6211\u4eec\u77e5\u9053" + items[4].replace("5", "7") + "\u597d", "a blue one, 420 whales"]
    got = _found(spark, items, texts)
    assert [sorted(got[d]) for d in range(len(texts))] == [[0], [1], [], [2], [3], [4], []]
    assert (got[3][2].start, got[3][2].end, got[5][4].n_changed) == (1, 8, 1)
    assert all(m.n_covered == m.n_item for found in got.values() for m in found.values())


def test_sketch_filter_keeps_pairs_near_the_threshold():
    import math

    import pyarrow as pa

    n, p, least = minhash.REGISTERS, minhash.THRESHOLD / 100, minhash._cutoff(minhash.THRESHOLD)
    lost = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(math.ceil(least * n)))
    assert lost < 1e-8  # far below the banding's loss
    a = np.zeros(n, np.uint8)
    b = (np.arange(n) >= 235).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "n_a": [400], "n_b": [400], "sketch_a": [a.tobytes()], "sketch_b": [b.tobytes()]})
    assert next(minhash._likely(minhash.THRESHOLD)([batch])).num_rows == 1


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = [c + rng.normal(size=16) * 0.05 for c in centres for _ in range(8)] + [rng.normal(size=16) for _ in range(100)]
    x += [x[0], x[0] * 3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] * 16), (904, [float("nan")] * 16), (905, [1.0, 2.0])]
    got = {r.vec_id: r for r in hnsw.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * (near.sum() - len(x)) <= found <= near.sum() - len(x)
    assert got[len(x) - 1].component_id == 0 and not got[len(x) - 1].kept
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _ in odd)


def test_near_vectors_audit_counts_queries():
    x = np.zeros((800, 16), np.float32)
    x[:500, 0] = 1  # one large group, and pairs
    x[np.arange(500, 800), 1:] = np.repeat(np.random.default_rng(4).normal(size=(150, 15)), 2, axis=0)
    x /= np.linalg.norm(x, axis=1)[:, None]

    class Poor(hnsw.Graph):
        def __init__(self):
            self.x, self.beam = x, 16

        def near(self, q, least, beam=None):
            hit = [np.flatnonzero(r @ x.T >= least) for r in q]
            return [h if len(h) > 100 or self.beam >= 64 else h[:0] for h in hit]

    own, other = Poor(), Poor()
    assert own.audit(0.9, 0.99) == 1 and own.beam >= 64
    other.x = x[:500]  # its own nodes are all of the large group
    other.near = lambda q, least: [np.arange(500) if r[0] > 0.9 or other.beam >= 64 else np.zeros(0, int) for r in q]
    near = x[:1] + 0.3 * x[600:601]
    other.audit(0.9, 0.99, near / np.linalg.norm(near))
    assert other.audit(0.9, 0.99) == 1


def test_quality(spark):
    good, bad = "plain words make a good text here. ", "#### $$$$ %%%% &&&& "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 9)) for i in range(240)]
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(5, None), (6, 7), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels), out="text_score").withColumnRenamed("text_score", "score").collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(240)) and 0 <= got[900] == got[901] <= 1
    assert quality.score(docs, quality.train(docs, labels.limit(0))).first().score == pytest.approx(0.5)


def test_html(spark):
    page = ('<html><head><style>p{}</style></head><body><nav class="menu"><ul><li><a href="/">Home</a></li></ul></nav>'
            '<article><h1>A &amp; title</h1><p><b>First\n  words.<br><p>Second &lt;b&gt; &#233; here.</p></article>'
            '<div class="comments"><p>Nice post!</p></div><footer>&copy; us</footer><script>var a="</p>"</script></body></html><di')
    rows = [(1, page), (2, None), (3, ""), (4, "<p"), (5, "<!-- open")]
    got = {r.page_id: r.text for r in html_blocks.extract_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: "A & title First words. Second <b> é here.", 2: "", 3: "", 4: "", 5: ""}
    model, rng, right, total = html_blocks.trained(), np.random.default_rng(77), 0, 0
    for _ in range(60):
        made, truth = html_blocks.make_page(rng)
        found = html_blocks.blocks(made)
        right += int((model.label([found])[0] == np.array(truth)).sum()) if found else 0
        total += len(truth)
    assert right / total > 0.95


def test_html_features_read_all_words_and_elements_end_at_their_tag():
    lead = " ".join(f"w{i}" for i in range(24))
    a, b = (html_blocks.features([((0, 0), f"{lead} {tail}", 0, 0)])[0] for tail in ("alpha beta gamma delta", "one two three four"))
    words = slice(html_blocks.PATH, html_blocks.PATH + html_blocks.TEXT)
    assert (a[words] != b[words]).any() and a[words].sum() == pytest.approx(1)
    page = '<p>one</p><svg width="1"/><p>two</p><iframe src="x"><p>three</p><object><p>four</p></object><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><text>no</text></svg><script>var a'
    assert [t for _, t, _, _ in html_blocks.blocks(page)] == ["one", "two", "three", "four", "so x=2 holds"]


def test_backoff(docs):
    got = Counter((r.doc_id, r.n_words, r.log_score_micro) for r in lm_backoff.backoff_scores(docs).collect())
    rows = [(r.doc_id, _words(r.text)) for r in docs.collect()]
    total = Counter()
    for _, w in rows:
        total.update(zip(w))
        total.update(zip(w, w[1:]))
    n, want = sum(len(w) for _, w in rows), Counter()
    for d, w in rows:
        own, s = Counter(zip(w)) + Counter(zip(w, w[1:])), 0
        rest = n - len(w)
        for i, x in enumerate(w):
            both, one = total[(w[i - 1], x)] - own[(w[i - 1], x)] if i else 0, total[(x,)] - own[(x,)]
            p = both / (total[(w[i - 1],)] - own[(w[i - 1],)]) if both else (0.4 if i else 1) * (one / rest) if one else 0.4 ** (2 if i else 1) / (rest + 1)
            s += round(np.log(p) * 1e6)
        want[(d, len(w), s)] += 1
    assert got == want


def test_shards(docs, spark):
    rows = shard.uniform_shards(docs.select("doc_id", "text"), [F.col("doc_id"), F.crc32(F.col("text").cast("binary"))], 8).collect()
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(v == list(range(len(v))) for v in slots.values()) and len(rows) == docs.count()
    assert shard.uniform_shards(docs.limit(0), [F.col("doc_id")]).count() == 0
    drawn = shard.matrix([100, 0, 57], shard.shard_sizes(157, 8), 1)
    assert [sum(r) for r in drawn] == [100, 0, 57] and [sum(c) for c in zip(*drawn)] == shard.shard_sizes(157, 8)
    rng = np.random.default_rng(0)
    assert abs(np.mean([shard.hypergeometric(rng, 30, 70, 20) for _ in range(3000)]) - 6) < 0.15


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        assert name == "byte_bpe" or out.columns == docs.columns
        docs = out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([labels[d] == (d in kept["quality"]) for d in labels]) > 0.95
    assert kept["near_dedup"] <= kept["quality"] and kept["substring_dedup"] == kept["near_dedup"]
    assert kept["decontamination"] <= kept["near_dedup"] and kept["byte_bpe"] == kept["decontamination"]
    row = docs.first()
    assert row.n_tokens == len(row.tokens) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, row.tokens)).encode()).hexdigest()
