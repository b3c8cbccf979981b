"""Merkle audit: brute force, equal replicas, odd rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sitelens.llm import warc

SCHEMA = "file string, offset long, record string, node long, hash string, name string"


def frame(spark, rows):
    """Extra columns bear the names that the audit uses itself."""
    return warc.leaves(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA))


def brute(one, other):
    def places(rows):
        out = defaultdict(list)
        for f, o, r in rows:
            if f is not None and o is not None:
                out[f, o].append(r or "")
        return {k: sorted(v) for k, v in out.items()}
    a, b = places(one), places(other)
    return {(*k, "missing" if k not in b else "extra" if k not in a else "corrupt")
            for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def found(df):
    rows = [(r.file, r.offset, r.kind) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_equals_brute_force(spark):
    rnd = random.Random(5)
    # A third of all records in one file, whose offsets span every level.
    one = [("hot" if i % 3 == 0 else f"f{i % 40}", i * 90_001 % (1 << 36), f"r{i}") for i in range(900)]
    one += [(None, 3, "x"), ("f1", None, "x"), ("f1", 5, None), ("f2", 7, "twice"), ("f2", 7, "twice"), ("f3", 9, "é" * 300_000)]
    other = [(f, o, r if rnd.random() > 0.03 else f"{r}!") for f, o, r in one if rnd.random() > 0.03]
    other += [("f4", 11, "new"), ("f2", 7, "twice"), ("only", 0, "b")]
    assert found(warc.audit(frame(spark, one), frame(spark, other))) == brute(one, other)
    assert found(warc.audit(frame(spark, other), frame(spark, one))) == brute(other, one)


def test_records_are_hashed_once(spark):
    rows = [(f"f{i % 5}", i * 1000, f"r{i}") for i in range(200)]
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        def note(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        df = spark.createDataFrame(rows, "file string, offset long, record string").mapInArrow(
            note, "file string, offset long, record string")
        return warc.leaves(df)

    assert warc.audit(counted(rows), counted(rows[::-1])).count() == 0
    assert seen.value == 400
    changed = [(f, o, "bad" if o == 7000 else r) for f, o, r in rows]
    got = warc.audit(counted(rows), counted(changed)).collect()
    assert [(r.offset, r.kind) for r in got] == [(7000, "corrupt")] and seen.value == 800


def test_empty_replicas(spark):
    rows = [("f", 0, "a"), ("g", 4, None)]
    none = frame(spark, rows).limit(0)
    assert found(warc.audit(frame(spark, rows), none)) == {("f", 0, "missing"), ("g", 4, "missing")}
    assert found(warc.audit(none, frame(spark, rows))) == {("f", 0, "extra"), ("g", 4, "extra")}
    assert warc.audit(none, none).count() == 0
    assert warc.audit(none, none).schema.simpleString() == warc.audit(frame(spark, rows), none).schema.simpleString()
