import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stream_ttl_equals_batch(spark):
    from sitelens.operators import traffic as T
    from sitelens.sources import driver as D
    from sitelens.streaming import streams as ST
    src = ST.stage_events(spark, D.read_table(spark, SF, "events"))
    got = {(r.event_id, r.outcome) for r in ST.run_ttl(spark, ST.request_stream(spark, src)).collect()}
    want = {(r.event_id, r.outcome) for r in T.ttl_outcomes(D.requests_table(spark, SF)).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stream_multi_batch_in_order(spark):
    """Files landed one after another replay in event-time order across
    micro-batches; anchored TTL state carries between batches."""
    from pyspark.sql import functions as F
    from sitelens.operators import traffic as T
    from sitelens.sources import driver as D
    from sitelens.streaming import streams as ST
    ev = D.read_table(spark, SF, "events")
    src = ST.scratch(spark, "ordered")
    days = [r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()][:6]
    sub = ev.where(F.to_date("ts").isin(days))
    for d in days:
        sub.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(src)
    stream = ST.request_stream(spark, src, max_files=1)
    got = {(r.event_id, r.outcome) for r in ST.run_ttl(spark, stream).collect()}
    req = D.requests_table(spark, SF).where(F.to_date("ts").isin(days))
    want = {(r.event_id, r.outcome) for r in T.ttl_outcomes(req).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stream_hourly_metrics_multi_batch(spark):
    """Ordered multi-batch replay with an advancing watermark: the last
    update of every hourly window equals the batch hourly counts."""
    from pyspark.sql import functions as F
    from sitelens.functions import columns as X
    from sitelens.sources import driver as D
    from sitelens.streaming import streams as ST
    ev = D.read_table(spark, SF, "events")
    src = ST.scratch(spark, "hourly")
    days = [r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()][:4]
    for d in days:
        ev.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(src)
    out = ST.run_to_table(spark, ST.hourly_metrics(ST.request_stream(spark, src, max_files=1)), "h", mode="update")
    assert out.select("_batch").distinct().count() >= 2
    got = {(r.hour, r.requests, r.bot_requests) for r in ST.latest_versions(out, ["hour"]).collect()}
    req = D.requests_table(spark, SF).where(F.to_date("ts").isin(days))
    want = {(r.hour, r.requests, r.bot_requests) for r in req.groupBy(
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(X.is_bot("user_agent")).alias("bot_requests")).collect()}
    assert got == want


def _loop(rows, held, ttl):
    """The rule row by row: (outcomes, anchors) after rows (t, id, forced, ok,
    inv) of each key."""
    out, state = {}, dict(held)
    for k, t, i, forced, ok, inv in sorted(rows, key=lambda r: (r[1], r[2])):
        anchor, gone = state.get(k, (None, None))
        if anchor is not None and gone is not None and anchor <= gone < t:
            anchor = None
        if not forced and anchor is not None and t - anchor <= ttl:
            out[i] = "HIT"
        else:
            out[i] = "MISS" if ok else "ERROR"
            if ok:
                anchor = t if anchor is None else max(anchor, t)
        if inv:
            gone = t if gone is None else max(gone, t)
        state[k] = (anchor, gone)
    return out, state


@pytest.mark.parametrize("seed", range(4))
def test_ttl_step_matches_the_rule(spark, seed):
    """Batch after batch, rows late by some, against the rule; expired anchors
    leave the carried table."""
    import random
    from sitelens.streaming import streams as ST
    rng = random.Random(seed)
    schema = "cache_key string, t long, id long, forced boolean, ok boolean, inv boolean"
    held, state, latest = spark.createDataFrame([], ST.ANCHORS), {}, 0
    for batch in range(3):
        start = 400 * batch
        rows = [(rng.choice("hhhhab"), rng.randint(max(0, start - 60), start + 399), 1000 * batch + i,
                 rng.random() < 0.05, rng.random() < 0.8, rng.random() < 0.03) for i in range(150)]
        want, state = _loop(rows, state, 70)
        done = ST.ttl_step(spark.createDataFrame(rows, schema).repartition(3), held, 70).checkpoint()
        assert {r.event_id: r.outcome for r in done.collect()} == want
        held = ST.next_anchors(done, held, 70).checkpoint()
        latest = max([latest, *[r[1] for r in rows]])
        got = {r.cache_key: (r.anchor, r.gone) for r in held.collect()}
        assert got.pop(None) == (latest, None)
        # A deleted anchor may stay in the table with its deletion: it answers nothing.
        good = {k: a for k, (a, g) in state.items() if a is not None and a + 70 >= latest and (g is None or g < a)}
        assert {k: a for k, (a, g) in got.items() if g is None or g < a} == good
        assert all(a + 70 >= latest for a, _ in got.values())
        state = {k: v for k, v in state.items() if v[0] is not None and v[0] + 70 >= latest}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_live_snapshots_are_the_same_in_one_and_many_batches(spark):
    from pyspark.sql import functions as F
    from sitelens.operators import traffic as T
    from sitelens.sources import driver as D
    from sitelens.streaming import streams as ST
    ev = D.read_table(spark, SF, "events")
    days = [r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()][:6]
    src = ST.scratch(spark, "live-src")
    for d in days:
        ev.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(src)
    one, many = ({tuple(r) for r in ST.run_snapshots(spark, ST.request_stream(spark, src, max_files=n), ttl_seconds=36 * 3600).collect()} for n in (None, 1))
    req = D.requests_table(spark, SF).where(F.to_date("ts").isin(days))
    every = {(r.cache_key, r.norm_url, r.stored_event_id, r.stored_us) for r in T.snapshot_latest(req).collect()}
    now = max(r.t for r in T.render_log(req).where("ok").collect())
    assert one == many and 0 < len(one) < len(every) and one <= every
    assert all((r in one) == (r[3] + 36 * 3600 * 10**6 >= now) or r[3] + 36 * 3600 * 10**6 < now + 10**9 for r in every)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stream_dedup_is_the_same_in_one_and_many_batches(spark):
    from pyspark.sql import functions as F
    from sitelens.sources import driver as D
    from sitelens.streaming import streams as ST
    ev = D.read_table(spark, SF, "events")
    days = [r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()][:5]
    src = ST.scratch(spark, "dedup-src")
    for d in days:
        ev.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(src)
    one, many = (ST.run_dedup(spark, ST.request_stream(spark, src, max_files=n)) for n in (None, 1))
    assert many.select("_batch").distinct().count() >= 2
    assert one.drop("_batch").exceptAll(many.drop("_batch")).count() == 0 == many.drop("_batch").exceptAll(one.drop("_batch")).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    from sitelens.plans import catalog
    from sitelens.sources import driver as D
    D.read_table(spark, SF, "events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_bot_tags", "stream_ttl"):
        want, got = (catalog.STREAMING[name](spark, sf) for sf in (SF, str(tmp_path)))
        assert want.count() > 0 and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_rows_later_than_the_ttl_are_answered(spark):
    from pyspark.sql import functions as F
    from sitelens.sources import driver as D
    from sitelens.streaming import streams as ST
    ev = D.read_table(spark, SF, "events")
    days = [r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    src = ST.scratch(spark, "late-src")
    sent = [days[4], days[5], days[0]]
    for d in sent:
        ev.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(src)
    out = ST.run_ttl(spark, ST.request_stream(spark, src, max_files=1))
    from sitelens.functions import columns as X
    want = D.requests_table(spark, SF).where(F.to_date("ts").isin(sent) & X.url_ok("url"))
    assert {r.event_id for r in out.collect()} == {r.event_id for r in want.collect()}
    assert out.select("_batch").distinct().count() >= 3
