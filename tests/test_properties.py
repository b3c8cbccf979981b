"""Properties over the driver tables."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def driver_audit(spark):
    from sitelens.plans.audit import run_audit
    from sitelens.sources import driver as D
    return run_audit(D.site_files_table(spark, SF).checkpoint(eager=True))


def test_routes_unique_and_ordered(driver_audit):
    r = driver_audit.routes
    assert r.groupBy("project_id", "path").count().where("count > 1").count() == 0
    orders = r.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.min("route_order").alias("lo"),
                                         F.max("route_order").alias("hi"),
                                         F.countDistinct("route_order").alias("d")).collect()
    assert all(o.lo == 1 and o.hi == o.n == o.d for o in orders)


def test_scores_in_range_and_gate(driver_audit):
    rows = driver_audit.score.collect()
    for r in rows:
        if r.status == "ok":
            assert 0 <= r.seo_score <= 100 and r.gate in (0, 2)
        else:
            assert r.gate == 1 and r.seo_score is None


def test_chunks_cover_files_once(driver_audit):
    from sitelens.functions import constants as C
    ch = driver_audit.chunks
    assert ch.count() == driver_audit.sources.count()
    assert ch.select("project_id", "path").distinct().count() == ch.count()
    over = (ch.groupBy("project_id", "part_number").agg(F.count(F.lit(1)).alias("files"),
                                                        F.max("part_chars").alias("chars"))
            .where((F.col("chars") > C.DEFAULT_CHUNK_TARGET_CHARS) & (F.col("files") > 1)))
    assert over.count() == 0


def test_ttl_outcomes_partition_requests(spark):
    from sitelens.operators import traffic as T
    from sitelens.sources import driver as D
    req = D.requests_table(spark, SF)
    out = T.ttl_outcomes(req)
    log = T.render_log(req)
    assert out.count() == log.count()
    assert out.select("event_id").distinct().count() == out.count()
    kinds = {r.outcome for r in out.select("outcome").distinct().collect()}
    assert kinds <= {"HIT", "MISS", "ERROR"}
    m = T.service_metrics(req).agg(F.sum("render_count").alias("r"), F.sum("cache_hit_count").alias("h")).collect()[0]
    assert m.r + m.h == log.count()


def test_document_chunks_respect_target(spark):
    from sitelens.operators.chunks import chunk_files
    from sitelens.sources import driver as D
    docs = D.read_table(spark, SF, "documents").select(
        F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("path"),
        F.col("text").alias("content"))
    target = 20_000
    ch = chunk_files(docs, target)
    assert ch.count() == docs.count()
    bad = (ch.groupBy("project_id", "part_number").agg(F.count(F.lit(1)).alias("n"), F.max("part_chars").alias("c"))
           .where((F.col("c") > target) & (F.col("n") > 1)))
    assert bad.count() == 0
