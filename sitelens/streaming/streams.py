"""Structured Streaming forms of the traffic operators.

* T1 ``bot_tags``: stateless projection of the request stream.
* T3 ``hourly_metrics``: event-time hourly windows with a watermark, emitted
  in update mode; the sink keeps the last version of every window.
* T2/T5/T6 ``run_ttl``, ``run_dedup``: anchored-TTL HIT/MISS/ERROR under
  invalidations.  A micro-batch is the batch operator over its rows and the
  anchors that the last one left, so a hot key is spread over ranges here as
  well; the anchors are a small table that each batch replaces.
* T4/T6 ``snapshot_events``: successful renders and invalidations appended per
  batch.  ``run_snapshots`` folds them batch by batch into the live snapshots:
  the latest write per key wins, a later invalidation deletes it, and what is
  older than its TTL leaves.

Sources and sinks live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import columns as X
from sitelens.functions import constants as C
from sitelens.operators.prefix import chain, ranges
from sitelens.operators.traffic import MAX_ID
from sitelens.session import ensure_checkpoint_dir
from sitelens.sources.driver import REQUEST_COLUMNS

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"stream-{name}-{uuid.uuid4().hex[:12]}")


def stage_events(spark: SparkSession, events: DataFrame, files: int = 8) -> str:
    """Write ``events`` as time-range files under the shared checkpoint dir
    (the stream's landing folder)."""
    out = scratch(spark, "events")
    (events.repartitionByRange(files, "ts", "event_id").sortWithinPartitions("ts", "event_id")
     .write.mode("overwrite").parquet(out))
    return out


def request_stream(spark: SparkSession, src: str, max_files: int | None = None, name: str | None = None) -> DataFrame:
    """``requests`` over a file stream of events (``ts`` stays NTZ; ``ts_ltz``
    is the watermark column).  ``name`` picks files of the folder, ``max_files``
    bounds files per micro-batch;
    the file source orders files by modification time, so multi-batch replay
    is in event-time order only when the files were written in that order."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ev = reader.parquet(src)
    return ev.selectExpr(*REQUEST_COLUMNS).withColumn(
        "ts_ltz", F.timestamp_micros(X.epoch_us("ts")))


def bot_tags(stream: DataFrame) -> DataFrame:
    """T1."""
    return stream.select("event_id", "user_agent", X.is_bot("user_agent").alias("is_bot"))


def hourly_metrics(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Requests and crawler requests per event-time hour."""
    return (stream.withWatermark("ts_ltz", watermark)
            .groupBy(F.window("ts_ltz", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.count_if(X.is_bot("user_agent")).alias("bot_requests"))
            .select(F.date_format(X.ntz_from_micros(F.unix_micros(F.col("w.start"))), "yyyy-MM-dd HH:mm")
                    .alias("hour"), "requests", "bot_requests"))


# One row a key, and one without a key that holds the latest time seen.
ANCHORS = "cache_key string, anchor long, gone long"


def ttl_step(rows: DataFrame, anchors: DataFrame, ttl_us: int) -> DataFrame:
    """Outcomes of a micro-batch ``rows`` (cache_key, t, id, forced, ok, inv)
    after ``anchors``: the time of each key's stored snapshot and of its last
    invalidation.  Rows are applied in (time, id) order, deletes of a
    microsecond after its requests.

    Late rows: a row not newer than the stored snapshot is answered by what the
    cache holds, a HIT unless forced, and never moves the stored time back.
    """
    held = anchors.where("cache_key IS NOT NULL AND anchor IS NOT NULL").select("cache_key", "anchor", F.col("gone").alias("held_gone"))
    rows = rows.join(held, "cache_key", "left").withColumn("late", F.coalesce(F.col("t") <= F.col("anchor"), F.lit(False)))
    plain = rows.select("cache_key", "t", "id", "forced", "ok", "inv", "late", F.lit(False).alias("clear"), F.lit(True).alias("own"))
    marks = lambda t, **flags: (t.select("cache_key", "t", F.lit(MAX_ID).alias("id"), *[F.lit(v).alias(k) for k, v in flags.items()])
                                .withColumn("own", F.lit(False)))
    stored = marks(held.withColumn("t", F.col("anchor")), forced=True, ok=True, inv=False, late=False, clear=False)
    deletes = (rows.where("inv").select("cache_key", "t")
               .unionByName(anchors.where("cache_key IS NOT NULL AND gone >= anchor").select("cache_key", F.col("gone").alias("t"))))
    deletes = marks(deletes, forced=False, ok=False, inv=False, late=False, clear=True)
    log = plain.unionByName(stored).unionByName(deletes).withColumn("id", F.when(F.col("clear"), F.col("id")).otherwise(
        F.when(F.col("own"), F.col("id")).otherwise(F.lit(-MAX_ID))))
    # Late rows and late deletes change nothing: they stand before the stored snapshot.
    dealt = ranges(log, "cache_key", [F.col("t"), F.col("id")])
    goes = F.col("ok") & ~F.col("late")
    walked = chain(dealt, "cache_key", ["t", "id"], F.col("t"), F.col("t") + ttl_us, can=goes, must=goes & F.col("forced"),
                   clear=F.col("clear")).where("own")
    hit = ~F.col("forced") & (F.col("late") | F.coalesce(F.col("t") <= F.col("enters"), F.lit(False)))
    return walked.select(F.col("id").alias("event_id"), "cache_key", "t",
                         F.when(hit, "HIT").when(F.col("ok"), "MISS").otherwise("ERROR").alias("outcome"), "inv")


def next_anchors(outcomes: DataFrame, anchors: DataFrame, ttl_us: int) -> DataFrame:
    """The anchors after a batch; those whose TTL the latest time seen has
    passed can answer nothing more and leave."""
    seen = outcomes.agg(F.max("t").alias("t")).unionByName(anchors.where("cache_key IS NULL").select(F.col("anchor").alias("t")))
    now = seen.agg(F.max("t").alias("now"))
    both = (outcomes.select("cache_key", F.when(F.col("outcome") == "MISS", F.col("t")).alias("anchor"), F.when(F.col("inv"), F.col("t")).alias("gone"))
            .unionByName(anchors.where("cache_key IS NOT NULL")))
    live = (both.groupBy("cache_key").agg(F.max("anchor").alias("anchor"), F.max("gone").alias("gone"))
            .where(F.col("anchor") + ttl_us >= now.scalar()))
    return live.unionByName(now.select(F.lit(None).cast("string").alias("cache_key"), F.col("now").alias("anchor"), F.lit(None).cast("long").alias("gone")))


def _run_carried(spark: SparkSession, stream: DataFrame, name: str, schema: str,
                 step: Callable[[DataFrame, DataFrame], DataFrame], carry: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[str, str]:
    """Drive ``stream`` with a table carried from batch to batch: a batch's
    output is ``step(rows, carried)``, the next table ``carry(output, carried)``.

    The table has two places, used in turn, so a batch replayed after a failure
    finds what the batch before it left; output folders are replaced by id."""
    out, ckpt, at = scratch(spark, name), scratch(spark, name + "-ckpt"), scratch(spark, name + "-carried")
    none = spark.createDataFrame([], schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        place = lambda i: os.path.join(at, str(i % 2))
        held = own.read.schema(schema).parquet(place(batch_id - 1)) if batch_id else none
        folder = os.path.join(out, f"_batch={batch_id}")
        step(batch, held).write.mode("overwrite").parquet(folder)
        carry(own.read.parquet(folder), held).write.mode("overwrite").parquet(place(batch_id))

    (stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    return out, at


def _log(stream: DataFrame, forced: Column, ok: Column, inv: Column) -> DataFrame:
    return stream.where(X.url_ok("url")).select(
        X.cache_key("url").alias("cache_key"), X.epoch_us("ts").alias("t"), F.col("event_id").alias("id"),
        forced.alias("forced"), ok.alias("ok"), inv.alias("inv"))


def _run_walk(spark: SparkSession, log: DataFrame, name: str, ttl_seconds: int) -> DataFrame:
    ttl_us = ttl_seconds * 1_000_000
    out, _ = _run_carried(spark, log, name, ANCHORS, lambda rows, held: ttl_step(rows, held, ttl_us),
                          lambda done, held: next_anchors(done, held, ttl_us))
    return spark.read.option("basePath", out).parquet(out).drop("inv")


def run_ttl(spark: SparkSession, stream: DataFrame, name: str = "ttl", ttl_seconds: int = C.DEFAULT_TTL_SECONDS) -> DataFrame:
    """(event_id, cache_key, t, outcome) of every request."""
    return _run_walk(spark, _log(stream, F.coalesce("forced", F.lit(False)), F.col("status").isNotNull() & (F.col("status") < 400),
                                 F.coalesce(F.col("event_type") == "purchase", F.lit(False))), name, ttl_seconds)


def run_dedup(spark: SparkSession, stream: DataFrame, name: str = "dedup", ttl_seconds: int = C.DEFAULT_TTL_SECONDS) -> DataFrame:
    """T5: one render per cache key and TTL, whatever the micro-batches."""
    renders = _run_walk(spark, _log(stream, F.lit(False), F.lit(True), F.lit(False)), name, ttl_seconds)
    return renders.where("outcome = 'MISS'").select("event_id", "cache_key", "_batch")


def service_counters(outcomes: DataFrame) -> DataFrame:
    """Requests, renders, hits and errors per hour of the outcomes that
    the stream has landed."""
    return outcomes.groupBy(F.date_format(X.ntz_from_micros("t"), "yyyy-MM-dd HH:mm").substr(1, 13).alias("h")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("outcome") != "HIT").alias("render_count"),
        F.count_if(F.col("outcome") == "HIT").alias("cache_hit_count"),
        F.count_if(F.col("outcome") == "ERROR").alias("error_count")).select(
        F.concat("h", F.lit(":00")).alias("hour"), "requests", "render_count", "cache_hit_count", "error_count")


def snapshot_events(stream: DataFrame) -> DataFrame:
    """T4/T6 input: successful renders (writes) and purchases (invalidations)."""
    ok = F.col("status").isNotNull() & (F.col("status") < 400)
    inv = F.col("event_type") == "purchase"
    return (stream.where(X.url_ok("url") & (ok | inv))
            .select(X.cache_key("url").alias("cache_key"), X.epoch_us("ts").alias("t"),
                    F.col("event_id").alias("id"), X.url_normalize("url").alias("norm_url"),
                    ok.alias("is_write"), inv.alias("is_invalidation")))


# ------------------------------------------------------------- runners
def run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a streaming frame to completion (availableNow) into a Parquet
    folder under the shared checkpoint dir and read it back.

    Each micro-batch overwrites its own ``_batch=<id>`` folder, so a batch
    replayed after a failure replaces its earlier output (idempotent sink)."""
    out, ckpt = scratch(spark, name), scratch(spark, name + "-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    q = (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def latest_versions(table: DataFrame, key: list[str]) -> DataFrame:
    """Update-mode output: keep each key's row from the last batch."""
    cols = [c for c in table.columns if c not in key + ["_batch"]]
    return (table.groupBy(*key).agg(F.max_by(F.struct(*cols), "_batch").alias("v"))
            .select(*key, "v.*"))


SNAPSHOTS = "cache_key string, w struct<t:long,id:long,norm_url:string>, inv_us long"


def fold_snapshots(events: DataFrame, held: DataFrame, ttl_us: int) -> DataFrame:
    """The stored snapshots after ``events``: per key the latest write and the
    last invalidation, one row without a key for the latest time seen.  Rows
    whose last write and invalidation are both older than the TTL leave."""
    t = F.col("t")
    write = F.when(F.col("is_write"), F.struct("t", "id", "norm_url"))
    both = (events.select("cache_key", write.alias("w"), F.when(F.col("is_invalidation"), t).alias("inv_us"))
            .unionByName(held.where("cache_key IS NOT NULL")))
    now = (events.agg(F.max("t").alias("t")).unionByName(held.where("cache_key IS NULL").select(F.col("inv_us").alias("t")))
           .agg(F.max("t").alias("now")))
    live = (both.groupBy("cache_key").agg(F.max("w").alias("w"), F.max("inv_us").alias("inv_us"))
            .where(F.greatest("w.t", "inv_us") + ttl_us >= now.scalar()))
    return live.unionByName(now.select(F.lit(None).cast("string").alias("cache_key"), F.lit(None).cast(live.schema["w"].dataType).alias("w"),
                                       F.col("now").alias("inv_us")))


def live_snapshots(held: DataFrame, ttl_us: int) -> DataFrame:
    """What the cache would return at the latest time seen."""
    now = held.where("cache_key IS NULL").agg(F.max("inv_us")).scalar()
    kept = F.col("w").isNotNull() & (F.col("inv_us").isNull() | (F.col("inv_us") < F.col("w.t"))) & (F.col("w.t") + ttl_us >= now)
    return held.where(F.col("cache_key").isNotNull() & kept).select(
        "cache_key", F.col("w.norm_url").alias("norm_url"), F.col("w.id").alias("stored_event_id"), F.col("w.t").alias("stored_us"))


def run_snapshots(spark: SparkSession, stream: DataFrame, name: str = "live", ttl_seconds: int = C.DEFAULT_TTL_SECONDS) -> DataFrame:
    """The live snapshots of the stream.  The log of a batch is folded
    into the table the last one left, so what is kept grows with the live keys
    and not with time."""
    ttl_us = ttl_seconds * 1_000_000
    out, _ = _run_carried(spark, snapshot_events(stream), name, SNAPSHOTS, lambda rows, held: fold_snapshots(rows, held, ttl_us),
                          lambda done, held: done)
    last = spark.read.option("basePath", out).parquet(out)
    newest = last.agg(F.max("_batch")).first()[0]
    return live_snapshots(last.where(F.col("_batch") == newest).drop("_batch"), ttl_us)


def snapshot_table(upserts: DataFrame) -> DataFrame:
    """K5/K6 over the appended write/invalidation log."""
    w = upserts.where("is_write").groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("writes"),
        F.max(F.struct("t", "id", "norm_url")).alias("w"))
    inv = upserts.where("is_invalidation").groupBy("cache_key").agg(F.max("t").alias("inv_us"))
    return (w.join(inv, "cache_key", "left")
            .where(F.col("inv_us").isNull() | (F.col("inv_us") < F.col("w.t")))
            .select("cache_key", "writes", F.col("w.norm_url").alias("norm_url"),
                    F.col("w.id").alias("stored_event_id"), F.col("w.t").alias("stored_us")))
