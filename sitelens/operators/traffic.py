"""Crawler traffic, edge routing and the snapshot cache as DataFrame jobs.

Input ``requests(event_id, ts, user_id, method, user_agent, url,
resource_type, status, forced, ...)``; ``pages(page_id, url, html)``.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import columns as X
from sitelens.functions import constants as C
from sitelens.operators.prefix import chain, last_before
from sitelens.operators.prefix import ranges as deal

MAX_ID = (1 << 63) - 1
# Tokens of one automaton; a longer list is dealt into blocks.
BLOCK_TOKENS = 100_000


# --------------------------------------------------------------- bots
def bot_agents(spark: SparkSession) -> DataFrame:
    """The versioned crawler list as a (version, token) table (41 rows)."""
    return spark.createDataFrame([(C.BOT_LIST_VERSION, t) for t in C.BOT_TOKENS],
                                 "version string, token string")


def bot_regex(bots: DataFrame) -> DataFrame:
    """One alternation per list version, built from the table itself
    (regex metacharacters escaped, list order kept)."""
    escaped = F.regexp_replace("token", r"([.^$*+?()\[\]{}|\\])", r"\\$1")
    ordered = bots.select("version", F.monotonically_increasing_id().alias("i"), escaped.alias("t"))
    return ordered.groupBy("version").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "|")
        .alias("regex"))


def tag_bots(requests: DataFrame) -> DataFrame:
    """Crawler-token substring tests on the lower-cased user agent."""
    return requests.withColumn("is_bot", X.is_bot("user_agent"))


def _find_tokens(key, agents, tokens):
    """The tokens of a block in each lower-cased agent: one automaton, one pass
    an agent."""
    import ahocorasick
    import pyarrow as pa

    versions: dict[str, list] = {}
    for version, token in zip(tokens["version"].to_pylist(), tokens["token"].to_pylist()):
        versions.setdefault(token, []).append(version)
    automaton = ahocorasick.Automaton()
    for token in versions:
        if token:
            automaton.add_word(token, token)
    automaton.make_automaton()
    out = []
    for agent, low in zip(agents["user_agent"].to_pylist(), agents["low"].to_pylist()):
        found = {token for _, token in automaton.iter(low)} if len(automaton) else set()
        if "" in versions:  # contained in every agent
            found.add("")
        out += [(agent, v, t) for t in found for v in versions[t]]
    return pa.table([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["user_agent", "version", "token"])


def bot_token_hits(requests: DataFrame, bots: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Which crawler token each request matches, counted per token.

    Each distinct user agent is matched once by an Aho-Corasick automaton, its
    tokens joined back to the counts by equality.  The list may have any
    length: it is dealt into blocks of about ``block_tokens``, the agents over
    the session's shuffle partitions.  Null agents and tokens match nothing;
    a list row counts as often as it stands in the list.
    """
    salts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-bots.count() // block_tokens) or 1

    def dealt(column: str, own: str, n: int, other: str, m: int) -> list:
        return [F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)]

    tokens = bots.where("token IS NOT NULL").select("version", "token", *dealt("token", "block", blocks, "salt", salts))
    agents = (requests.select("user_agent").where("user_agent IS NOT NULL").distinct()
              .select("user_agent", F.lower("user_agent").alias("low"), *dealt("user_agent", "salt", salts, "block", blocks)))
    hits = agents.groupBy("block", "salt").cogroup(tokens.groupBy("block", "salt")).applyInArrow(
        _find_tokens, "user_agent string, version string, token string")
    pairs = requests.groupBy("user_agent", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(hits, "user_agent").groupBy("version", "token").agg(
        F.sum("n").alias("hits"), F.countDistinct("user_id").alias("users"))


# --------------------------------------------------------- edge routing
def prerender_routing(requests: DataFrame, prerender_url_set: bool = True) -> DataFrame:
    """F15/F16/F19 per request: which edge targets send it to the prerenderer.

    Targets: vercel, cloudflare, express, nginx (decision table in SURVEY).
    The URL path and the crawler test are staged once per row.
    """
    staged = requests.select("event_id", "url", (F.col("method") == "GET").alias("is_get"),
                             X.is_bot("user_agent").alias("bot"), X.url_path("url").alias("path"))
    path, is_get, bot = F.col("path"), F.col("is_get"), F.col("bot")
    api = path.startswith("/api/")
    static_ext = path.rlike("(?i)\\.(" + "|".join(C.STATIC_ASSET_EXTENSIONS) + ")$")
    next_or_static = path.startswith("/_next/") | path.startswith("/static/")
    matcher_skip = path.rlike("^/(_next/static|_next/image|favicon.ico)")
    configured = F.lit(prerender_url_set)
    return staged.select(
        "event_id",
        X.url_ok("url").alias("url_ok"),
        (~disallowed(path)).alias("crawl_allowed"),
        (is_get & bot & configured & ~api & ~next_or_static & ~static_ext & ~matcher_skip).alias("vercel"),
        (is_get & bot & configured & ~api & ~static_ext).alias("cloudflare"),
        (is_get & bot & ~api & ~static_ext).alias("express"),
        bot.alias("nginx"),
    )


# ------------------------------------------------- renderer filters
def blocked_resources(requests: DataFrame) -> DataFrame:
    """sub-resources the renderer aborts (type or tracker substring)."""
    lower_url = F.lower("url")
    tracker = F.lit(False)
    for s in C.BLOCKED_URL_SUBSTRINGS:
        tracker = tracker | lower_url.contains(s)
    return requests.select(
        "event_id", "resource_type",
        (F.col("resource_type").isin(C.BLOCKED_RESOURCE_TYPES) | tracker).alias("blocked"))


def failed_fetches(requests: DataFrame) -> DataFrame:
    """no response or HTTP status >= 400."""
    return requests.select(
        "event_id", "status",
        (F.col("status").isNull() | (F.col("status") >= 400)).alias("failed"))


# ------------------------------------------------------- crawl policy
def crawl_allowed(pages: DataFrame) -> DataFrame:
    """F19 over each page's link targets: links, and those robots.txt allows."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return pages.select(
        "page_id",
        F.size(links).alias("n_links"),
        F.size(F.filter(links, lambda link: ~disallowed(link))).alias("n_allowed"),
    )


def disallowed(path):
    """the robots.txt rules disallow this path."""
    out = F.lit(False)
    for prefix in C.ROBOTS_DISALLOW:
        out = out | path.startswith(prefix)
    return out


# ----------------------------------------------------------- url keys
def url_keys(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url",
                        X.url_normalize("url").alias("norm_url"),
                        X.cache_key("url").alias("cache_key"))


# ------------------------------------------------------- snapshot cache log
def render_log(requests: DataFrame) -> DataFrame:
    """Requests that reach the render endpoint (http/https URL), with the cache
    key, microsecond time and whether the render succeeded (F18 negated)."""
    return (requests.where(X.url_ok("url"))
            .select(
                X.cache_key("url").alias("cache_key"),
                X.epoch_us("ts").alias("t"),
                F.col("event_id").alias("id"),
                F.coalesce(F.col("forced"), F.lit(False)).alias("forced"),
                (F.col("status").isNotNull() & (F.col("status") < 400)).alias("ok"),
                "ts", "url", "user_agent"))


def invalidations(requests: DataFrame) -> DataFrame:
    """Cache invalidation calls: a purchase changes the page, so its snapshot
    is deleted (``DELETE /cache?url=``)."""
    return (requests.where(F.col("event_type") == "purchase")
            .select(X.cache_key("url").alias("cache_key"), X.epoch_us("ts").alias("t")))


def _latest_writes(requests: DataFrame, invalidated: DataFrame | None) -> DataFrame:
    """One row per key with a write, from one aggregate of the log; given
    invalidations are aggregated apart and joined one to one."""
    ok = F.col("status").isNotNull() & (F.col("status") < 400) & X.url_ok("url")
    t = X.epoch_us("ts")
    write = F.struct(t.alias("t"), F.col("event_id").alias("id"), X.url_normalize("url").alias("norm_url"))
    own = F.max(F.when(F.col("event_type") == "purchase", t)) if invalidated is None else F.lit(None).cast("long")
    latest = requests.groupBy(X.cache_key("url").alias("cache_key")).agg(
        F.count_if(ok).alias("writes"), F.max(F.when(ok, write)).alias("w"), own.alias("inv_us"),
        F.max(F.when(X.url_ok("url"), t)).alias("seen_us"))
    if invalidated is not None:
        latest = latest.drop("inv_us").join(
            invalidated.groupBy("cache_key").agg(F.max("t").alias("inv_us")), "cache_key", "left")
    stored = F.col("w.t")
    return latest.select("cache_key", "writes", F.col("w.norm_url").alias("norm_url"),
                         F.col("w.id").alias("stored_event_id"), stored.alias("stored_us"), "seen_us",
                         (stored.isNotNull() & (F.col("inv_us").isNull() | (F.col("inv_us") < stored))).alias("kept"))


def snapshot_latest(requests: DataFrame, invalidated: DataFrame | None = None) -> DataFrame:
    """K5 + K6: last successful write per key wins; a later invalidation
    deletes it.  Both sides are pre-aggregated to one row per key, so the
    delete is an equi-join, never a pairwise range join."""
    return _latest_writes(requests, invalidated).where("kept").drop("seen_us", "kept")


def snapshot_clear(requests: DataFrame, invalidated: DataFrame | None = None) -> DataFrame:
    """K6, delete-all at the log's end: how many entries it removes."""
    return snapshot_latest(requests, invalidated).agg(F.count(F.lit(1)).alias("deleted_entries"))


def snapshot_stats(requests: DataFrame, ttl_seconds: int = C.DEFAULT_TTL_SECONDS,
                   invalidated: DataFrame | None = None) -> DataFrame:
    """Entries, fresh (age < TTL), stale and deleted at the log's end time
    (the last render request)."""
    ttl_us = ttl_seconds * 1_000_000
    rows = _latest_writes(requests, invalidated)
    now = rows.select(F.max("seen_us")).scalar()
    s = rows.where(F.col("stored_us").isNotNull()).agg(
        F.count_if("kept").alias("total_entries"),
        F.count_if(F.col("kept") & ((now - F.col("stored_us")) < ttl_us)).alias("fresh_entries"),
        F.count_if(~F.col("kept")).alias("deleted_entries"))
    return s.select("total_entries", "fresh_entries",
                    (F.col("total_entries") - F.col("fresh_entries")).alias("stale_entries"),
                    "deleted_entries", F.lit(ttl_seconds).alias("ttl_seconds"))


def _with_deletes(log: DataFrame, invalidated: DataFrame) -> DataFrame:
    """The render log with a row for each invalidation (``clear``); deletes of
    a microsecond come after its requests."""
    inv = (invalidated.where("cache_key IS NOT NULL")
           .select("cache_key", "t", F.lit(MAX_ID).alias("id"), F.lit(True).alias("clear")))
    return log.withColumn("clear", F.lit(False)).unionByName(inv, allowMissingColumns=True)


def snapshot_asof(requests: DataFrame, ttl_seconds: int = C.DEFAULT_TTL_SECONDS,
                  invalidated: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """For each render request, the freshest earlier successful write of
    its key that no invalidation has deleted since, and whether it is still
    within TTL (age <= TTL is readable).

    The last write or delete before each request is one scan over ranges of
    the log (``operators/prefix.py``): no join, no pairs, and a hot key is
    spread by its rows, not by its hours."""
    if invalidated is None:
        invalidated = invalidations(requests)
    log = _with_deletes(render_log(requests).select("cache_key", "t", "id", "ok"), invalidated)
    event = F.when(F.col("ok") | F.col("clear"), F.struct("t", "id", "clear"))
    m = last_before(log, "cache_key", ["t", "id"], event, "w", ranges).where("NOT clear")
    m = m.withColumn("w", F.when(~F.col("w.clear"), F.col("w")))
    age = F.col("t") - F.col("w.t")
    return m.select(
        F.col("id").alias("event_id"), "cache_key",
        F.col("w.id").alias("snapshot_event_id"),
        age.alias("age_us"),
        F.coalesce(age <= ttl_seconds * 1_000_000, F.lit(False)).alias("fresh"))


# --------------------------------------------- anchored-TTL HIT/MISS
def ttl_outcomes(requests: DataFrame, ttl_seconds: int = C.DEFAULT_TTL_SECONDS,
                 carry: tuple[str, ...] = (), invalidated: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """HIT / MISS / ERROR of every render request under an anchored TTL.

    A request is a HIT when it is not forced and the snapshot stored by the
    last successful render of its key is at most TTL old and not invalidated
    since (T6; by default each purchase invalidates); otherwise it
    renders (MISS, or ERROR when the render fails, which stores nothing).

    The state of a key is the time until which its snapshot is good.  A success
    later than that, and every forced success, sets it to its own time plus
    TTL; an invalidation takes it away: a threshold chain over ranges of the
    log (``operators/prefix.py``), so a key with a third of all traffic is
    spread over a third of the ranges and nothing is folded key by key.
    """
    if invalidated is None:
        invalidated = invalidations(requests)
    log = _with_deletes(render_log(requests).select("cache_key", "t", "id", "forced", "ok", *carry), invalidated)
    rows = deal(log, "cache_key", [F.col("t"), F.col("id")], ranges)
    m = chain(rows, "cache_key", ["t", "id"], F.col("t"), F.col("t") + ttl_seconds * 1_000_000, can=F.col("ok"),
              must=F.col("ok") & F.col("forced"), clear=F.col("clear")).where("NOT clear")
    hit = ~F.col("forced") & F.coalesce(F.col("t") <= F.col("enters"), F.lit(False))
    outcome = F.when(hit, "HIT").when(F.col("ok"), "MISS").otherwise("ERROR")
    return m.select(F.col("id").alias("event_id"), "cache_key", "t", outcome.alias("outcome"), *carry)


def service_metrics(requests: DataFrame, ttl_seconds: int = C.DEFAULT_TTL_SECONDS) -> DataFrame:
    """A7 + P47 per day: renders (incl. failed), hits, errors, hit rate %,
    uptime (seconds between first and last request) and crawler share."""
    tagged = ttl_outcomes(requests, ttl_seconds, carry=("ts", "user_agent"))
    g = tagged.groupBy(X.day("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(X.is_bot("user_agent")).alias("bot_requests"),
        F.count_if(F.col("outcome") != "HIT").alias("render_count"),
        F.count_if(F.col("outcome") == "HIT").alias("cache_hit_count"),
        F.count_if(F.col("outcome") == "ERROR").alias("error_count"),
        ((F.max("t") - F.min("t")) / 1_000_000).cast("long").alias("uptime_seconds"))
    total = F.col("render_count") + F.col("cache_hit_count")
    rate = F.when(total > 0, X.bround1(F.col("cache_hit_count") * 100.0 / total)).otherwise(F.lit(0.0))
    return g.withColumn("cache_hit_rate_pct", rate)


# ``_find_tokens`` travels to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
