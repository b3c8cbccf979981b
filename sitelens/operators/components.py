"""Client / server component classification per source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.functions import patterns as P
from sitelens.functions.patterns import word
from sitelens.operators.scan import with_syntax

EVENT_HANDLER = r"on[A-Z][a-zA-Z]+\s*="

# FIXED VALUES: classification texts.
SERVER_REASON = "No client-only hooks, globals, or event handlers detected"
HANDLER_REASON = "Has JSX event handlers (onClick, onChange, etc.)"
NOTE_REACT_QUERY = ("useQuery/useMutation can often become server-side fetch() calls in an async "
                    "Server Component when the data is not user-specific.")
NOTE_SWR = "useSWR can usually become a top-level await fetch() in a Server Component for public data."
NOTE_EFFECT = "useEffect + fetch() can often move into an async Server Component with direct await fetch()."
NOTE_SPLIT = ("Consider splitting this into a Server Component data wrapper and a smaller Client Component "
              "for interactivity.")
NOTE_PURE = "This looks like a candidate for a pure async Server Component in Next.js App Router."


def effect_then_fetch(text: Column) -> Column:
    """An effect's call with a fetch call anywhere after the first one."""
    after = F.regexp_replace(text, rf"(?s)^.*?{P.USE_EFFECT}", "")
    return text.contains("useEffect") & text.contains("fetch") & text.rlike(P.USE_EFFECT) & after.rlike(P.FETCH)


def classify_components(sources: DataFrame) -> DataFrame:
    """P27–P31 per source file.  Hooks are those that the scanner saw called,
    distinct, in first-call order; a global's pattern runs only on texts that
    contain its name."""
    c = F.col("content")
    empty = F.array().cast("array<string>")
    staged = (with_syntax(sources).select("project_id", F.col("path").alias("file_path"), "content", F.col("syntax.hooks").alias("hooks"))
              .withColumn("globals", F.array_compact(F.array(*[
                  F.when(c.contains(g) & c.rlike(word(g)), F.lit("Accesses browser global: " + g))
                  for g in sorted(C.CLIENT_GLOBALS)])))
              .withColumn("handler", c.rlike(EVENT_HANDLER))
              .withColumn("rq", c.contains("useQuery") | c.contains("useMutation"))
              .withColumn("swr", c.contains("useSWR"))
              .withColumn("effect", effect_then_fetch(c))
              .withColumn("has_use_query", c.contains("useQuery"))
              .drop("content"))
    hooks = F.col("hooks")
    staged = staged.withColumn("reasons", F.concat(
        F.transform(hooks, lambda h: F.concat(F.lit("Uses "), h, F.lit("()"))), F.col("globals"),
        F.when(F.col("handler"), F.array(F.lit(HANDLER_REASON))).otherwise(empty)))
    rq, swr, effect = F.col("rq"), F.col("swr"), F.col("effect")
    fetching = rq | swr | effect
    client = F.size("reasons") > 0
    extra = (F.when(rq & F.col("has_use_query") & ~F.array_contains(hooks, "useQuery"), F.array(F.lit("useQuery")))
             .when(~rq & swr & ~F.array_contains(hooks, "useSWR"), F.array(F.lit("useSWR")))
             .otherwise(empty))
    notes = F.array_compact(F.array(
        F.when(rq, F.lit(NOTE_REACT_QUERY)).when(swr, F.lit(NOTE_SWR)).when(effect, F.lit(NOTE_EFFECT)),
        F.when(client & F.array_contains(hooks, "useEffect") & fetching, F.lit(NOTE_SPLIT))
        .when(~client & fetching, F.lit(NOTE_PURE))))
    pattern = F.when(rq, "react_query").when(swr, "swr").when(effect, "useEffect_fetch").otherwise("none")
    return staged.select(
        "project_id", "file_path",
        F.when(client, "client").otherwise("server").alias("component_type"),
        F.when(client, F.col("reasons")).otherwise(F.array(F.lit(SERVER_REASON))).alias("reasons"),
        F.concat(hooks, extra).alias("client_hooks_found"),
        fetching.alias("has_data_fetching"), pattern.alias("data_fetch_pattern"),
        notes.alias("migration_notes"))
