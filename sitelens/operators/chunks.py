"""Size-bounded ordered chunks of each project's source files
(P48, O2, O3, W3, W4, A9, J10).

Files are ordered by (priority, path) both descending; a new part starts
when the current part is non-empty and the next file would push it past the
target; a file larger than the target sits alone.

The packing is a sequential fold, but its state is only "where the current
part started": from a part starting at file ``i`` the next part starts at the
first later file whose running size exceeds the size before ``i`` plus the
target.  Running sizes and ordinals are one prefix scan over sampled ranges,
part starts a threshold chain over the same ranges (``operators/prefix.py``);
a project of any number of files, in one folder or many, is spread over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.operators.prefix import chain, prefix_sums
from sitelens.operators.scan import basename


def file_priority(path) -> F.Column:
    """File-name priority, default 50."""
    m = F.create_map(*[x for k, v in C.FILE_PRIORITIES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[basename(path)], F.lit(C.DEFAULT_FILE_PRIORITY))


CHUNK_COLUMNS = ["project_id", "part_number", "path", "chars", "priority", "file_order",
                 "total_parts", "part_chars"]


def chunk_files(files: DataFrame, target_chars: int = C.DEFAULT_CHUNK_TARGET_CHARS,
                ranges: int | None = None) -> DataFrame:
    """files(project_id, path, content) → one row per file with
    part_number, total_parts, chars, part_chars and file order.  A null text
    has no characters."""
    f = files.select("project_id", "path", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"),
                     file_priority(F.col("path")).alias("priority"))
    order = [F.col("priority").desc(), F.col("path").desc()]
    f = prefix_sums(f, "project_id", order, {"S": F.col("chars"), "file_order": F.lit(1).cast("long")},
                    ranges, keep_range=True).checkpoint(eager=True)
    parts = (chain(f, "project_id", ["file_order"], F.col("S"), F.col("S") - F.col("chars") + target_chars)
             .withColumnRenamed("part", "part_number").checkpoint(eager=True))
    sizes = parts.groupBy("project_id", "part_number").agg(F.sum("chars").alias("part_chars"))
    totals = sizes.groupBy("project_id").agg(F.max("part_number").alias("total_parts"))
    return parts.join(sizes.join(totals, "project_id"), ["project_id", "part_number"]).select(*CHUNK_COLUMNS)
