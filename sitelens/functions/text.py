"""Text helpers over whole documents.

``matches`` finds every non-overlapping match of a pattern with its 1-based
start line: one pass of the pattern, and a binary search of each match in the
text's sorted newline offsets.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.splitlines() boundaries.
SPLITLINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def splitlines(text: Column) -> Column:
    """Lines as Python's ``str.splitlines`` would cut them (trailing '' kept)."""
    return F.split(text, SPLITLINES, -1)


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def find_matches(text: str, pattern: re.Pattern) -> list[tuple]:
    """(line, groups...) of each match; a group that took no part is ''."""
    found = list(pattern.finditer(text))
    if not found:
        return []
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [(bisect_left(breaks, m.start()) + 1, *[g or "" for g in m.groups()]) for m in found]


def matches(text: Column, pattern: str, last: str = "") -> Column:
    """array<struct<line:int, g1..gN:string>> of the matches of ``pattern`` (an
    Arrow UDF).  A match ends with ``last``, if given in lower case: what comes
    after the last one of a text is not searched.  A null text has none."""
    compiled = re.compile(pattern, re.ASCII)
    names = ["line", *[f"g{i + 1}" for i in range(compiled.groups)]]

    def run(texts: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for t in texts.to_pylist():
            t = t or ""
            rows += find_matches(t[:t.lower().rfind(last) + len(last)] if last else t, compiled)
            ends.append(len(rows))
        columns = [pa.array([r[i] for r in rows], pa.string() if i else pa.int32()) for i in range(len(names))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))

    return F.arrow_udf(run, f"array<struct<{','.join(f'{n}:{'string' if i else 'int'}' for i, n in enumerate(names))}>>")(text)


# The functions travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
