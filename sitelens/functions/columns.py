"""Column helpers: every one is a built-in Spark expression (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import constants as C

# URL pieces.  ``scheme://netloc`` then the path up to ``?``/``#``.
URL_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
URL_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_bot(user_agent: str | Column) -> Column:
    """the user agent contains any crawler token (case-insensitive).

    A chain of substring tests on the lower-cased agent (codegen keeps one
    ``lower``); about 4x faster than the equivalent 41-way regex
    alternation (``constants.bot_alternation``) on the same rows."""
    ua = F.lower(col(user_agent))
    hit = F.lit(False)
    for token in C.BOT_TOKENS:
        hit = hit | ua.contains(token)
    return F.coalesce(hit, F.lit(False))


def url_ok(url: str | Column) -> Column:
    """F16: only http(s) URLs are rendered (else the service answers 400)."""
    u = col(url)
    return u.startswith("http://") | u.startswith("https://")


def url_path(url: str | Column) -> Column:
    """Path component of an absolute URL (no query, no fragment)."""
    return F.regexp_extract(col(url), URL_PATH_RE, 1)


def url_normalize(url: str | Column) -> Column:
    """Drop query, fragment and last-segment ``;params``; lower the scheme."""
    no_query = F.regexp_replace(col(url), r"[?#].*$", "")
    no_params = F.regexp_replace(no_query, r";[^/]*$", "")
    scheme = F.regexp_extract(no_params, URL_SCHEME_RE, 1)
    rest = no_params.substr(F.length(scheme) + 1, F.length(no_params) + 1)
    return F.concat(F.lower(scheme), rest)


def cache_key(url: str | Column) -> Column:
    """Snapshot key = SHA-256 hex of the normalised URL."""
    return F.sha2(url_normalize(url), 256)


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, independent of session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col(ts))


def ntz_from_micros(us: Column) -> Column:
    """TIMESTAMP_NTZ wall clock (UTC) of epoch microseconds, zone-independent."""
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def day(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def bround1(x: Column) -> Column:
    """Half-even rounding to one decimal (DuckDB oracle: ``round_even``)."""
    return F.bround(x, 1)


def py_round1(num: Column, den: Column) -> Column:
    """``round(num / den, 1)`` exactly as Python rounds the quotient double.

    Integer arithmetic: the rational is rounded half-up/half-down by its
    remainder; an exact tie ``(2q+1)/20`` follows the binary double nearest to
    it — half-even when that tie is representable (``2q+1`` divisible by 5),
    otherwise up iff the double lies above the tie.  The double of ``N/20``
    lies above iff ``N·2^s mod 20 >= 10`` for its scale ``s = 52 - e``
    (``e = floor(log2(N/20))``); ``2^s mod 20`` cycles 16, 12, 4, 8.
    """
    n10 = num.cast("long") * 10
    d = den.cast("long")
    qd = F.floor(n10 / d).cast("long")
    r = n10 - qd * d
    big = 2 * r
    odd = 2 * qd + 1
    e = F.floor(F.log2(odd / F.lit(20.0))).cast("long")
    s = F.lit(52) - e
    pm = (F.when(F.pmod(s, F.lit(4)) == 0, 16).when(F.pmod(s, F.lit(4)) == 1, 12)
          .when(F.pmod(s, F.lit(4)) == 2, 4).otherwise(8))
    tie_up = F.when(F.pmod(odd, F.lit(5)) == 0, F.pmod(qd, F.lit(2)) == 1).otherwise(
        F.pmod(F.pmod(odd, F.lit(20)) * pm, F.lit(20)) >= 10)
    up = (big > d) | ((big == d) & tie_up)
    return (qd + F.when(up, 1).otherwise(0)) / F.lit(10.0)
