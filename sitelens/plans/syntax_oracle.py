"""The DuckDB form of the source scanner: a fold over a text's tokens.

Written apart from ``functions/jsx.py`` (own tokens, own table of modes), so
that the two check each other.
"""

from __future__ import annotations

from sitelens.functions import constants as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


HOOK_LIST = "[" + ", ".join(q(h) for h in C.CLIENT_HOOKS) + "]"
# One token: a word, blanks, a sign of two letters, the start of a tag, or one character.
_TOKEN = (r"[\p{L}\p{N}_$]+|[ \t\r\f\v\x{a0}\x{feff}]+|//|/\*|\*/|=>|</|/>|<>|<[\p{L}_$][\p{L}\p{N}_$.:-]*|[\s\S]")
_EXPR = in_list("( , = : [ ! & | ? { } ; + - * % ~ ^ =>".split()
                + "return default case yield await else do in of typeof void delete".split() + [""])


def syntax_events_sql(t: str) -> str:
    """Events of a text, by a fold over its tokens with a stack of modes: c code,
    d q t strings, l b comments, x children, z end tag, g and R tags, D Q their
    strings.  'E|start|self', 'V|start|name|from|to', 'H|hook', 'I|at|source'."""
    top, mode = "s.st[-1]", "left(s.st[-1], 1)"
    blank = "(t = chr(10) OR trim(t, ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)) = '')"
    tag = "CASE WHEN t = '<Route' THEN 'R' || s.pos ELSE 'g' END"
    opens = f"(left(t, 1) = '<' AND length(t) > 1 AND t <> '</')"
    in_code = f"({opens} AND s.p IN {_EXPR})"
    end = "(s.pos + length(t))"
    # The tag that a finished value belongs to loses its open attribute.
    done = "list_append({r}[:-2], split_part({r}[-1], '|', 1))"
    popped = "s.st[:-2]"
    back = f"CASE WHEN contains({popped}[-1], '|') THEN {done.format(r=popped)} ELSE {popped} END"
    value = f"CASE WHEN contains({popped}[-1], '=|') THEN ['V|' || substr(split_part({popped}[-1], '|', 1), 2) || '|' || split_part({popped}[-1], '|', 2) || '|' || split_part({popped}[-1], '|', 4) || '|' || {end}] ELSE [] END"
    begun = f"CASE WHEN ends_with({top}, '|=') THEN list_append(s.st[:-2], {top} || '|' || s.pos) ELSE s.st END"
    st = f"""CASE {mode}
      WHEN 'c' THEN CASE WHEN {in_code} THEN list_append(s.st, CASE WHEN t = '<>' THEN 'x' ELSE {tag} END)
        WHEN t = '{{' THEN list_append(s.st, 'c') WHEN t = '}}' AND len(s.st) > 1 THEN {back}
        WHEN t = '"' THEN list_append(s.st, 'd' || s.pos) WHEN t = '''' THEN list_append(s.st, 'q' || s.pos) WHEN t = '`' THEN list_append(s.st, 't')
        WHEN t = '//' THEN list_append(s.st, 'l') WHEN t = '/*' THEN list_append(s.st, 'b') ELSE s.st END
      WHEN 'd' THEN CASE WHEN (t = '"' AND s.p <> chr(92)) OR t = chr(10) THEN {popped} ELSE s.st END
      WHEN 'q' THEN CASE WHEN (t = '''' AND s.p <> chr(92)) OR t = chr(10) THEN {popped} ELSE s.st END
      WHEN 't' THEN CASE WHEN t = '`' AND s.p <> chr(92) THEN {popped} WHEN t = '{{' AND ends_with(s.p, '$') THEN list_append(s.st, 'c') ELSE s.st END
      WHEN 'l' THEN CASE WHEN t = chr(10) THEN {popped} ELSE s.st END
      WHEN 'b' THEN CASE WHEN t = '*/' THEN {popped} ELSE s.st END
      WHEN 'x' THEN CASE WHEN t = '{{' THEN list_append(s.st, 'c') WHEN t = '</' THEN list_append({popped}, 'z') WHEN t = '<>' THEN list_append(s.st, 'x')
        WHEN {opens} THEN list_append(s.st, {tag}) ELSE s.st END
      WHEN 'z' THEN CASE WHEN t = '>' THEN {back} ELSE s.st END
      WHEN 'D' THEN CASE WHEN t = '"' THEN {back} ELSE s.st END
      WHEN 'Q' THEN CASE WHEN t = '''' THEN {back} ELSE s.st END
      ELSE CASE WHEN t = '{{' THEN list_append({begun}, 'c') WHEN t = '"' THEN list_append({begun}, 'D') WHEN t = '''' THEN list_append({begun}, 'Q')
        WHEN {opens} AND s.p = '=' THEN list_append({begun}, {tag}) WHEN t = '>' THEN list_append({popped}, 'x') WHEN t = '/>' THEN {back}
        WHEN t = '//' THEN list_append(s.st, 'l') WHEN t = '/*' THEN list_append(s.st, 'b')
        WHEN {mode} = 'R' AND t IN ('path', 'component', 'element') AND s.p NOT IN ('-', '.', ':') THEN list_append(s.st[:-2], split_part({top}, '|', 1) || '|' || t)
        WHEN {mode} = 'R' AND t = '=' AND contains({top}, '|') THEN list_append(s.st[:-2], {top} || '|=') ELSE s.st END END"""
    strings = f"({mode} IN ('d', 'q', 't'))"
    p = f"""CASE WHEN {mode} IN ('l', 'b') THEN s.p
      WHEN {strings} THEN CASE WHEN (t = '"' AND {mode} = 'd' OR t = '''' AND {mode} = 'q' OR t = '`' AND {mode} = 't') AND s.p <> chr(92) THEN ')'
        WHEN t = chr(10) AND {mode} <> 't' THEN ')' WHEN t = chr(92) AND s.p = chr(92) THEN '' WHEN s.p = chr(92) THEN '' WHEN t = '{{' AND ends_with(s.p, '$') THEN '' ELSE t END
      WHEN {mode} = 'c' THEN CASE WHEN {blank} OR t IN ('//', '/*') THEN s.p WHEN t IN ('{{', '"', '''', '`') THEN '' WHEN left(t, 1) = '<' AND NOT {in_code} AND length(t) > 1 THEN substr(t, 2) ELSE t END
      WHEN {mode} IN ('x', 'D', 'Q') THEN CASE WHEN t = '{{' THEN '' ELSE ')' END
      WHEN {mode} = 'z' THEN ''
      ELSE CASE WHEN {blank} OR t IN ('//', '/*') THEN s.p WHEN t = '/>' THEN '' WHEN t = '{{' THEN '' ELSE t END END"""
    before = f"CASE WHEN {mode} <> 'c' OR {blank} THEN s.b WHEN regexp_matches(t, '^[\\p{{L}}\\p{{N}}_$]') THEN s.p ELSE '' END"
    im = f"""CASE WHEN {mode} = 'c' AND t = 'import' AND len(s.st) = 1 AND s.p <> '.' THEN s.pos WHEN {mode} = 'c' AND t IN ('(', '.', ';') THEN -1
      WHEN {mode} IN ('d', 'q') AND len(s.st) = 2 AND t IN ('"', '''') AND s.p <> chr(92) THEN -1 ELSE s.im END"""
    out = f"""CASE WHEN {mode} = 'c' AND t = '(' AND list_contains({HOOK_LIST}, s.p) AND s.b NOT IN ('function', 'new') THEN list_append(s.out, 'H|' || s.p)
      WHEN {mode} = 'c' AND t = '}}' AND len(s.st) > 1 THEN list_concat(s.out, {value})
      WHEN s.im >= 0 AND len(s.st) = 2 AND (({mode} = 'd' AND t = '"') OR ({mode} = 'q' AND t = '''')) AND s.p <> chr(92)
        THEN list_append(s.out, 'I|' || s.im || '|' || substr({t}, CAST(substr({top}, 2) AS BIGINT) + 2, s.pos - CAST(substr({top}, 2) AS BIGINT) - 1))
      WHEN ({mode} = 'D' AND t = '"') OR ({mode} = 'Q' AND t = '''') OR ({mode} = 'z' AND t = '>') THEN list_concat(s.out, {value})
      WHEN {mode} IN ('g', 'R') AND t IN ('>', '/>') THEN list_concat(CASE WHEN {mode} = 'R' THEN list_append(s.out, 'E|' || substr(split_part({top}, '|', 1), 2) || '|' || t) ELSE s.out END,
        CASE WHEN t = '/>' THEN {value} ELSE [] END)
      WHEN {mode} = 'R' AND t IN ('path', 'component', 'element') AND s.p NOT IN ('-', '.', ':') THEN list_append(s.out, 'N|' || substr(split_part({top}, '|', 1), 2) || '|' || t)
      ELSE s.out END"""
    first = "{'st': ['c'], 'p': '', 'b': '', 'pos': CAST(0 AS BIGINT), 'im': CAST(-1 AS BIGINT), 'out': ['']}"
    step = f"{{'st': {st}, 'p': {p}, 'b': {before}, 'pos': {end}, 'im': {im}, 'out': {out}}}"
    return f"list_reduce(regexp_extract_all({t}, {q(_TOKEN)}), lambda s, t: {step}, {first}).out"


SYNTAX_CTE = f"""ev AS MATERIALIZED (SELECT project_id, path, e, k FROM (
    SELECT project_id, path, unnest(evs) AS e, unnest(range(len(evs))) AS k FROM (SELECT project_id, path, {syntax_events_sql('content')} AS evs FROM sources)))"""
