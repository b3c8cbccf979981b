"""The source scanner: hand-written texts, agreement with its Spark form, and
time that grows with the text."""

import time

import pytest
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.functions import jsx, text

HOOKS = frozenset(C.CLIENT_HOOKS)


def routes(t):
    return [r[2].strip("{}'\"`") for r in jsx.scan(t, HOOKS)[0] if r[2]]


def hooks(t, is_jsx=True):
    return jsx.scan(t, HOOKS, is_jsx)[1]


def imports(t):
    return [i[1] for i in jsx.scan(t, HOOKS)[2]]


@pytest.mark.parametrize("t, want", [
    ("""<p>Don't</p> {/* <Route path="/old" /> */} <p>can't</p> <Route path="/live" />""", ["/live"]),
    ("""<><p>Don't</p> {/* <Route path="/old" /> */} <p>can't</p> <Route path="/live" /></>""", ["/live"]),
    ("<Route path='/deep' element={<A o={" + "{" * 40 + "a:1" + "}" * 40 + "} />} />", ["/deep"]),
    ("<a b={`}`} c='}'><Route path={'/x'} /></a>", ["/x"]),
    ("const t = `<Route path='/text' /> ${<Route path='/in' />} `;", ["/in"]),
    ("x = 1 // <Route path='/a' />\ny = <Route path='/b' /> /* <Route path='/c' /> */", ["/b"]),
    ("'<Route path=\"/s\" />'; \"it's <Route path='/s' />\"", []),
    ("r = /['\"`<]/g; s = <Route path='/after' />", ["/after"]),
    ("r = /[/'\"]/; s = <Route path='/after' />", ["/after"]),
    ("n = a / b; m = <Route path='/q' />; o = c / d", ["/q"]),
    ("if (a <Route && b> c) {}", []),
    ("<Routes><Route path='/a'><Route path='/a/b' component={X}/></Route><Route index path='/z'/></Routes>", ["/a", "/a/b", "/z"]),
    ("<Route element={<L><Route path='/in' /></L>} path='/out' />", ["/out", "/in"]),
    ("<Route.Item path='/no' /> ; <Routes path='/no' />; <Route-x path='/no' />", []),
    ("<Route data-path='/no' path:x='/no' path='/yes' path='/second' />", ["/yes"]),
    ("<Route\n  // note\n  path='/c' /* it's */\n  exact\n/>", ["/c"]),
    ("<Route {...rest} path='/spread' />", ["/spread"]),
    ("const f = <T,>(x: T) => <Route path='/t' />", ["/t"]),
    ("<p>1 {'<'} 2 // no comment </p>;<Route path='/k' />", ["/k"]),
    ("(<Route path='/open'", []),
])
def test_routes(t, want):
    assert routes(t) == want


@pytest.mark.parametrize("t, want", [
    ("const [a] = useState(0); React . useEffect (() => {}); useState(1)", ["useState", "useEffect"]),
    ("// useState(0)\n/* useRef(0) */ 'useMemo(0)'; `useMemo(0) ${useRef(1)}`", ["useRef"]),
    ("function useState(a) {} new useRef(1); useContext;", []),
    ("const x = useState<Map<string, { a: (b: C) => void }>>(null); y = useRef<A>", ["useState"]),
    ("<p>useState(0) {useMemo(() => 1)}</p>", ["useMemo"]),
    ("x = a // it's\nuseQuery(1)", ["useQuery"]),
    ("useSWRInfinite(1); myuseState(2); useState_(3); useStaté(1)", []),
    ("", []),
])
def test_hooks(t, want):
    assert hooks(t) == want


def test_typescript_without_jsx():
    assert hooks("const f = <Foo>useState(0); const g = <T>(x: T) => useRef(x)", False) == ["useState", "useRef"]


def test_imports():
    t = """import React, { a as b } from 'react';
import 'side.css'
// import x from 'no'
import type { T } from "types"
import(\"dynamic\"); import.meta.url; 'str'; export { z } from 'no';
{ import q from 'nested' }
const s = `import y from 'no'`;
import * as h
  from 'react-helmet'"""
    assert imports(t) == ["react", "side.css", "types", "react-helmet"]
    assert [line for line, _ in jsx._with_lines(t, jsx.scan(t, HOOKS)[2])] == [1, 2, 4, 8]


UNITS = {"calls": "<p>word</p>\n", "effects": "useEffect(", "quotes": "'", "ticks": "`", "elements": "(<div>", "values": "<a>{", "braces": "{",
         "classes": "= /[a", "comments": "/* *", "angles": "a<", "routes": "<Route path='/a' />\n", "tags": "=<a ", "escapes": "=/a\\", "stars": "/**"}


@pytest.mark.parametrize("unit", UNITS.values(), ids=UNITS)
def test_time_is_linear(unit):
    def cost(n):
        best = 9.0
        for _ in range(3):
            t0 = time.process_time()
            jsx.scan(unit * (n // len(unit)), HOOKS)
            best = min(best, time.process_time() - t0)
        return best
    one, two = cost(48_000), cost(96_000)
    assert two < 1 and two < 3 * one + 0.02


def test_columns(spark):
    rows = [("a.jsx", "\n<Route path='/a' component={X} element />", ), ("b.ts", "const f = <A>useState(0)"), ("c.js", None), (None, "")]
    got = spark.createDataFrame(rows, "p string, t string").select(jsx.syntax(F.col("t"), F.col("p"), C.CLIENT_HOOKS).alias("s")).collect()
    assert [(tuple(r.s.routes), r.s.hooks, r.s.imports) for r in got] == [
        (((2, True, "'/a'", "{X}", "element"),), [], []), ((), ["useState"], []), ((), [], []), ((), [], [])]


def test_match_lines(spark):
    t = "a1\nb a2 a3\n\nA a4"
    got = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(text.matches(F.col("t"), r"a(\d)(x)?").alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in got] == [[(1, "1", ""), (2, "2", ""), (2, "3", ""), (4, "4", "")], [], []]
    unclosed = "<title>x</title>" + "<title>" * 50_000
    t0 = time.process_time()
    assert len(text.find_matches(unclosed[:unclosed.rfind("</title>") + 8], __import__("re").compile("(?s)<title>(.*?)</title>"))) == 1
    costs = []
    for n in (8_000, 16_000):
        t0 = time.process_time()
        assert text.find_matches("path: '/a'\n" * n, __import__("re").compile("path: '(.*?)'"))[-1] == (n, "/a")
        costs.append(time.process_time() - t0)
    assert costs[1] < 2.2 * costs[0] + 0.02


@pytest.mark.parametrize("t, want", [
    ("useEffect(() => { fetch('/a') })", False), ("useEffect(async x => { fetch('/a') })", True), ("useEffect(a) => fetch(", False), ("useEffect(a); x => useEffect(b => 1) fetch (", True),
    ("fetch(1); useEffect(() => 1)", False), ("useEffect(fetch(() => 1", False), ("useEffect(", False), (None, False)])
def test_effect_rules_match_their_patterns(spark, t, want):
    from sitelens.functions import patterns as P
    from sitelens.operators.components import effect_then_fetch
    from sitelens.operators.routes import effect_fetches
    df = spark.createDataFrame([(t,)], "t string")
    r = df.select(F.coalesce(effect_fetches(F.col("t")), F.lit(False)).alias("a"), F.coalesce(F.col("t").rlike(P.USE_EFFECT_FETCH_ROUTE), F.lit(False)).alias("b"),
                  F.coalesce(effect_then_fetch(F.col("t")), F.lit(False)).alias("c"),
                  F.coalesce(F.col("t").rlike(r"useEffect\\s*\\([\\s\\S]*?fetch\\s*\\(".replace("\\\\", "\\")), F.lit(False)).alias("d")).first()
    assert r.a == r.b == want and r.c == r.d
