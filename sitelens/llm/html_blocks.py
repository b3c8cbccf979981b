"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block
tags.  Each block is a vector of its hashed tag path (tag names, class and id
words of all open elements), hashed words, lengths and link share.  A
bidirectional LSTM in numpy reads the whole sequence and decides for every
block whether it belongs to the article, so a block is judged in the context
of the document around it.  Pages are read in batches of similar length.

The labeller is trained here, on pages generated from rules: article, menu,
header, footer, sidebar, notice, advert, form and comment blocks in many
markups (``make_page``).  No page of the input is learned from.

Defined results: null and empty pages give an empty text.  Scripts, styles,
templates and comments are never blocks.  Character references are decoded,
white space inside a block becomes one space, blocks are joined by one.
An unclosed tag at the end of a cut page is dropped; a cut reference stays as
text.  Parsing and features are linear in the page, however deep its elements
nest and whatever it leaves open; a worker holds ``BATCH_BLOCKS`` blocks or
``BATCH_BYTES`` bytes of pages at a time, or one page, whose sequence is read
in pieces.  Rows with equal ids, and columns of any name, are carried as they
are; a column named like ``out`` is replaced.  An empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitelens.llm.common import packed, release, session, unpacked

PATH, TEXT, HIDDEN = 96, 24, 20
DENSE = 12
WIDTH = PATH + TEXT + DENSE
SEED, PAGES, EPOCHS, RATE = 11, 1200, 12, 0.02
# Blocks that one pass of the network holds at most, padding included.
CELLS = 1 << 15
# Blocks and bytes of the pages that a worker holds at a time.
BATCH_BLOCKS, BATCH_BYTES = 1 << 15, 1 << 23

_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
              "small span strike strong sub sup time tt u var wbr br".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Formulas are part of their block's text; drawings and frames are none.
_MATH = set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
            "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_RAW = set("script style template textarea noscript title svg annotation annotation-xml iframe select".split())
_SKIP = _RAW - {"textarea"}
#: Only these take the rest of the page where their end is missing.
_CODE = {"script", "style"}
#: Elements that a new one of the key closes when they are open.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
           "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "table", "div", "section", "article", "main", "td", "th", "dl", "body", "aside", "nav"}
_ENDS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@functools.lru_cache(maxsize=65536)
def _slot(kind: str, word: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % size


@functools.lru_cache(maxsize=16384)
def _path_bits(tag: str, marks: str) -> int:
    words = {w for m in _ATTRIBUTE.findall(marks) for w in _WORD.findall(m.lower())}
    bits = 1 << _slot("tag", tag, PATH)
    for w in words:
        bits |= 1 << _slot("mark", w, PATH)
    return bits


class _Open:
    """The open elements, outermost first.  Each holds the path bits of all
    down to it; tags are counted, in all and since the last element that keeps
    its content apart, so that no look-up walks the stack in vain."""

    def __init__(self):
        self.tags: list[str] = []
        self.bits = [0]
        self.count: dict[str, int] = {}
        self.inside: list[dict[str, int]] = [{}]

    def push(self, tag: str, marks: str) -> None:
        self.tags.append(tag)
        self.bits.append(self.bits[-1] | _path_bits(tag, marks))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in _SCOPE:
            self.inside.append({})
        level = self.inside[-1]
        level[tag] = level.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.tags.pop()
        self.bits.pop()
        self.count[tag] -= 1
        if tag in _SCOPE:
            self.inside.pop()
        else:
            self.inside[-1][tag] -= 1
        return tag

    def close(self, tags: set[str]) -> None:
        """Close open elements of these tags up to one that keeps apart."""
        while any(self.inside[-1].get(t) for t in tags):
            while self.pop() not in tags:
                pass


def blocks(page: str) -> list[tuple[tuple[int, int], str, int, int]]:
    """(path, text, characters in links, inline tags) of each leaf block;
    path: the hashed tags and attributes of the open elements, their number."""
    out: list = []
    stack = _Open()
    text: list[str] = []
    linked = inline = 0
    in_link = 0
    endless: set[str] = set()  # tags without an end in the rest of the page

    def flush():
        nonlocal linked, inline
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(((stack.bits[-1], len(stack.tags)), joined, linked, inline))
            text.clear()
        linked = inline = 0

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag:
            token = m[0]
            if token[0] != "<" or token == "<":
                text.append(token)
                if in_link:
                    linked += len(token)
            continue
        if not (m[4] or m[8]):
            break  # the page ends inside this tag
        closing, marks = bool(m[1] or m[5]), m[3] or m[7] or ""
        if tag in _MATH:
            continue
        if closing:
            if tag in _INLINE:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                continue
            if stack.count.get(tag):
                flush()
                while stack.pop() != tag:
                    pass
                in_link = 0
            continue
        if tag in _RAW:
            flush()
            if marks.rstrip().endswith("/") and tag not in _CODE:
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not end:
                endless.add(tag)
            if tag not in _SKIP and end:
                text.append(page[at:end.start()])
                stack.push(tag, marks)
                flush()
                stack.pop()
            at = end.end() if end else len(page) if tag in _CODE else at
            continue
        if tag in _INLINE:
            inline += 1
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link += 1
            continue
        flush()
        in_link = 0
        stack.close(_CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set()))
        if tag not in _VOID and not marks.rstrip().endswith("/"):
            stack.push(tag, marks)
    flush()
    return out


def features(found: list, first: int = 0, last: int | None = None) -> np.ndarray:
    """A row for each block from ``first`` to before ``last`` of a page's."""
    part = found[first:last]
    x = np.zeros((len(part), WIDTH))
    paths = b"".join(path[0].to_bytes(PATH // 8, "little") for path, *_ in part)
    x[:, :PATH] = np.unpackbits(np.frombuffer(paths, np.uint8).reshape(-1, PATH // 8), axis=1, bitorder="little")
    for i, (path, text, linked, inline) in enumerate(part):
        words = text.split()
        for w in words:
            x[i, PATH + _slot("word", w.lower().strip(".,;:!?"), TEXT)] += 1
        x[i, PATH:PATH + TEXT] /= len(words)
        n = len(text)
        ends, digits = sum(map(text.count, ".!?")), sum(map(text.count, "0123456789"))
        x[i, PATH + TEXT:] = (np.log1p(n) / 6, np.log1p(len(words)) / 5, min(linked / n, 1), min(inline / len(words), 1),
                              ends / n * 10, text[-1] in ".!?\"", path[1] / 10, (first + i) / len(found),
                              text[0].isupper(), "©" in text, digits / n, 1)
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs over the block sequence and a logistic output."""

    def __init__(self, rng: np.random.Generator):
        def init(a, b):
            return rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (
            ("x", init(WIDTH, 4 * HIDDEN)), ("h", init(HIDDEN, 4 * HIDDEN)), ("o", np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])))}
        self.w |= {"out": init(2 * HIDDEN, 1)[:, 0], "skip": init(WIDTH, 1)[:, 0] * 0.1, "bias": np.zeros(1)}

    def _run(self, x, mask, d, keep):
        """One direction; x: (time, pages, width)."""
        steps, n, _ = x.shape
        w, u, b = self.w["x" + d], self.w["h" + d], self.w["o" + d]
        pre = x @ w + b
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, saved = np.zeros((steps, n, HIDDEN)), []
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            z = pre[t] + h @ u
            f, i, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                saved.append((t, h, c, f, i, o, g, tc))
            h, c = h2, c2
            out[t] = h
        return out, saved

    def forward(self, x, mask, keep=False):
        f, sf = self._run(x, mask, "f", keep)
        b, sb = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.w["out"] + x @ self.w["skip"] + self.w["bias"][0], both, sf, sb

    def gradients(self, x, mask, y):
        s, both, sf, sb = self.forward(x, mask, True)
        ds = np.where(mask, _sigmoid(s) - y, 0) / mask.sum()
        grads = {"out": np.einsum("tnh,tn->h", both, ds), "skip": np.einsum("tnw,tn->w", x, ds), "bias": np.array([ds.sum()])}
        for d, saved, part in (("f", sf, slice(0, HIDDEN)), ("b", sb, slice(HIDDEN, None))):
            u = self.w["h" + d]
            gx, gh, go = np.zeros_like(self.w["x" + d]), np.zeros_like(u), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, h, c, f, i, o, g, tc in reversed(saved):
                m = mask[t][:, None]
                dh = dh + ds[t][:, None] * self.w["out"][part]
                dco = np.where(m, dh * o * (1 - tc ** 2) + dc, 0)
                dz = np.where(m, np.concatenate([dco * c * f * (1 - f), dco * g * i * (1 - i),
                                                 dh * tc * o * (1 - o), dco * i * (1 - g ** 2)], 1), 0)
                gx += x[t].T @ dz
                gh += h.T @ dz
                go += dz.sum(0)
                dh = np.where(m, dz @ u.T, dh)
                dc = np.where(m, dco * f, dc)
            grads |= {"x" + d: gx, "h" + d: gh, "o" + d: go}
        return grads

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Article or not, for every block (of ``blocks``) of every page; pages
        of similar length go through together, a page of more than ``CELLS``
        blocks by itself."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= CELLS:
                end += 1
            part = order[at:end]
            if len(pages[part[0]]) > CELLS:
                out[part[0]] = self._long(pages[part[0]]) >= 0
            else:
                x, mask = _pad([features(pages[i]) for i in part])
                s = self.forward(x, mask)[0]
                for k, i in enumerate(part):
                    out[i] = s[:len(pages[i]), k] >= 0
            at = end
        return out

    def _long(self, found: list, step: int = CELLS // 4) -> np.ndarray:
        """Scores of one page's blocks, ``step`` of them in memory at a time:
        each direction carries its state from piece to piece."""
        scores = np.zeros(len(found))
        pieces = [(a, min(a + step, len(found))) for a in range(0, len(found), step)]
        for d, part, turn in (("f", slice(0, HIDDEN), 1), ("b", slice(HIDDEN, None), -1)):
            # sigmoid(x) = (1 + tanh(x / 2)) / 2: one tanh serves gates and input.
            half = np.concatenate([np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)])
            u, h, c = self.w["h" + d] * half, np.zeros(HIDDEN), np.zeros(HIDDEN)
            for a, b in pieces[::turn]:
                x = features(found, a, b)
                pre = (x @ self.w["x" + d] + self.w["o" + d]) * half
                states = np.empty((b - a, HIDDEN))
                for t in range(b - a)[::turn]:
                    z = np.tanh(pre[t] + h @ u)
                    gates = (z[:3 * HIDDEN] + 1) * 0.5
                    c = gates[:HIDDEN] * c + gates[HIDDEN:2 * HIDDEN] * z[3 * HIDDEN:]
                    h = gates[2 * HIDDEN:] * np.tanh(c)
                    states[t] = h
                scores[a:b] += states @ self.w["out"][part]
                if d == "f":
                    scores[a:b] += x @ self.w["skip"] + self.w["bias"][0]
        return scores


def _pad(pages):
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH)), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, True
    return x, mask


# -- training pages ----------------------------------------------------------

# Marks that pages put on the parts of their layout.
MARKS = {
    "article": "article post entry content main story body text post-content entry-content article-body page-content markdown prose",
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager tabs toc site-nav main-menu links skip",
    "header": "header masthead top-bar topbar banner site-header logo branding search",
    "footer": "footer site-footer copyright bottom colophon legal foot credits",
    "aside": "sidebar aside related widget recommended trending popular side rail more tags archive",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay newsletter subscribe subscription paywall banner-cookie",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense ad-slot ad-banner dfp",
    "form": "form login signup contact search-form comment-form subscribe-form",
    "comments": "comments comment comment-list replies reply discussion disqus responses reviews thread comment-body",
    "share": "share social sharing follow share-buttons social-links",
}
MARKS = {k: v.split() for k, v in MARKS.items()}


class _Page:
    """Writes a page and remembers which blocks are the article's."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.out, self.truth = rng, [], []

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        made = ["".join("aeioubcdfglmnprstvzéüñ"[int(k)] for k in self.rng.integers(0, 22, int(self.rng.integers(1, 11)))) for _ in range(n)]
        for i in range(len(made)):
            if i == 0 or made[i - 1].endswith("."):
                made[i] = made[i].capitalize()
            elif self.chance(0.08):
                made[i] += self.pick(".", ",", "***", "$$$", "!!", " |", ".")
        return html.escape(" ".join(made) + ("." if self.chance(0.7) else ""), quote=False)

    def block(self, tag: str, text: str, article: bool, marks: str = "") -> None:
        if article and self.chance(0.15):
            text = self.pick(f"<b>{text}", f"<strong>{text}</strong>", f"<i>{text}<br>", f'<a href="/x">{text}</a>', f"<b>{text}<br>", f"<span>{text}</span>")
        close = "" if tag in ("p", "li") and self.chance(0.15) else f"</{tag}>"
        self.out.append(f"<{tag}{marks}>{text}{close}")
        self.truth.append(article)

    def mark(self, kind: str) -> str:
        word = self.pick(*MARKS[kind])
        return self.pick(f' class="{word}"', f' id="{word}"', f' class="x-{word} box"', f' class="{word} {word}-inner"')

    def links(self) -> None:
        shape = self.pick("ul", "ul", "a", "div")
        n = int(self.rng.integers(2, 9))
        if shape == "ul":
            self.out.append("<ul>")
            for _ in range(n):
                self.block("li", f'<a href="/x">{self.words(1, 3)}</a>', False)
            self.out.append("</ul>")
        elif shape == "a":
            self.block("div", " ".join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(n)), False)
        else:
            for _ in range(n):
                self.block("div", f'<a href="/x">{self.words(1, 3)}</a>', False)

    def prose(self, article: bool, low: int, high: int, plain: bool = False) -> None:
        for _ in range(int(self.rng.integers(low, high + 1))):
            kind = "p" if plain or self.chance(0.75) else self.pick("h2", "h3", "li", "blockquote", "td", "pre", "figcaption", "p", "div")
            text = self.words(1, 60) if self.chance(0.7) else self.words(1, 5)
            if kind in ("li", "td"):
                self.out.append("<ul>" if kind == "li" else "<table><tr>")
                for _ in range(int(self.rng.integers(1, 5))):
                    self.block(kind, self.words(1, 15), article)
                self.out.append("</ul>" if kind == "li" else "</tr></table>")
            else:
                self.block(kind, text, article)

    def part(self, kind: str) -> None:
        """A part of the layout that is not article."""
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        semantic = own and self.chance(0.6)
        tag = own if semantic else self.pick("div", "section", "div")
        self.out.append(f"<{tag}{self.mark(kind) if not semantic or self.chance(0.4) else ''}>")
        if kind in ("nav", "share"):
            self.links()
        elif kind == "header":
            if self.chance(0.5):
                self.block(self.pick("h1", "div", "p"), self.words(1, 5), False)
            if self.chance(0.5):
                self.links()
            if self.chance(0.3):
                self.block("p", self.words(3, 12), False)
        elif kind == "footer":
            if self.chance(0.4):
                self.links()
            text = self.pick("&copy; ", "&copy; 2024 ", "&#169; ", "") + self.words(1, 14)
            self.block(self.pick("p", "div", "small", "p") if self.chance(0.7) else "div", text, False)
        elif kind == "aside":
            self.block(self.pick("h2", "h3", "h4"), self.words(1, 4), False)
            self.pick(self.links, lambda: self.prose(False, 1, 4))()
        elif kind == "form":
            for _ in range(int(self.rng.integers(1, 4))):
                self.block(self.pick("p", "label", "div", "legend") if self.chance(0.7) else "div", self.words(1, 6) + '<input name="q">', False)
            self.block("button", self.words(1, 2), False)
        elif kind == "comments":
            if self.chance(0.6):
                self.block("h3", self.words(1, 3), False)
            for _ in range(int(self.rng.integers(1, 6))):
                self.out.append(f"<div{self.mark('comments')}>")
                if self.chance(0.5):
                    self.block(self.pick("div", "h4"), self.words(1, 3), False)
                self.prose(False, 1, 3, True)
                self.out.append("</div>")
        else:  # ad, notice
            if self.chance(0.5):
                self.out.append(self.words(2, 25))
                self.truth.append(False)
            else:
                self.prose(False, 1, 2, True)
            if kind == "notice" and self.chance(0.6):
                self.block("button", self.words(1, 2), False)
        self.out.append(f"</{tag}>")

    def body(self) -> None:
        some = [k for k in ("notice", "header", "nav", "ad", "nav") if self.chance(0.5)]
        for k in some:
            self.part(k)
            if k == "header" and self.chance(0.2):
                self.out.append("<!-- x -->")
        wrap = self.chance(0.3)
        if wrap:
            self.out.append(self.pick("<main>", '<div class="container">', '<div id="page">', '<div class="row">'))
            if self.chance(0.3):
                self.part("aside")
        shape = self.pick("article", "article", "article", "main", "div", "section")
        self.out.append(f"<{shape}{self.mark('article') if shape in ('div', 'section') or self.chance(0.3) else ''}>")
        if self.chance(0.85):
            head = self.chance(0.15)
            if head:
                self.out.append('<div class="title">')
            self.block("h1", self.words(1, 12), True)
            if head:
                self.out.append("</div>")
        inner = [k for k in ("ad", "share", "aside", "notice", "form", "ad") if self.chance(0.15)]
        self.prose(True, 0 if self.chance(0.05) else 1, 14)
        for k in inner:
            self.part(k)
            self.prose(True, 1, 5)
        if self.chance(0.15):
            self.part("comments")
        self.out.append(f"</{shape}>")
        for k in ("share", "comments", "aside", "form", "ad"):
            if self.chance(0.3):
                self.part(k)
        if wrap:
            self.out.append("</main>" if "<main>" in self.out else "</div>")
        for k in ("aside", "nav", "footer", "notice", "footer"):
            if self.chance(0.45):
                self.part(k)


def make_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it is the article's."""
    p = _Page(rng)
    p.out.append('<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>')
    p.body()
    p.out.append("</body></html>")
    return "".join(p.out), p.truth


@functools.lru_cache(maxsize=2)
def trained(seed: int = SEED, pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller after training on ``pages`` generated pages."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < pages:
        page, truth = make_page(rng)
        found = blocks(page)
        if found and len(found) == len(truth):
            xs.append(features(found))
            ys.append(np.array(truth, float))
    model = Labeller(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    order = np.argsort([len(x) for x in xs], kind="stable")
    batches = np.array_split(order, max(1, pages // 24))
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            part = batches[b]
            x, mask = _pad([xs[i] for i in part])
            y = np.zeros(mask.shape)
            for k, i in enumerate(part):
                y[:len(ys[i]), k] = ys[i]
            step += 1
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, d in model.gradients(x, mask, y).items():
                d = d + 1e-5 * model.w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                model.w[k] = model.w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def extract(page: str | None, model: Labeller) -> str:
    found = blocks(page or "")
    return " ".join(b[1] for b, k in zip(found, model.label([found])[0]) if k)


def _together(texts: pa.Array, model: Labeller) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts of the articles) for runs of pages that fit a worker."""
    first, found, held, size = 0, [], 0, 0
    for i, t in enumerate(texts):
        page = t.as_py() or ""
        found.append(blocks(page))
        held, size = held + len(found[-1]), size + len(page)
        if held >= BATCH_BLOCKS or size >= BATCH_BYTES or i + 1 == len(texts):
            yield first, [" ".join(b[1] for b, k in zip(f, ks) if k) for f, ks in zip(found, model.label(found))]
            first, found, held, size = i + 1, [], 0, 0


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text",
                 carry: tuple[str, ...] | None = None) -> DataFrame:
    """``pages`` (or their ``carry`` columns) with each one's main text as
    ``out``; a column of that name is replaced."""
    spark = session(pages)
    shared = spark.sparkContext.broadcast(trained().w)
    base = packed(pages, html_col, out, carry)

    def run(batches):
        model = Labeller(np.random.default_rng(0))
        model.w = shared.value
        for batch in batches:
            rows, texts = batch.column(batch.schema.get_field_index("row")), batch.column(batch.schema.get_field_index("text"))
            for at, done in _together(texts, model):
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(done)), pa.array(done, pa.string())], names=["row", "text"])
        release()

    return unpacked(base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("text", T.StringType())])), "text", out)
