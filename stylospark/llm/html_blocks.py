"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks. A bidirectional LSTM in numpy reads of
each block a vector of its tag path (elements, classes, ids, hashed), one of its
hashed words and some numbers (its length, links and place, and how much of the
page's text, links and headings the two boxes around it hold), and labels every
block with the whole page as context. It is trained here: on pages laid out by
rule, whose labels are known, filled with words of a bounded sample of the given
pages. Half the layouts have neutral class names and few telling elements, and a
quarter of the rest are read without any class or id, so that a page whose names say
nothing is labelled by its structure.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, column, word_hashes, words

PATH_DIM, WORD_DIM, NUM_DIM, HIDDEN = 48, 24, 17, 24
DIM = PATH_DIM + WORD_DIM + NUM_DIM
#: Pages whose words fill the training layouts, and the number of layouts.
SAMPLE, LAYOUTS = 100, 700

_OPEN, _NEXT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile("[>\"']")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN_ATTR = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template textarea iframe svg canvas audio video select title".split())
#: Those that last to the end of the page where they don't close.
ENDLESS = frozenset("script style textarea title".split())
MATHML = frozenset("math mi mn mo ms mrow msup msub msubsup mfrac msqrt mroot mtext mspace mover munder munderover mtable mtr mtd mlabeledtr mfenced menclose mstyle mpadded mphantom merror mmultiscripts mprescripts maction semantics annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split()) | MATHML
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


#: Elements that hold blocks together, those nested deeper than browsers keep apart, and how much of a path is read.
BOXES = frozenset("div section article main aside nav header footer form body".split())
DEEPEST, OUTER, INNER = 512, 6, 14


class Block(tuple):
    """(tag path, text, share of the text in links), and the numbers of the boxes
    around it, innermost first."""

    boxes: tuple[int, int] = (0, 0)


def tags(page: str):
    """(start, end, slash, name, attributes) of tags, comments and declarations (whose
    name is empty), in order. A tag ends at the first > outside of quotes, or is text.
    Where a search fails from some place, later searches that come there fail at
    once, so the work is linear in the page."""
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    dead: set[int] = set()
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            close = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(close, at + (4 if close == "-->" else 9))
            end = n if end < 0 else end + 3
            yield at, end, "", "", ""
            at = end
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) if at < last[">"] else -1
            end = n if end < 0 else end + 1
            yield at, end, "", "", ""
            at = end
            continue
        m = _OPEN.match(page, at)
        end = m.end() if m else n
        seen: list[int] = []
        while m and end not in dead:
            seen.append(end)
            q = _NEXT.search(page, end) if end <= last[">"] else None
            if q is None:
                break
            if q[0] == ">":
                yield at, q.end(), m[1], m[2], page[m.end() : q.start()]
                at = q.end()
                break
            shut = page.find(q[0], q.end()) if q.start() < last[q[0]] else -1
            if shut < 0:
                break
            end = shut + 1
        if not m or at < m.end():
            dead.update(seen)
            at += 1


def blocks(page: str) -> list[Block]:
    """Each leaf block with text, in order. White space is one space; markup that
    doesn't close is tolerated. Of a path the outermost and innermost elements are
    kept, and elements nested deeper than DEEPEST lie beside one another."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held, over, box, made = {}, {}, [0, 0], 0
    text: list[str] = []
    unclosed: set[str] = set()
    linked, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            got = " ".join("".join(text).split())
            if got:
                near = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                b = Block((" ".join(x[1] for x in near if x[0] not in INLINE or x[1] != x[0]), got, min(1.0, linked / len(got))))
                b.boxes = (box[-1], box[-2])
                out.append(b)
            text.clear()
        linked = 0

    def drop(a: int, b: int | None = None) -> None:
        for x in stack[a:b]:
            held[x[0]] -= 1
            if x[0] in BOXES:
                box.pop()
        del stack[a:b]

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            got = html.unescape(piece)
            text.append(got)
            if held.get("a"):
                linked += len(got.strip())

    for start, stop, slash, name, attrs in tags(page):
        if start < at:
            continue
        say(page[at:start])
        at, name = stop, name.lower()
        if not name:
            continue
        if slash:
            if name not in INLINE:
                flush()
            if over.get(name):
                over[name] -= 1
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if held.get(name) else None
            if depth is not None and not (name in INLINE and any(x[0] not in INLINE for x in stack[depth:])):
                drop(depth)
            elif depth is not None:
                drop(depth, depth + 1)
            continue
        if name == "svg" and attrs.endswith("/"):
            continue
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None:
                unclosed.add(name)
            if end or name in ENDLESS:
                if name != "svg":
                    flush()
                at = end.end() if end else n
                continue
        if name not in INLINE:
            flush()
            closing = CLOSES.get(name, set()) | ({"p"} if name in P_ENDS else set())
            for i in range(len(stack) - 1, -1, -1) if any(held.get(c) for c in closing) else ():
                if stack[i][0] in closing:
                    drop(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "div", "article", "section", "body") and name != "p":
                    break
        elif name == "br":
            text.append(" ")
        if name in VOID or attrs.endswith("/") and name in INLINE:
            continue
        if len(stack) >= DEEPEST:
            over[name] = over.get(name, 0) + 1
            continue
        names = " ".join("." + w for g in NAMES.findall(attrs) for w in re.split(r"[\s_-]+", "".join(g).lower()) if w)
        hide = " .hidden" if HIDDEN_ATTR.search(attrs) else ""
        stack.append((name, f"{name} {names}{hide}".strip() if names or hide else name))
        held[name] = held.get(name, 0) + 1
        if name in BOXES:
            made += 1
            box.append(made)
    say(page[at:])
    flush()
    return out


_PATHS: dict[str, np.ndarray] = {}


def path_vector(path: str) -> np.ndarray:
    """Hashed elements, classes and ids of a path; the last few weigh more."""
    got = _PATHS.get(path)
    if got is None:
        got, parts = np.zeros(PATH_DIM), path.split()
        for i, p in enumerate(parts):
            for salt in (b"1", b"2"):
                h = zlib.crc32(salt + p.encode())
                got[h % PATH_DIM] += (1.0 if h >> 16 & 1 else -1.0) * (1.5 if i >= len(parts) - 2 else 1.0)
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = got
    return got


def _boxes(page: list[Block], size: np.ndarray, heads: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For both boxes around each block: its share of the page's text, its number of
    blocks, the share of links in it, whether it has a heading; and whether each box is that of the block before."""
    out = []
    for level in range(2):
        ids = np.array([getattr(b, "boxes", (0, 0))[level] for b in page])
        _, own = np.unique(ids, return_inverse=True)
        text = np.bincount(own, size)
        out += [(text / max(1.0, size.sum()))[own], np.minimum(1.2, np.log1p(np.bincount(own)) / 3)[own], (np.bincount(own, size * linked) / np.maximum(1, text))[own], (np.bincount(own, heads) > 0)[own].astype(float), np.concatenate(([0.0], ids[1:] == ids[:-1]))]
    return np.stack(out, 1)


def vectors(page: list[Block], names: bool = True) -> np.ndarray:
    """(blocks x DIM) input of the labeller, with or without classes and ids."""
    n = len(page)
    x = np.zeros((n, DIM), np.float64)
    if not n:
        return x
    raw = [t.encode() for _, t, _ in page]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    start, end, at = words(data, offs)
    h = word_hashes(data, start, end)
    count = np.diff(at)
    own = np.repeat(np.arange(n), count)
    hashed = np.zeros((n, WORD_DIM))
    np.add.at(hashed, (own, (h % U64(WORD_DIM)).astype(np.int64)), np.where(h >> U64(63), 1.0, -1.0))
    paths = [p if names else re.sub(r" ?\.\S+", "", p) for p, _, _ in page]
    x[:, :PATH_DIM] = [path_vector(p) for p in paths]
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = 0.3 * hashed / np.sqrt(np.maximum(count, 1))[:, None]
    signs = [sum(map(t.count, ".,;!?")) for _, t, _ in page]
    share, length = np.array([s for _, _, s in page]), np.diff(offs).astype(float)
    heads = np.array([bool(re.search(r"\bh[1-3]$", p)) for p in paths], float)
    first = np.stack((np.minimum(1.5, np.log1p(count) / 3), np.minimum(1.3, np.log1p(np.diff(offs)) / 5), share, np.minimum(1, np.array(signs) / np.maximum(count, 1)), np.arange(n) / n, np.ones(n), np.minimum(1.0, n / 40) * np.ones(n)), 1)
    x[:, -NUM_DIM:] = np.concatenate((first, _boxes(page, length, heads, share)), 1)
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[d + "x"] = rng.normal(0, 0.15, (DIM, 4 * HIDDEN))
            self.w[d + "h"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.w[d + "b"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        self.w["o"], self.w["c"] = rng.normal(0, 0.15, 2 * HIDDEN), np.zeros(1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        size, steps = x.shape[:2]
        zx = x @ self.w[d + "x"] + self.w[d + "b"]
        h, c = np.zeros((size, HIDDEN)), np.zeros((size, HIDDEN))
        hs, saved = np.zeros((size, steps, HIDDEN)), []
        for t in range(steps):
            z = zx[:, t] + h @ self.w[d + "h"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep:
                saved.append((h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            hs[:, t] = h
        return hs, saved

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, sa = self._run("f", x, mask, keep)
        b, sb = self._run("b", x[:, ::-1], mask[:, ::-1], keep)
        both = np.concatenate((a, b[:, ::-1]), 2)
        return both @ self.w["o"] + self.w["c"], both, sa, sb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        z, both, sa, sb = self.logits(x, mask, True)
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        grad = {"o": np.einsum("bt,bth->h", dz, both), "c": np.array([dz.sum()])}
        dh_all = dz[:, :, None] * self.w["o"]
        for d, saved, own, xin in (("f", sa, dh_all[:, :, :HIDDEN], x), ("b", sb, dh_all[:, ::-1, HIDDEN:], x[:, ::-1])):
            gx, gh = np.zeros((len(x), x.shape[1], 4 * HIDDEN)), np.zeros_like(self.w[d + "h"])
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t in range(x.shape[1] - 1, -1, -1):
                h0, c0, i, f, o, g, th, m = saved[t]
                dh = dh + own[:, t]
                live_h, live_c = dh * m, dc * m
                dct = live_c + live_h * o * (1 - th**2)
                zz = np.concatenate((dct * g * i * (1 - i), dct * c0 * f * (1 - f), live_h * th * o * (1 - o), dct * i * (1 - g**2)), 1)
                gx[:, t] = zz
                gh += h0.T @ zz
                dh, dc = zz @ self.w[d + "h"].T + dh * (1 - m), dct * f + dc * (1 - m)
            grad[d + "x"], grad[d + "h"], grad[d + "b"] = np.einsum("btd,btz->dz", xin, gx), gh, gx.sum((0, 1))
        return grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 40, rate: float = 0.02, seed: int = 4) -> None:
        """Adam on batches of pages of like length."""
        rng, m, v, k = np.random.default_rng(seed), {}, {}, 0
        for r in range(rounds):
            step = rate * (1 - r / rounds)
            by = sorted(range(len(pages)), key=lambda i: (len(pages[i]) + rng.integers(0, 4)))
            for a in (rng.permutation(-(-len(by) // 40)) * 40).tolist():
                part = [pages[i] for i in by[a : a + 40]]
                x, mask = padded(part)
                y = np.zeros(mask.shape)
                for row, i in enumerate(by[a : a + 40]):
                    y[row, : len(labels[i])] = labels[i]
                k += 1
                for key, g in self.gradients(x, mask, y).items():
                    m[key] = 0.9 * m.get(key, 0) + 0.1 * g
                    v[key] = 0.99 * v.get(key, 0) + 0.01 * g * g
                    self.w[key] = self.w[key] - step * (m[key] / (1 - 0.9**k)) / (np.sqrt(v[key] / (1 - 0.99**k)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """True for every block of the main text; pages of like length together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 128 and (b - a + 1) * len(pages[order[b]]) <= 16384:
                b += 1
            x, mask = padded([pages[i] for i in order[a:b]])
            z = self.logits(x, mask)[0]
            for r, i in enumerate(order[a:b]):
                out[i] = z[r, : len(pages[i])] > 0
            a = b
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(len(p) for p in pages))
    x, mask = np.zeros((len(pages), steps, DIM)), np.zeros((len(pages), steps))
    for r, p in enumerate(pages):
        x[r, : len(p)], mask[r, : len(p)] = p, 1
    return x, mask


def layout(rng: np.random.Generator, vocabulary: list[str], plain: bool = False) -> tuple[str, list[int]]:
    """A page by rule and the labels of its blocks, 1 for the main text. A plain one
    has class names that say nothing, and boxes instead of most telling elements."""
    say = lambda lo, hi: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(lo, hi + 1)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    maybe = lambda p: rng.random() < p
    out, y = ["<html><head><title>" + say(2, 6) + "</title></head><body>"], []

    def put(markup: str, text: str, label: int) -> None:
        out.append(markup.replace("@", html.escape(text)))
        y.append(label)

    def menu(k: int) -> None:
        for _ in range(k):
            put('<li><a href="/x">@</a></li>', say(1, 2), 0)

    def group(tag: str, attr: str, fill) -> None:
        if plain and tag in BOXES and tag != "form" and maybe(0.75):
            tag = "div"
        out.append(f"<{tag}{attr}>")
        fill()
        out.append(f"</{tag}>")

    def attr(*names: str) -> str:
        if plain and maybe(0.85):
            return pick("", f' class="{pick("k", "c", "x", "b", "box", "m", "t")}{rng.integers(0, 40)}"', f' id="{pick("k", "c", "x", "b", "e")}{rng.integers(0, 40)}"')
        return f' {pick("class", "class", "id")}="{pick(*names)}"'

    def notice():
        group("div", attr("cookie", "cookie-banner", "notice", "consent", "alert", "popup", "gdpr", "banner", "message"), lambda: put("<p>@</p>" if maybe(0.5) else "@", say(5, 30), 0))

    def advert():
        group(pick("div", "div", "aside", "section"), attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"), lambda: put(pick("@", "<p>@</p>", '<a href="/">@</a>'), say(3, 25), 0))

    def form():
        group("form", attr("search", "newsletter", "subscribe", "login", "signup") if maybe(0.6) else "", lambda: put(pick("<label>@</label><input>", "<p>@</p><button></button>", "<div>@<input></div>"), say(1, 20), 0))

    def related():
        group(pick("div", "section", "aside", "nav"), attr("related", "related-posts", "share", "social", "tags", "breadcrumb", "breadcrumbs", "recommended", "popular", "pagination", "read-more"), lambda: [put(pick("<p><a href='/'>@</a></p>", "<li><a href='/'>@</a></li>", "<h4>@</h4>"), say(1, 9), 0) for _ in range(rng.integers(1, 5))])

    def sidebar():
        group(*pick(("aside", ""), ("aside", attr("sidebar", "widget")), ("div", attr("sidebar", "side", "widget", "widget-area", "right-rail"))), lambda: [put(pick("<h3>@</h3>", "<p>@</p>", "<li><a href='/'>@</a></li>"), say(1, 30), 0) for _ in range(rng.integers(1, 6))])

    def head():
        group("header", attr("header", "site-header", "masthead", "top") if maybe(0.4) else "", lambda: [put(pick("<h1>@</h1>", "<div>@</div>", "<a href='/'>@</a>", "<p>@</p>"), say(1, 6), 0) for _ in range(rng.integers(1, 3))])

    def comments():
        group(pick("section", "div", "ol"), attr("comments", "comment-list", "comments-area", "disqus", "discussion", "replies"), lambda: [group(pick("div", "article", "li", "p"), attr("comment", "comment-body", "reply", "user-comment") if maybe(0.7) else "", lambda: put(pick("@", "<p>@</p>"), say(3, 60), 0)) for _ in range(rng.integers(1, 5))])

    def body():
        if maybe(0.9):
            put(pick("<h1>@</h1>", "<h1>@</h1>", "<header><h1>@</h1></header>", '<h1 class="title">@</h1>'), say(2, 12), 1)
        for _ in range(rng.integers(1, 60 if maybe(0.1) else 14)):
            if maybe(0.2):
                pick(advert, advert, related, form, sidebar, notice)()
            kind = rng.random()
            if kind < 0.72:
                text, size = html.escape(say(1, 160 if maybe(0.7) else 8)), rng.random()
                out.append(f"<p><b>{text}<br>" if size < 0.15 else f"<p>{text}</p>" if size < 0.9 else f"<div>{text}</div>")
                y.append(1)
            elif kind < 0.8:
                put(pick("<h2>@</h2>", "<h3>@</h3>", "<h4>@</h4>"), say(1, 9), 1)
            elif kind < 0.88:
                group(pick("ul", "ol"), "", lambda: [put(pick("<li>@</li>", "<li>@ <a href='/y'>" + say(1, 3) + "</a></li>"), say(1, 25), 1) for _ in range(rng.integers(1, 5))])
            elif kind < 0.94:
                put(pick("<blockquote>@</blockquote>", "<blockquote><p>@</p></blockquote>", "<pre>@</pre>"), say(3, 50), 1)
            else:
                group("table", "", lambda: [put(f"<tr><{pick('td', 'th')}>@", say(1, 6), 1) for _ in range(rng.integers(1, 5))])
        if maybe(0.12):
            comments()

    for part in ((notice, 0.3), (head, 0.4), (lambda: group("nav", attr("menu", "navbar", "nav", "main-nav") if maybe(0.4) else "", lambda: group("ul", "", lambda: menu(int(rng.integers(2, 9))))), 0.85), (lambda: group("div", attr("menu", "nav", "navigation", "navbar", "topbar", "toolbar"), lambda: group("ul", "", lambda: menu(4))), 0.15), (advert, 0.45), (form, 0.15), (sidebar, 0.2)):
        if maybe(part[1]):
            part[0]()
    outer = pick(None, None, ("main", ""), ("div", attr("wrapper", "container", "page", "row", "site")))
    inner = pick(("article", ""), ("article", ""), ("article", attr("post", "entry", "story")), ("main", ""), ("div", attr("content", "article", "post", "entry-content", "main", "article-body", "post-content", "story", "text")), ("section", attr("content", "article", "story")))
    group(*outer, lambda: group(*inner, body)) if outer else group(*inner, body)
    for part in ((comments, 0.35), (related, 0.3), (sidebar, 0.25), (advert, 0.2), (form, 0.15), (notice, 0.1)):
        if maybe(part[1]):
            part[0]()
    if maybe(0.85):
        group(pick("footer", "footer", "div"), attr("footer", "site-footer", "copyright", "legal", "bottom"), lambda: [put(pick("@", "<p>@</p>", "<li><a href='/'>@</a></li>", "&copy; @"), say(1, 25), 0)])
    return "".join(out) + "</body></html>", y


def train(given: list[list[Block]], layouts: int = LAYOUTS, seed: int = 9) -> Labeller:
    """A labeller of generated pages, filled with the words of the given ones;
    given pages whose only candidate is one article element, without parts that
    a layout would call boilerplate, join them. A layout whose blocks the parser
    joins otherwise than the rule meant is left out."""
    vocabulary = sorted({w for page in given for _, t, _ in page for w in t.split()}) or ["word"]
    rng, pages, labels = np.random.default_rng(seed), [], []
    for page in given:
        inside = [p for p, _, _ in page if " article" in p]
        if inside and all(p.count("article") == 1 and p.split("article", 1)[1].strip() in ("", "p", "h1", "h2", "h3", "ul li", "ol li", "blockquote") for p in inside):
            pages.append(vectors(page)), labels.append(np.array([float(" article" in p) for p, _, _ in page]))
    for i in range(layouts):
        page, y = layout(rng, vocabulary, plain=i % 2 == 1)
        found = blocks(page)
        if len(found) == len(y):
            pages.append(vectors(found, names=i % 8 != 0)), labels.append(np.array(y, float))
    model = Labeller()
    model.fit(pages, labels)
    return model


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of pages: page_id, url, text (the main blocks, joined by
    one space; empty if none), n_chars. Null html is empty; character references
    are decoded; the pages of the smallest page_id hashes, `sample` at most, lend
    their words to training. An empty table gives an empty table; other columns
    are ignored."""
    src = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"))
    ids = src.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    some = src.join(F.broadcast(ids), "page_id").orderBy("page_id", F.xxhash64("html")).limit(sample).select("html").collect()
    model = train([blocks(r["html"]) for r in some])
    sent = src.sparkSession.sparkContext.broadcast(model.w)

    def run(batches):
        m = Labeller()
        m.w = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [blocks(t) for t in part.column(2).to_pylist()]
                good = m.label([vectors(f) for f in found])
                text = [" ".join(b[1] for b, g in zip(f, y) if g) for f, y in zip(found, good)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
