"""Main text of web pages by boosted trees over DOM nodes and a decoding of the whole tree.

A page is parsed into block nodes; formatting within a block makes no node. Each node has features: tag, attribute
tokens, depth, place among siblings, text density and link density of its subtree, and what stands above it. Boosted
trees of fixed depth tell how likely the node belongs to the article. Decoding keeps or drops whole subtrees: dropping
a node drops all below it, and a node stays if its own score and what its best-kept children add is positive. So a
kept node never stands below a dropped one.

The trees are trained on the driver, on pages made from templates whose article is known (``training_pages``), a fixed
number whatever the data. Character references are decoded, white space in a block becomes one space, blocks follow in
page order with two line ends between. Null or empty html, and pages without an article, give the empty text. Pages are
independent, so repeated rows need no rule. Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyline.llm.common import in_arrow

BLOCKS = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset figure figcaption blockquote pre address details summary dialog menu hgroup search select option button iframe object noscript template legend".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp noembed noframes svg math iframe".split())
CONTROLS = frozenset("input button select textarea option label".split())
CLOSES_P = BLOCKS - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "button", "legend"}
#: A start tag ends the open element of the first set unless one of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
#: Tokens of class, id and role that speak against and for the article.
AGAINST = frozenset(
    "nav navbar navigation menu menus footer foot header masthead topbar sidebar side aside rail ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations trending popular more comment comments commentlist discussion disqus reply replies respond reader form login search breadcrumb breadcrumbs pager pagination widget toolbar skip hidden copyright legal tags meta".split()
)
IN_FAVOUR = frozenset("article articles content contents main post entry story body text prose maintext copy".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|aria-label|hidden|data-kept)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
TAGS = ("p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "figure", "blockquote", "pre", "body", "dialog")
ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form", "ul")


class Page(NamedTuple):
    tag: list[str]
    parent: list[int]
    attrs: list[str]
    runs: list[tuple[int, list[str]]]  # node and text pieces, in page order
    links: list[int]  # characters of link text right in the node
    controls: list[int]


#: What a paragraph's end does not reach beyond.
KEEPS_P = ("button", "table", "td", "th", "object")


class _Open:
    """The open elements, with the places of each name, so that no lookup walks the stack."""

    def __init__(self) -> None:
        self.names: list[str] = ["html"]
        self.nodes: list[int] = [0]  # the block node that each stands in
        self.at: dict[str, list[int]] = {"html": [0]}
        self.blocks: list[int] = [0]

    def push(self, name: str, node: int) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if name in BLOCKS:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def pop(self) -> str:
        name = self.names.pop()
        self.nodes.pop()
        self.at[name].pop()
        if name in BLOCKS:
            self.blocks.pop()
        return name

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost element of these names, 0 if none is open."""
        return max((places[-1] for n in names if (places := self.at.get(n))), default=0)


def pieces(source: str) -> Iterator[tuple[str | None, re.Match | None]]:
    """The texts between tags and the tags, in order; comments and declarations are left out. After a tag the reader may send
    the place where reading goes on."""
    at, begun, size = 0, 0, len(source)
    last_close = source.rfind(">")
    while (at := source.find("<", at)) >= 0 and at < last_close:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = size if end < 0 else end + 3
            m = None
        elif source[at + 1] in "!?":
            end, m = source.find(">", at + 2) + 1, None
            if not end:
                break
        elif (m := TAG.match(source, at)) is not None:
            end = m.end()
        else:
            at += 1
            continue
        if begun < at:
            yield source[begun:at], None
        at = begun = end
        if m is not None and (on := (yield None, m)) is not None:
            at = begun = on
            yield None, None
    if 0 <= at < size and source.startswith("<!--", at):
        if begun < at:
            yield source[begun:at], None
    elif begun < size:
        yield source[begun:], None


def parse(source: str) -> Page:
    page = Page(["html"], [-1], [""], [], [0], [0])
    open_ = _Open()
    fresh, link = True, 0

    def text(piece: str) -> None:
        nonlocal fresh
        node = open_.nodes[-1]
        if fresh or not page.runs or page.runs[-1][0] != node:
            if not piece.strip():
                return
            page.runs.append((node, []))
            fresh = False
        page.runs[-1][1].append(piece)
        if link:
            page.links[node] += len(piece)

    def close(k: int) -> None:
        nonlocal fresh, link
        while len(open_.names) > k:
            name = open_.pop()
            link -= name == "a" and link > 0
            fresh = fresh or name in BLOCKS

    reader = pieces(source)
    for piece, m in reader:
        if piece is not None:
            text(piece)
            continue
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            k = open_.last([name])
            # Formatting does not end a block.
            if k and (name in BLOCKS or name == "a" or k > open_.blocks[-1]):
                close(k)
            continue
        node = open_.nodes[-1]
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, m.end())
            page.controls[node] += name == "textarea"
            reader.send(end.end() if end else len(source))
            continue
        page.controls[node] += name in CONTROLS
        if name in VOID:
            if name == "br":
                text(" ")
            elif name == "hr":
                fresh = True
            continue
        if name in ("html", "body") and open_.at.get(name):
            continue
        if name in CLOSES_P and (k := open_.last(["p"])) > open_.last(KEEPS_P):
            close(k)
        if name in ENDS:
            ended, stop = ENDS[name]
            while (k := open_.last(ended)) > open_.last(stop):
                close(k)
                if name != "tr":
                    break
        if name in BLOCKS:
            page.tag.append(name)
            page.parent.append(open_.nodes[-1])
            page.attrs.append(m[3])
            page.links.append(0)
            page.controls.append(0)
            open_.push(name, len(page.tag) - 1)
            fresh = True
        elif not m[3].endswith("/"):
            open_.push(name, open_.nodes[-1])
            link += name == "a"
    return page


_tokens: dict[str, tuple[int, int, int]] = {}


def _hits(attrs: str) -> tuple[int, int, int]:
    """Attribute tokens against and for the article, and whether it is hidden."""
    if not attrs:
        return 0, 0, 0
    if (found := _tokens.get(attrs)) is None:
        if len(_tokens) > 50_000:
            _tokens.clear()
        against = favour = hidden = 0
        for a in ATTRIBUTE.finditer(attrs):
            hidden |= a[1].lower() == "hidden"
            words = [w.lower() for w in WORD.findall(a[2] or a[3] or a[4] or "")]
            against += sum(w in AGAINST or w.rstrip("s") in AGAINST for w in words)
            favour += sum(w in IN_FAVOUR for w in words)
        found = _tokens[attrs] = against, favour, hidden
    return found


#: Elements that name the article themselves, the first two of ABOVE.
SAYS_ARTICLE = ABOVE[:2]
FEATURES = 23 + len(TAGS) + len(ABOVE)


def features(page: Page) -> list[list[float]]:
    n = len(page.tag)
    own, runs, stops = [0] * n, [0] * n, [0] * n
    for node, pieces in page.runs:
        said = sum(map(len, pieces))
        own[node] += said
        runs[node] += 1
        stops[node] += sum(p.count(".") + p.count(",") for p in pieces)
    text, link, tags, control, paras, stop = own[:], page.links[:], [1] * n, page.controls[:], [0] * n, stops[:]
    holds = [int(t in SAYS_ARTICLE) for t in page.tag]
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        for x in (text, link, tags, control, stop, holds):
            x[up] += x[k]
        paras[up] += paras[k] + (page.tag[k] == "p")
        kids[up].append(k)
    depth, above, against_above, favour_above, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    place = [0] * n
    code = {t: 1 << i for i, t in enumerate(ABOVE)}
    out: list[list[float]] = []
    total, seen = max(text[0], 1), 0
    for k in range(n):
        up = page.parent[k]
        if up >= 0:
            depth[k] = depth[up] + 1
            above[k] = above[up] | code.get(page.tag[up], 0)
            a, f, h = _hits(page.attrs[up])
            against_above[k], favour_above[k] = against_above[up] + a + h, favour_above[up] + f
            place[k] = len(kids[up]) - 1 - kids[up].index(k) if len(kids[up]) < 64 else 32
        before[k] = seen
        seen += own[k]
        a, f, h = _hits(page.attrs[k])
        brothers = len(kids[up]) if up >= 0 else 1
        t = text[k]
        row = [
            min(a, 3), min(f, 3), h, min(against_above[k], 3), min(favour_above[k], 3), min(depth[k], 12), min(brothers, 40), place[k] / max(brothers, 1),
            np.log1p(t), np.log1p(own[k]), min(link[k] / max(t, 1), 1.0), np.log1p(t / tags[k]), t / total, t / max(text[up], 1) if up >= 0 else 1.0,
            min(control[k], 5), np.log1p(paras[k]), min(stop[k] / max(t, 1), 0.2), before[k] / total, min(runs[k], 10), float(page.tag[k][0] == "h" and page.tag[k][1:].isdigit()),
            min(holds[0], 2), float(holds[k] > 0), float(holds[0] > 0 and not holds[k] and not above[k] & 3),
        ]
        row += [float(page.tag[k] == x) for x in TAGS]
        row += [float(above[k] >> i & 1) for i in range(len(ABOVE))]
        out.append(row)
    return out


class Trees(NamedTuple):
    start: float
    feature: np.ndarray  # tree x inner node
    limit: np.ndarray
    leaf: np.ndarray  # tree x leaf


DEPTH, ROUNDS, RATE, BINS = 3, 50, 0.25, 24


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log-odds of y: second-order gains over quantile bins, complete trees of fixed depth."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    cuts = [np.unique(np.concatenate([c, [(x[:, j].min() + x[:, j].max()) / 2]])) for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    raw = np.full(n, start)
    trees = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, limit = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            for j in range(f):
                size = len(cuts[j]) + 1
                key = (node - first) * size + binned[:, j]
                gs = np.bincount(key, g, wide * size).reshape(wide, size).cumsum(1)
                hs = np.bincount(key, h, wide * size).reshape(wide, size).cumsum(1)
                score = lambda a, b: a * a / (b + 1.0)
                gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                at = gain[:, :-1].argmax(1)
                for w in range(wide):
                    if gain[w, at[w]] > best[w] + 1e-9:
                        best[w] = gain[w, at[w]]
                        feature[first + w], limit[first + w] = j, cuts[j][at[w]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1.0)
        raw += value[leaf]
        trees.append((feature, limit, value))
    return Trees(start, *(np.stack(v) for v in zip(*trees, strict=True)))


def log_odds(x: np.ndarray, t: Trees) -> np.ndarray:
    out, rows = np.full(len(x), t.start), np.arange(len(x))
    for feature, limit, leaf in zip(t.feature, t.limit, t.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        out += leaf[node - (2**DEPTH - 1)]
    return out


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes stay: the labelling of best total log-odds in which nothing stays below what is dropped."""
    n = len(page.tag)
    holds = [0] * n
    for node, _ in page.runs:
        holds[node] += 1
    # A node without text of its own only carries its children: its own odds decide against them, never for them.
    gain = [float(np.clip(o, -8, 8)) for o in odds]
    worth = [g if holds[k] else min(g, 0.0) for k, g in enumerate(gain)]
    for k in range(n - 1, 0, -1):
        if worth[k] > 0:
            worth[page.parent[k]] += worth[k]
    kept = [False] * n
    for k in range(n):
        kept[k] = worth[k] > 0 and (k == 0 or kept[page.parent[k]])
    return kept


def main_text(page: Page, kept: list[bool]) -> str:
    out = []
    for node, pieces in page.runs:
        if kept[node] and (block := " ".join(entities.unescape("".join(pieces)).split())):
            out.append(block)
    return "\n\n".join(out)


def training_pages(count: int = 480, seed: int = 11) -> Iterator[str]:
    """Pages from templates. data-kept marks what belongs to the article; it is no feature."""
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    line = lambda a, b: " ".join(r.choice(words) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(a, b))).capitalize() + "."
    name = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    menu = lambda n: "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(words, n)) + "</ul>"
    attr = lambda *tokens: f' {r.choice(["class", "id", "class"])}="{r.choice(tokens)}"'
    kept = " data-kept"

    def small() -> list[str]:
        return [
            f"<nav{r.choice(['', attr('nav', 'main-menu', 'navbar')])}>{menu(r.randint(3, 9))}</nav>",
            f"<div{attr('menu', 'nav-bar', 'topNavigation', 'breadcrumbs')}>{menu(r.randint(2, 7))}</div>",
            f"<header{r.choice(['', attr('site-header', 'masthead')])}><{(h := r.choice(['h1', 'h2', 'div', 'p']))}>{name(1, 4)}</{h}>{r.choice(['', '<p>' + line(3, 9) + '</p>', menu(4)])}</header>",
            f"<div{attr('header', 'masthead', 'site-header')}><p>{line(2, 8)}</p></div>",
            f"<aside{r.choice(['', attr('sidebar', 'related')])}><h3>{name(1, 3)}</h3>{r.choice([menu(4), '<p>' + line(5, 40) + '</p>'])}</aside>",
            f"<div{attr('sidebar', 'side-bar', 'related-posts', 'rail', 'widget')}><h3>{name(1, 3)}</h3><p>{line(4, 30)}</p>{r.choice(['', menu(3)])}</div>",
            f"<div{attr('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'banner')}>{r.choice([line(3, 25), '<p>' + line(3, 40) + '</p>'])}</div>",
            f"<div{attr('cookie-notice', 'notice', 'cookie-banner', 'consent', 'alert', 'newsletter')}><p>{line(4, 25)}</p>{r.choice(['', '<button>OK</button>'])}</div>",
            f"<form{r.choice(['', attr('search', 'signup', 'login-form')])}><label>{name(1, 3)}</label><input><p>{line(2, 9)}</p><button>{name(1, 2)}</button></form>",
            f"<div{attr('share', 'social-links', 'pagination', 'tags')}>{menu(3)}</div>",
        ]

    def comments() -> str:
        each = "".join(f"<{t}{r.choice(['', attr('comment', 'reply', 'comment-body')])}><p>{line(4, 60)}</p></{t}>" for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
        return f"<{(t := r.choice(['section', 'div', 'aside']))}{attr('comments', 'comment-list', 'reader-comments', 'discussion', 'respond')}><h2>{name(1, 2)}</h2>{each}</{t}>"

    def article() -> str:
        parts = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            size = r.choice([(1, 2), (1, 4), (4, 12), (15, 60), (40, 160)])
            said = r.choice([line(*size), f'{line(*size)} <a href="/x">{name(1, 4)}</a> {line(2, 9)}', f"<b>{line(*size)}<br>", f"<b>{name(1, 3)}</b> {line(*size)}"])
            parts.append(f"<p{kept}>{said}" + r.choice(["</p>", "</p>", ""]))
            if r.random() < 0.12:
                parts.append(r.choice([f"<h2{kept}>{name(1, 6)}</h2>", f"<ul{kept}>" + "".join(f"<li{kept}>{line(2, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<blockquote{kept}><p{kept}>{line(5, 30)}</p></blockquote>", f"<pre{kept}>{line(3, 20)}</pre>", f"<table{kept}><tbody{kept}><tr{kept}><td{kept}>{name(1, 3)}</td><td{kept}>{name(1, 3)}</td></tr></tbody></table>", f"<div{kept}>{line(8, 60)}</div>", f"<figure{kept}><img><figcaption{kept}>{line(2, 9)}</figcaption></figure>"]))
            if r.random() < 0.06:
                parts.append(r.choice(small()))
        title = f"<h1{kept}>{name(2, 12)}</h1>"
        title = r.choice([title, title, f"<header{kept}>{title}</header>", ""])
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        mark = attr("content", "post-body", "entry-content", "article", "main-content", "story") if tag in ("div", "section") else r.choice(["", "", attr("post", "article", "content")])
        return f"<{tag}{mark}{kept}>{title}{''.join(parts)}{r.choice(['', '', comments()])}</{tag}>"

    for _ in range(count):
        top, end = r.sample(small(), r.randint(0, 3)), r.sample(small(), r.randint(0, 2))
        foot = r.choice([f"<footer>&copy; {name(1, 3)} &middot; {line(2, 24)}</footer>", f"<div{attr('footer', 'site-footer', 'copyright')}><p>{line(2, 12)}</p></div>", f"<footer><p>{line(3, 20)}</p>{menu(4)}</footer>", ""])
        inner = "".join([*top, article(), *end, r.choice(["", "", comments()]), foot])
        wrap = r.choice(["{}", "{}", f"<div{attr('wrapper', 'page', 'container', 'layout')}{kept}>{{}}</div>", f"<main{kept}>{{}}</main>"])
        yield f"<!DOCTYPE html><html><head><title>{name(2, 5)}</title></head><body{kept}>{wrap.format(inner)}</body></html>"


def train() -> Trees:
    x: list[list[float]] = []
    y: list[float] = []
    for source in training_pages():
        page = parse(source)
        marked = [k == 0 or "data-kept" in a for k, a in enumerate(page.attrs)]
        for k, row in enumerate(features(page)):
            if page.tag[k] != "head":
                x.append(row)
                y.append(float(marked[k]))
    return grow(np.array(x), np.array(y))


PAGES_AT_ONCE = 128


def extract_texts(sources: list[str], trees: Trees) -> list[str]:
    pages = [parse(s) for s in sources]
    rows = [features(p) for p in pages]
    if not rows:
        return []
    odds = np.split(log_odds(np.concatenate([np.array(r) for r in rows]), trees), np.cumsum([len(r) for r in rows])[:-1])
    return [main_text(p, decode(p, o)) for p, o in zip(pages, odds, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row of pages."""
    held = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES_AT_ONCE):
                b = batch.slice(k, PAGES_AT_ONCE)
                said = extract_texts([x or "" for x in b.column("html").to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(said, pa.string())], ["page_id", "url", "text"])

    return in_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string")
