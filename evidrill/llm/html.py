"""Main text of web pages by a tree-structured graphical model.

A page becomes the tree of its block elements.  Each node is content or not; its features
(tag, words of class, id and role, length and link share of its own and of all its text)
have a potential, and each parent and child have one together.  Sum-product messages go up
the tree and down again, which gives every node's exact marginal; text whose own node is
content with at least one half is kept.  The potentials are smoothed log counts over
labelled pages, ``training_pages`` unless others are given.

Scripts, styles and the like never count as text, nor do forms, unless a form wraps the page's
body (it holds an article, a main part or the first heading, or most of the text in several
paragraphs).  Character references are decoded; white space in a block (line breaks too)
becomes one blank; blocks are joined by two line feeds.  Pages may be malformed: open elements
end where HTML ends them, stray end tags are ignored, elements nested deeper than ``DEPTH``
belong to the last one within.  The time is linear in the length of a page.

Null, empty or textless pages give the empty text, an empty table an empty result.  A node
whose marginal is exactly one half is content.  Rows are kept as often as they come, and equal
pages get equal texts.  A column of the output's name is replaced, other columns are kept.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, column, table

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
#: Their content is not text.
DROPPED = frozenset("script style noscript template iframe svg math canvas object audio video head title select textarea button datalist dialog".split())
_RAW = frozenset("script style noscript template iframe textarea title".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body div section article main aside nav header footer hgroup p h1 h2 h3 h4 h5 h6 ul ol menu li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption form fieldset address details summary center".split()) | DROPPED
#: What a start tag ends, up to the elements that hold it in.
_ENDS_P = BLOCKS - {"head", "title", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "select", "textarea", "button", "datalist", "html", "body", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption"} | {"hr"}
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Elements nested deeper belong to the last one within.
DEPTH = 512
_FENCE = frozenset("table td th article section main aside nav header footer div blockquote li form figure details".split())


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str = ""
    own: int = 0  # characters of its own text, and of these in links
    own_linked: int = 0
    all: int = 0  # of its and its descendants' text
    all_linked: int = 0
    last: str = ""
    form: int = -1  # the form that it is or lies in


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("#page", -1)])
    runs: list[tuple[int, str]] = field(default_factory=list)  # (node, text), in page order


def parse(source: str) -> Page:
    page = Page()
    nodes = page.nodes
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements with the node their text belongs to
    text: list[str] = []
    linked = [0]
    dropped = links = at = 0

    def flush() -> None:
        if text:
            run = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            text.clear()
            if run:
                node = nodes[stack[-1][1]]
                page.runs.append((stack[-1][1], run))
                node.own += len(run)
                node.own_linked += min(linked[0], len(run))
                node.last = run[-1]
            linked[0] = 0

    def pop() -> None:
        nonlocal dropped, links
        tag = stack[-1][0]
        if tag in BLOCKS:
            flush()
        stack.pop()
        open_[tag] -= 1
        dropped -= tag in DROPPED
        links -= tag == "a"

    def end_open(tags: set | frozenset, fence: set | frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in fence:
                return

    def add(piece: str) -> None:
        if piece and not dropped:
            text.append(piece)
            if links:
                linked[0] += len(piece)

    open_, beyond = Counter[str](), Counter[str]()  # of elements in the stack, and nested too deep for it
    loose = False  # quotes that are never closed are no quotes
    last_end = source.rfind(">")
    while (start := source.find("<", at)) >= 0:
        add(source[at:start])
        at = start + 1
        if (m := _MARK.match(source, start)) is not None:
            at = m.end()
            continue
        m = None if loose or start > last_end else _TAG.match(source, start)
        if m is None and start <= last_end and (m := _LOOSE_TAG.match(source, start)) is not None:
            loose = True
        if m is None:
            add("<")
            continue
        at, tag = m.end(), m[2]
        tag = tag.lower()
        if m[1]:
            if beyond[tag]:
                beyond[tag] -= 1
                if tag in BLOCKS:
                    flush()
            elif tag == "p" and not open_["p"]:
                flush()
            elif open_[tag]:
                if tag in BLOCKS or tag in ("td", "th", "a"):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                else:  # an inline end tag doesn't end blocks
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k]
                            open_[tag] -= 1
                            break
                        if stack[k][0] in BLOCKS:
                            break
            continue
        if tag in ("br", "hr", "td", "th"):
            add(" ")
        if tag in _ENDS_P and open_["p"]:
            end_open({"p"}, _FENCE)
        if tag in _SIBLING and any(open_[x] for x in _SIBLING[tag][0]):
            end_open(*_SIBLING[tag])
        if tag == "hr":
            flush()
        if tag in _VOID:
            continue
        if tag in ("html", "body") and open_[tag]:
            continue
        if tag in _RAW:
            close = _RAW_END[tag].search(source, at)
            flush()
            at = close.end() if close else len(source)
            continue
        if len(stack) > DEPTH:
            beyond[tag] += 1
            if tag in BLOCKS:
                flush()
            continue
        open_[tag] += 1
        if tag in BLOCKS:
            flush()
            nodes.append(Node(tag, stack[-1][1], m[3] or "", form=len(nodes) if tag == "form" else nodes[stack[-1][1]].form))
            stack.append((tag, len(nodes) - 1))
            dropped += tag in DROPPED
        else:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
    add(source[at:])
    flush()
    _drop_forms(page)
    for n in reversed(nodes):
        n.all += n.own
        n.all_linked += n.own_linked
        if n.parent >= 0:
            nodes[n.parent].all += n.all
            nodes[n.parent].all_linked += n.all_linked
    return page


def _drop_forms(page: Page) -> None:
    """Takes the text of forms off, but of those that only wrap a page's body."""
    own, blocks = Counter[int](), Counter[int]()
    wraps = set()
    for n in page.nodes:
        if n.form >= 0:
            own[n.form] += n.own
            blocks[n.form] += n.tag in ("p", "h1", "h2", "h3") and n.own > 0
            if n.tag in ("article", "main", "h1"):
                wraps.add(n.form)
    total = sum(n.own for n in page.nodes)
    wraps |= {f for f, n in own.items() if 2 * n > total and blocks[f] > 2}
    if own.keys() - wraps:
        page.runs = [(i, t) for i, t in page.runs if page.nodes[i].form < 0 or page.nodes[i].form in wraps]
        for n in page.nodes:
            if n.form >= 0 and n.form not in wraps:
                n.own = n.own_linked = 0


def _length(n: int) -> str:
    return "0" if n == 0 else "25" if n <= 25 else "80" if n <= 80 else "300" if n <= 300 else "1000" if n <= 1000 else "more"


def _share(part: int, whole: int) -> str:
    return "none" if not part else "low" if 10 * part < 3 * whole else "half" if 10 * part < 7 * whole else "high"


def features(n: Node) -> list[str]:
    kind = ":list" if n.tag in ("li", "ul", "ol", "menu") else ""
    out = ["own:" + _length(n.own), "links:" + _share(n.own_linked, n.own) + kind]
    if n.own:
        out.append("stop:" + str(n.last in ".!?\"'”…:;"))
    else:
        out.append("linked:" + _share(n.all_linked, n.all) + kind)
    if n.attributes:
        names = set()
        for k, a, b, c in _ATTRIBUTE.findall(n.attributes):
            if k.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                names.update(x.lower() for x in _PART.findall(a or b or c))
        out += ["name:" + x for x in sorted(names)]
        if names:
            return [*out, "tag:" + n.tag]
    return [*out, "bare:" + n.tag]


@dataclass
class TreeModel:
    """Log potentials: of features by state, of parent and child states, of the root."""

    unary: dict[str, tuple[float, float]]
    pair: list[list[float]]
    root: list[float]

    @classmethod
    def fit(cls, pages: list[tuple[Page, list[int]]], smooth: float = 0.5) -> TreeModel:
        """From pages with the state of every node."""
        count: list[Counter] = [Counter(), Counter()]
        states, pair, root = [0, 0], [[1.0, 1.0], [1.0, 1.0]], [1.0, 1.0]
        for page, state in pages:
            root[state[0]] += 1
            for n, s in zip(page.nodes, state, strict=True):
                states[s] += 1
                count[s].update(set(features(n)))
                if n.parent >= 0:
                    pair[state[n.parent]][s] += 1
        unary = {f: (math.log((count[0][f] + smooth) / (states[0] + 2 * smooth)), math.log((count[1][f] + smooth) / (states[1] + 2 * smooth))) for f in count[0].keys() | count[1].keys()}
        return cls(unary, [[math.log(x / sum(r)) for x in r] for r in pair], [math.log(x / sum(root)) for x in root])

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each node: messages from the leaves up, then from the root down."""
        nodes = page.nodes
        local = []
        for n in nodes:
            got = [self.unary[f] for f in features(n) if f in self.unary]
            local.append([sum(g[0] for g in got), sum(g[1] for g in got)])
        up = [[0.0, 0.0] for _ in nodes]  # message of each node to its parent
        below = [list(x) for x in local]
        p = self.pair
        for i in range(len(nodes) - 1, 0, -1):
            b = below[i]
            for s in (0, 1):
                up[i][s] = _log_add(p[s][0] + b[0], p[s][1] + b[1])
            q = below[nodes[i].parent]
            q[0] += up[i][0]
            q[1] += up[i][1]
        belief = [[0.0, 0.0] for _ in nodes]
        belief[0] = [self.root[0] + below[0][0], self.root[1] + below[0][1]]
        for i in range(1, len(nodes)):
            a = belief[nodes[i].parent]
            rest = [a[0] - up[i][0], a[1] - up[i][1]]
            for s in (0, 1):
                belief[i][s] = below[i][s] + _log_add(rest[0] + p[0][s], rest[1] + p[1][s])
            top = max(belief[i])
            belief[i] = [belief[i][0] - top, belief[i][1] - top]
        return [1 / (1 + math.exp(min(50.0, b[0] - b[1]))) for b in belief]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        if not page.runs:
            return ""
        content = self.marginals(page)
        return "\n\n".join(t for i, t in page.runs if content[i] >= 0.5)


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


# -- labelled pages -----------------------------------------------------------------------


def training_pages(n: int = 400, seed: int = 7) -> list[tuple[Page, list[int]]]:
    """Labelled pages in many layouts: an element's mark ``data-y`` (1: content) holds for what is in it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeinorst bcdlmpu".replace(" ", "")) for _ in range(r.randint(1, 9)))

    def words(a: int, b: int, stop: str = "") -> str:
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize() + stop

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/{word()}">{words(a, b)}</a>'

    def para() -> str:
        size = r.choice([(1, 3), (4, 15), (15, 60), (60, 160)])
        inner = words(*size, stop=r.choice([".", ".", ".", "", "!", "?"]))
        if r.random() < 0.2:
            inner += " " + link() + " " + words(2, 9, ".")
        if r.random() < 0.15:
            inner = f"<b>{inner}</b>" if r.random() < 0.5 else inner + "<br>" + words(3, 20, ".")
        return f"<p>{inner}</p>"

    def noise(kind: str) -> str:
        text = r.choice([words(1, 6), words(3, 14, "."), words(8, 40, "."), words(1, 4) + " " + link()])
        body = r.choice([text, f"<p>{text}</p>", f"<div>{text}</div>", f"<span>{text}</span>"])
        name = {
            "nav": ["nav", "navigation", "menu", "top-menu", "breadcrumb", "navbar", "main-nav"], "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"],
            "side": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending"], "notice": ["notice", "cookie", "cookie-notice", "consent", "gdpr", "alert", "popup", "paywall"],
            "foot": ["footer", "site-footer", "copyright", "legal", "bottom"], "head": ["header", "site-header", "masthead", "top", "logo", "branding"], "comments": ["comments", "comment-list", "discussion", "replies", "responses"],
            "share": ["share", "social", "share-buttons", "follow"], "join": ["newsletter", "subscribe", "signup", "login", "search"],
        }[kind]
        attribute = f' {r.choice(["class", "id"])}="{r.choice(name)}"'
        if kind == "nav":
            items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
            body = f"<ul>{items}</ul>" if r.random() < 0.8 else " ".join(link() for _ in range(4))
            tag = r.choice(["nav", "nav", "div", "ul" if body[1] != "u" else "nav"])
            return f'<{tag} data-y="0"{attribute if tag != "nav" or r.random() < 0.5 else ""}>{body}</{tag}>'
        if kind == "comments":
            each = "".join(f'<{(t := r.choice(["div", "li", "article"]))} class="comment"><p>{words(3, 40, ".")}</p>{"<div class=reply>" + words(3, 20, ".") + "</div>" if r.random() < 0.3 else ""}</{t}>' for _ in range(r.randint(1, 5)))
            tag = r.choice(["section", "div", "aside"])
            return f'<{tag} data-y="0"{attribute}><h{(h := r.choice("23"))}>{words(1, 3)}</h{h}>{each}</{tag}>'
        if kind == "side" and r.random() < 0.6:
            body = f"<h3>{words(1, 4)}</h3><ul>" + "".join(f"<li>{link(2, 8)}</li>" for _ in range(r.randint(2, 7))) + "</ul>"
        tag = {"foot": r.choice(["footer", "footer", "div"]), "head": r.choice(["header", "header", "div"]), "side": r.choice(["aside", "aside", "div", "section"])}.get(kind, r.choice(["div", "div", "section", "aside"]))
        bare = tag in ("footer", "header", "aside") and r.random() < 0.5
        return f'<{tag} data-y="0"{"" if bare else attribute}>{body}</{tag}>'

    def content() -> str:
        parts = [f"<h1>{words(2, 14)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 12)):
            parts.append(r.choices([para, lambda: f"<h2>{words(1, 8)}</h2>", lambda: f"<{(t := r.choice(['ul', 'ul', 'ol']))}>" + "".join(f"<li>{words(1, r.choice([4, 8, 20]), r.choice(['', '', '.']))}</li>" for _ in range(r.randint(2, 7))) + f"</{t}>", lambda: f"<blockquote>{para()}</blockquote>", lambda: f"<pre>{words(3, 20)}</pre>", lambda: f"<figure><figcaption>{words(2, 12, '.')}</figcaption></figure>", lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", lambda: f"<div>{words(10, 60, '.')}</div>", lambda: f"<section>{para()}{para()}</section>"], [14, 2, 3, 1, 1, 1, 1, 1, 1])[0]())
            if r.random() < 0.08:
                parts.append(noise(r.choice(["ad", "side", "share", "join", "notice"])))
        return "".join(parts)

    pages = []
    for _ in range(n):
        tag, attribute = r.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ' id="main-text"')])
        inner = f'<{tag} data-y="1"{attribute}>{content()}'
        if r.random() < 0.25:
            inner += noise("comments")
        inner += f"</{tag}>"
        if r.random() < 0.3:
            inner = f'<{(t := r.choice(["main", "div"]))}>{inner}</{t}>'
        bare = r.random() < 0.12  # content lies in the body itself
        if bare:
            inner = content()
        before = [noise(k) for k in ("head", "nav", "notice", "ad") if r.random() < 0.55]
        after = [noise(k) for k in ("comments", "side", "share", "join", "ad", "foot") if r.random() < 0.45]
        r.shuffle(before)
        page = parse(f'<html data-y="{int(bare)}"><body data-y="{int(bare)}">{"".join(before)}{inner}{"".join(after)}</body></html>' if r.random() < 0.95 else "".join(x for x in (inner,) if bare) or f'<body data-y="0">{inner}')
        state: list[int] = []
        for node in page.nodes:
            own = re.search(r'data-y="([01])"', node.attributes)
            state.append(int(own[1]) if own else state[node.parent] if node.parent >= 0 else int(bare))
        pages.append((page, state))
    return pages


def extract(pages: DataFrame, model: TreeModel | None = None, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out string``: the main text of the column ``html``."""
    from pyspark.sql import types as T

    kept = pages.drop(*[c for c in pages.columns if c == out])
    shared = pages.sparkSession.sparkContext.broadcast(model or TreeModel.fit(training_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.text(x) for x in column(b, html)], pa.string())], names=[*b.schema.names, out])

    return arrow_map(kept, run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
