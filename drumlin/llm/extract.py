"""Operator 10, main text of pages by a linear-chain conditional random field.

A page is cut into leaf blocks, the stretches of text between block-level tags. Each block
has features from its ancestors' tags, classes and ids and from its text. An ancestor marks
a part of a page by its element or by a class or id; one that holds the page's head or its
main part is a wrapper and marks nothing, whatever it is called, nor do body and html, nor
names of a state ("has-sidebar", "comments-open"). A linear-chain CRF with the labels content
and boilerplate is trained by maximum likelihood on labelled pages made here (menus, headers,
sidebars, notices, adverts, forms, comments and articles in many layouts and wrappers) and
decodes each page by Viterbi. The content blocks are the main text.

The model is some hundred weights; it is trained on the driver from `pages` labelled pages
(a documented bound, 600) and broadcast. Pages are decoded where they lie, whole, without
a shuffle.

Defined cases. Null or empty html gives the empty text. Markup that is never closed ends
with the page. Repeated rows are extracted each. Null ids and urls pass through. An empty
table gives an empty result. Extra columns are dropped."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.llm.common import in_slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
# Kinds of HTML elements.
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template svg iframe object canvas audio video textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCK - frozenset("button label option optgroup select textarea canvas iframe summary legend".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
# What words in classes and ids say about a part of a page.
CUES = {
    "nav": r"^(nav|menu|breadcrumb|crumb|pagination|pager|toc$|tabs$)|(nav|menu|navigation)$", "head": r"^(header|masthead|topbar|branding|logo|toolbar)|header$",
    "foot": r"^(foot|footer|copyright|legal|imprint|colophon)|footer$", "side": r"^(side|sidebar|aside|widget|related|recommend|popular|trending|rail$)|sidebar$",
    "ad": r"^(ads?$|advert|sponsor|promo|banner|commercial)", "notice": r"^(cookie|consent|notice|alert|gdpr|privacy|popup|modal|overlay|paywall|disclaimer)",
    "form": r"^(form$|search|login|signup|signin|subscribe|subscription|newsletter|register)", "comment": r"^(comment|disqus|replies$|reply$|respond|discussion)", "share": r"^(share|sharing|social|follow$)",
    "main": r"^(article|content|post|entry|main|story|body|text|prose)",
}
CUE_PATTERNS = {k: re.compile(v) for k, v in CUES.items()}
# Words by which a name tells a state or a layout, not what the part is.
STATES = frozenset("has have with without no not is open opened closed enabled disabled layout template active count".split())
SKIPPED = frozenset({"head", "title"})
# Elements that mark a part of a page, and those of them that may not hold the main part.
SECTIONS = frozenset("nav header footer aside form dialog article main".split())
EDGES = frozenset("nav header footer aside".split())


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    names: str  # classes, ids and role
    heads: int = 0  # h1 elements inside
    mains: int = 0
    articles: int = 0
    edges: int = 0  # nav, header, footer and aside elements inside


@dataclass(slots=True)
class Leaf:
    text: str
    path: tuple[Node, ...]  # from the root
    linked: int  # characters inside links


def leaf_blocks(page: str) -> list[Leaf]:
    """The page's leaf blocks in order, white space normalised, references decoded."""
    stack: list[Node] = []
    out: list[Leaf] = []
    parts: list[str] = []
    linked = links = 0
    pos, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text and not any(n.tag in SKIPPED for n in stack):
                out.append(Leaf(text, tuple(stack), min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(tags: set[str], scope: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                flush()
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while pos < size:
        m = TOKEN.search(page, pos)
        stop = m.start() if m else size
        if stop > pos:
            piece = page[pos:stop]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, pos) if not m[3].rstrip().endswith("/") else m
            if tag in BLOCK:
                flush()
            else:
                parts.append(" ")
            pos = max(pos, end.end() if end else size)
            continue
        if tag == "br" or tag in VOID:
            if tag in BLOCK:
                flush()
            else:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in IMPLIED:
                close(IMPLIED[tag], SCOPE[tag])
            links = 0
        if tag == "a":
            links += 1
        names = ""
        if m[3] and len(m[3]) > 3:
            names = " ".join((k.lower() if k.lower() in ("hidden",) else "") + " " + (a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3]) if k.lower() in ("class", "id", "role", "hidden")).lower().strip()
        if not m[3].rstrip().endswith("/") or tag in BLOCK:
            if tag in HOLDING:
                for node in stack:
                    node.heads += tag == "h1"
                    node.mains += tag == "main"
                    node.articles += tag == "article"
                    node.edges += tag in EDGES
            stack.append(Node(tag, names))
    flush()
    return out


HOLDING = EDGES | {"h1", "main", "article"}
_cue_cache: dict[str, tuple[str, ...]] = {}


def cues_of(names: str) -> tuple[str, ...]:
    """What classes and ids say; of a name with a word of state only the words before it."""
    got = _cue_cache.get(names)
    if got is None:
        found = set()
        for name in names.split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            state = next((i for i, w in enumerate(words) if w in STATES), None)
            if state is not None:
                words = words[:state] if words[state] in ("with", "without", "has") else []
            # The last word names the part; what stands before it says of what.
            kinds = [k for w in reversed(words) for k, p in CUE_PATTERNS.items() if p.search(w)]
            beside = [k for k in kinds if k != "main"]
            found.update(beside[:1] or kinds[:1])
        got = tuple(sorted(found))
        if len(_cue_cache) < 10_000:
            _cue_cache[names] = got
    return got


def marks_of(node: Node) -> list[str]:
    """What part of the page an ancestor marks: by its names, boilerplate before main text,
    and by its element. A wrapper of the main part marks nothing, or main text."""
    tag, cues = node.tag, cues_of(node.names)
    if tag in ("html", "body"):
        return []
    beside = [c for c in cues if c != "main"]
    holds_main = node.mains or (node.heads and "head" not in cues) or (node.articles and "comment" not in cues) or node.edges > 1
    if tag in EDGES:
        # A header in an article holds its head; nothing at the page's edges holds a whole article.
        return [tag, *beside]
    if holds_main and tag not in ("article", "main"):
        return ["main"] if "main" in cues else []
    if tag in SECTIONS:
        return [tag, *beside]
    return beside or (["main"] if "main" in cues else [])


def features(block: Leaf, place: int, count: int) -> list[str]:
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    # The nearest ancestor that marks a part of the page says most; then whether any marks boilerplate.
    marks, inside = [], False
    for node in block.path:
        own = marks_of(node)
        if node.tag == "header" and node.heads and inside:
            own = [m for m in own if m not in ("header", "head")]  # the head of the article
        inside = inside or node.tag in ("article", "main")
        marks += own
    beside = {m for m in marks if m not in MAIN_MARKS}
    out = ["near=" + (marks[-1] if marks else "none"), "beside" if beside else "plain", *(f"mark={m}" for m in sorted(set(marks))), f"leaf={block.path[-1].tag if block.path else 'none'}", f"words={min(6, words.bit_length())}", f"link={min(3, 4 * block.linked // max(n, 1))}"]
    if not beside and any(m in MAIN_MARKS for m in marks):
        out.append("main only")
    if text[-1] in ".!?:;\"'":
        out.append("ends")
    if "©" in text:
        out.append("sign")
    if text.count(".") + text.count(",") >= 3:
        out.append("prose")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    out.append("bias")
    return out


MAIN_MARKS = frozenset(("article", "main"))


class Field:
    """A linear-chain CRF with labels 0 boilerplate and 1 content."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        get, (m00, m01, m10, m11) = self.weights.get, self.moves.ravel().tolist()
        back = []
        s0 = s1 = 0.0
        for i, block in enumerate(page):
            e0 = e1 = 0.0
            for f in block:
                w = get(f)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if i == 0:
                s0, s1 = e0, e1
                back.append((0, 1))
                continue
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((0 if a >= b else 1, 0 if c > d else 1))
            s0, s1 = max(a, b) + e0, max(c, d) + e1
        label, out = (0 if s0 > s1 else 1), []
        for prev in reversed(back):
            out.append(label)
            label = prev[label]
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.25, penalty: float = 2e-4) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over all pages at once; the chain's
    expectations come from the forward-backward recursions, run on all pages in parallel."""
    names = sorted({f for page, _ in pages for block in page for f in block})
    at = {f: i for i, f in enumerate(names)}
    longest = max(len(p) for p, _ in pages)
    count = sum(len(p) for p, _ in pages)
    flat, where, row = np.zeros((count, len(names)), dtype=np.float32), np.zeros((2, count), dtype=np.int64), 0
    gold = np.zeros((len(pages), longest), dtype=np.int64)
    mask = np.zeros((len(pages), longest), dtype=np.float64)
    for i, (page, labels) in enumerate(pages):
        for t, block in enumerate(page):
            flat[row, [at[f] for f in block]] = 1
            where[:, row] = i, t
            row += 1
        gold[i, : len(labels)], mask[i, : len(labels)] = labels, 1
    theta = np.zeros(2 * len(names) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    one = np.eye(2)[gold] * mask[..., None]
    pair = (mask[:, 1:] * mask[:, :-1])[..., None, None]
    moved = one[:, :-1, :, None] * one[:, 1:, None, :] * pair
    total = mask.sum()
    for step in range(1, rounds + 1):
        w, moves = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        emit = np.zeros((len(pages), longest, 2))
        emit[where[0], where[1]] = flat @ w.astype(np.float32)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None] > 0, new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0.0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(ahead + behind - whole[:, None, None]) * mask[..., None]
        double = np.exp(ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * pair
        grad = np.concatenate([(flat.T @ (single - one)[where[0], where[1]].astype(np.float32)).ravel(), (double - moved).sum(axis=(0, 1)).ravel()]) / total + penalty * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    w = theta[:-4].reshape(-1, 2)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in at.items()}, theta[-4:].reshape(2, 2))


# Labelled pages

# How pages mark the parts beside the article.
PARTS = {
    "nav": [("nav", ""), ("nav", ""), ("nav", "site-nav"), ("div", "menu"), ("div", "navbar"), ("div", "main-nav"), ("div", "breadcrumbs"), ("ul", "menu")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "topbar")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "page-footer"), ("div", "copyright")],
    "side": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("section", "related"), ("section", "related-posts"), ("div", "recommended"), ("aside", "rail")],
    "ad": [("div", "ad"), ("div", "ads"), ("section", "advert"), ("div", "sponsored"), ("div", "promo"), ("aside", "banner-ad"), ("div", "advertisement"), ("p", "ad")],
    "notice": [("div", "cookie-banner"), ("div", "notice"), ("section", "consent"), ("div", "alert"), ("div", "gdpr"), ("div", "popup"), ("div", "cookie-notice"), ("dialog", "privacy-notice"), ("div", "disclaimer")],
    "form": [("form", ""), ("form", "search"), ("div", "newsletter"), ("div", "signup"), ("div", "subscribe"), ("form", "login-form")],
    "comment": [("section", "comments"), ("div", "comments"), ("ol", "commentlist"), ("div", "disqus-thread"), ("section", "discussion"), ("div", "comment-list"), ("div", "reader-comments")],
    "share": [("div", "share"), ("div", "social"), ("div", "share-buttons"), ("div", "follow-us")],
}


# Names of wrappers around a whole page or around its columns, and of pages' states.
WRAPPERS = ("page", "wrapper", "container", "site", "layout", "grid", "row", "columns", "content-area", "content-with-sidebar", "has-sidebar", "two-col", "inner", "site-content", "outer", "page-layout", "hfeed", "app", "main-wrap")
BODIES = ("", "", "", "home", "single single-post comments-open", "post-template has-sidebar", "page no-comments", "has-header-image menu-open", "layout-sidebar-right", "dark with-ads", "logged-out cookie-notice-open")


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its content blocks. Layouts, wrappers and names vary; some
    pages leave tags open or break off at the end."""
    alphabet = rng.choice(("etaoinshrdlu", "enrisatdhulcgmobwfk", "esaitnrulodcpm", "оеаинтсрвл", "aeosrnidlctu"))
    noise = rng.choice((" ",) * 8 + (" / ", " - ", " * ", " & ", " = ", ", "))  # any kind of text may be an article's

    def word() -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.choice((1, 2, 3, 3, 4, 5, 5, 6, 7, 9, 12))))

    def sentence(n: int) -> str:
        joint = noise if rng.random() < 0.3 else " "
        return joint.join(word() for _ in range(n)).capitalize() + rng.choice((".", ".", ".", "!", "?", "", ":", "…"))

    def text(lo: int, hi: int) -> str:
        return " ".join(sentence(rng.randrange(3, 18)) for _ in range(rng.randrange(lo, hi)))

    def short() -> str:
        return " ".join(word() for _ in range(rng.randrange(1, 5))).title()

    def named(name: str) -> str:
        return rng.choice((f' class="{name}"', f' class="{name}"', f' id="{name}"', f" class={name.split()[0]}", f' class="{word()} {name}"', f" id='{name}' class='{word()}'")) if name else ""

    def box(tag: str, name: str, inner: str) -> str:
        return f"<{tag}{named(name)}>{inner}</{tag}>"

    def links(n: int) -> str:
        each = lambda: f'<a href="/{word()}">{short() if rng.random() < 0.6 else sentence(rng.randrange(4, 9))}</a>'
        return rng.choice(("<ul>" + "".join(f"<li>{each()}</li>" for _ in range(n)) + "</ul>", "<ul>" + "".join(f"<li>{each()}" for _ in range(n)) + "</ul>", " | ".join(each() for _ in range(n)), "".join(f"<div>{each()}</div>" for _ in range(n))))

    def inner() -> str:
        """What any part beside the article may hold: words, links, headings or whole prose."""
        prose = "".join(f"<p>{text(1, 4)}</p>" for _ in range(rng.randrange(1, 4)))
        body = rng.choice((short(), sentence(rng.randrange(3, 14)), links(rng.randrange(2, 7)), prose, prose, f"<p>{short()}</p>", f"<{(h := rng.choice(('h2', 'h3', 'h4')))}>{short()}</{h}>" + rng.choice((prose, links(3)))))
        return box(rng.choice(("div", "section")), rng.choice(("", "inner", "content", "text", "body")), body) if rng.random() < 0.25 else body

    def part(kind: str) -> str:
        tag, name = rng.choice(PARTS[kind])
        body = inner()
        if kind == "form":
            body = rng.choice((f'<label>{short()}</label><input name="q"><button>{short()}</button>', body + f"<input><button>{short()}</button>", f"<p>{text(1, 2)}</p><select><option>{short()}</option></select><textarea>{short()}</textarea>"))
        elif kind == "footer" and rng.random() < 0.4:
            body = rng.choice((f"&copy; {rng.randrange(1990, 2030)} {short()}. {sentence(4)}", f"<p>{short()} &copy;</p>" + links(3), f"<small>{sentence(9)}</small>"))
        elif kind == "comment":
            one = lambda: box(rng.choice(("div", "li", "article")), rng.choice(("comment", "comment-body", "reply", "")), f"<h4>{short()}</h4>" * rng.randrange(2) + inner())
            body = f"<h3>{short()}</h3>" * rng.randrange(2) + "".join(one() for _ in range(rng.randrange(1, 4)))
        elif kind == "header" and rng.random() < 0.5:
            body = rng.choice((f"<h1>{short()}</h1>", f"<h1><a href=/>{short()}</a></h1><p>{sentence(5)}</p>", f"<a href=/>{short()}</a>" + links(3)))
        elif kind == "nav" and rng.random() < 0.6:
            body = links(rng.randrange(2, 8))
        return box(tag, name, sentence(rng.randrange(3, 14)) if tag == "p" else body)

    content: list[str] = []

    def keep(raw: str) -> str:
        content.append(" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in raw else "", raw)).split()))
        return raw

    def styled(raw: str) -> str:
        a, b = rng.choice((("<em>", "</em>"), ("<strong>", "</strong>"), ("<code>", "</code>"), ("<a href='/x'>", "</a>"), ("<math><mi>", "</mi></math>"), ("<span class=x>", "</span>")))
        words = raw.split(" ")
        at = rng.randrange(len(words))
        return " ".join([*words[:at], a + words[at] + b, *words[at + 1 :]])

    def piece() -> str:
        kind = rng.randrange(16)
        if kind < 6:
            return f"<p>{keep(rng.choice((str, styled))(text(1, 6)))}</p>"
        if kind == 6:
            return f"<p>{keep(text(1, 3))}"
        if kind == 7:
            return f"<p>{keep(sentence(rng.randrange(1, 4)))}</p>"
        if kind == 8:
            h = rng.choice(("h2", "h3", "h4"))
            return f"<{h}>{keep(short())}</{h}>"
        if kind == 9:
            items = [keep(rng.choice((str, styled))(sentence(rng.randrange(2, 12)))) for _ in range(rng.randrange(1, 5))]
            tag = rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{x}" + rng.choice(("", "</li>")) for x in items) + f"</{tag}>"
        if kind == 10:
            return f"<blockquote><p>{keep(text(1, 3))}</p></blockquote>"
        if kind == 11:
            return f"<figure><img src=x><figcaption>{keep(sentence(5))}</figcaption></figure>"
        if kind == 12:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(short())}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randrange(1, 3))) + "</table>"
        if kind == 13:
            return f"<div>{keep(text(1, 4))}</div>"
        if kind == 14:
            return f"<p>{keep(sentence(6) + '<br>' + sentence(7))}</p>"
        return f"<pre>{keep(sentence(6))}</pre>" + rng.choice(("", "<script>var a = 1;</script>", "<!-- end -->"))

    def article() -> str:
        parts = []
        if rng.random() < 0.85:
            h = rng.choice(("h1", "h1", "h2"))
            head = f"<{h}>{keep(sentence(rng.randrange(2, 12)))}</{h}>"
            parts.append(f"<header>{head}</header>" if rng.random() < 0.15 else head)
        wrapped = parts and parts[0].startswith("<header")
        for _ in range(rng.randrange(1, 12)):
            if len(parts) > 1 and rng.random() < 0.06:
                parts.append(part(rng.choice(list(PARTS))))
            else:
                parts.append(piece())
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            parts.append(part(rng.choice(list(PARTS))))
        inside = "".join(parts)
        names = ("content", "article-body", "post-content", "entry", "main-content", "story-text", "post", "entry-content", "page-content")
        shapes = [f"<article>{inside}</article>", f"<article>{inside}</article>", box("article", rng.choice(("post", "story", "entry", "article")), inside), f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", box("main", "content", box("div", rng.choice(names), inside))]
        if not wrapped:
            shapes += [box("div", rng.choice(names), inside), box("section", rng.choice(names), inside), box(rng.choice(("div", "section")), "", inside), box("td", "", inside)]
        return rng.choice(shapes)

    kinds = list(PARTS)
    before = [part(rng.choice(kinds)) for _ in range(rng.randrange(0, 4))]
    main = article()
    beside = [part(rng.choice(kinds)) for _ in range(rng.randrange(0, 4))]
    if rng.random() < 0.6:
        before.insert(0, part("nav"))
    if rng.random() < 0.35:  # a column layout around the article and what stands beside it
        main = box("div", rng.choice(WRAPPERS), main + "".join(beside))
        beside = []
    after = beside + ([part("footer")] if rng.random() < 0.7 else [])
    page = "".join(before) + main + "".join(after)
    for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
        page = box("div", rng.choice(WRAPPERS), page)
    if rng.random() < 0.08:
        page = f"<form method=post{named(rng.choice(('', 'form', 'aspnetForm')))}><input type=hidden value=x>{page}</form>"
    body = rng.choice(BODIES)
    top = rng.choice(("<!DOCTYPE html><html>", "<html>", "<!doctype html><HTML lang=x>")) + "<head>" + rng.choice(("", "<meta charset=utf-8>")) + f"<title>{short()}</title>" + rng.choice(("", "<style>a{color:red}</style>", "<script>f('<p>')</script>", "<link rel=x href=y>")) + "</head>"
    page = f"{top}<body{f' class="{body}"' if body else ''}>{page}"
    return page + ("</body></html>" if rng.random() < 0.8 else ""), content


def labelled_blocks(rng: random.Random) -> tuple[list[list[str]], list[int]]:
    page, content = labelled_page(rng)
    blocks = leaf_blocks(page)
    labels, at = [], 0
    for b in blocks:
        inside = at < len(content) and b.text == content[at] and not _stands_aside(b)
        labels.append(int(inside))
        at += inside
    return [features(b, i, len(blocks)) for i, b in enumerate(blocks)], labels


def _stands_aside(block: Leaf) -> bool:
    """Labelling only: boilerplate that happens to read like the next content block."""
    return any(n.tag in ("nav", "footer", "aside") for n in block.path)


_models: dict[tuple[int, int], Field] = {}


def trained_model(pages: int = 600, seed: int = 13) -> Field:
    """The model from `pages` labelled pages; trained once a process."""
    if (pages, seed) not in _models:
        rng = random.Random(seed)
        sample = [p for p in (labelled_blocks(rng) for _ in range(pages)) if p[0]]
        _models[pages, seed] = train(sample)
    return _models[pages, seed]


def main_text(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page) if page else []
    labels = model.decode([features(b, i, len(blocks)) for i, b in enumerate(blocks)]) if blocks else []
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract_pages(pages: DataFrame, *, model: Field | None = None) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(model or trained_model())
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            texts = [main_text(p, held.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
