"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A page becomes its leaf blocks in order: runs of text without a block boundary. Each block
has indicator features: tags of its ancestors, words of their class and id names, pairs of
sectioning ancestors, share of linked text, length, punctuation and place. The CRF has a
weight for each feature and label (article or not) and for each pair of labels in a row;
it is trained by maximum likelihood on labelled pages and decoded by Viterbi.

Labelled pages come from ``labelled_pages``, which writes pages of many layouts (semantic
tags, named divs, tables, bare bodies) and marks the article's text with a private
character; a caller may give other pages marked the same way.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

# fixed values: element names of HTML, by role
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg math canvas audio video noembed noframes".split())
SECTION = frozenset("article aside main nav header footer section form table ul ol dl figure blockquote details dialog menu fieldset".split())
#: What a new element closes: an open element of the first set, if none of the second is
#: nearer. Other blocks close an open paragraph.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "p": ({"p"}, SECTION | {"div", "td", "th", "li", "dd", "body"}),
}
_MATTERS = frozenset().union(*(a | b for a, b in CLOSES.values()))

#: Marks the text blocks of the article in a labelled page.
MARK = "\ue000"

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_NAME = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Open:
    """An open element: its place in the stack, what stands above it as sets that children
    share until they add to them, and for each rule of CLOSES the place of what it closes.
    Where a model's features are known, sets keep to them, however many names a page has."""

    __slots__ = ("tag", "depth", "under", "pairs", "parent", "section", "named", "closes", "own")

    def __init__(self, tag: str, names: tuple[str, ...], up: _Open | None, known: frozenset[str] | None = None) -> None:
        self.tag, self.depth, self.own = tag, up.depth + 1 if up else 0, None
        under, pairs, closes = (up.under, up.pairs, up.closes) if up else (frozenset(), frozenset(), {})
        self.parent, self.section, self.named = (up.parent, up.section, up.named) if up else ("body", None, ("nothing",))
        if tag not in ("html", "body"):
            more = {f"under {tag}", "in article"} if tag in ("article", "main") else {f"under {tag}"}
            more = more if known is None else more & known
            under = under if more <= under else under | more
            if tag in BLOCK:
                self.parent = tag
            if tag in SECTION:
                pair = f"{self.section} over {tag}" if self.section else f"sections {tag}"
                pairs, self.section = pairs if pair in pairs else pairs | {pair}, tag
        if names:
            more = {f"named {w}" for w in names}
            if known is not None:
                more &= known
                names = tuple(w for w in names if f"last named {w}" in known)
            under = under if more <= under else under | more
            self.named = names or ("unknown",)
        if tag in _MATTERS:
            closes = dict(closes)
            for kind, (ends, stop) in CLOSES.items():
                if tag in stop:
                    closes[kind] = None
                elif tag in ends and closes.get(kind) is None:
                    closes[kind] = self.depth
        self.under, self.pairs, self.closes = under, pairs, closes

    def indicators(self) -> list[str]:
        if self.own is None:
            self.own = ["bias", f"parent {self.parent}", *sorted(self.under), *(f"last named {w}" for w in self.named), *(sorted(self.pairs) or ["sections none"])]
            if "in article" not in self.under:
                self.own.append("in no article")
        return self.own


@dataclass
class Block:
    text: str
    at: _Open  # the element that its first words stand in
    linked: int  # characters inside links


def _names(attributes: str) -> tuple[str, ...]:
    return tuple(w.lower() for v in _NAME.findall(attributes) for w in _PART.findall(_CAMEL.sub(" ", v)))


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order, white space turned into single spaces, blank ones left out.
    With a model's features as ``known``, time and memory follow the length of the page,
    however deep its elements nest and however many names they have."""
    page = page or ""
    out: list[Block] = []
    root = _Open("body", (), None, known)
    stack: list[_Open] = []
    opened: dict[str, int] = {}  # how many elements of a tag are open
    parts: list[str] = []
    linked, place = 0, None

    def add(text: str) -> None:
        nonlocal linked, place
        if not text:
            return
        text = entities.unescape(text) if "&" in text else text
        if not text.isspace():
            if place is None:
                place = stack[-1] if stack else root
            if opened.get("a"):
                linked += len(text.strip())
        parts.append(text)

    def flush() -> None:
        nonlocal linked, place
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, place, linked))
        parts.clear()
        linked, place = 0, None

    def close(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in UNSEEN and not m[3].rstrip(">").endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
            depth = stack[-1].closes.get(tag if tag in CLOSES else "p") if stack else None
            if depth is not None:
                close(depth)
        if tag not in VOID:
            new = _Open(tag, _names(m[3]), stack[-1] if stack else None, known)
            stack.append(new)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """The names of the indicators that hold for each block."""
    n, out, shapes = len(found), [], []
    for b in found:
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        ends = b.text[-1] in ".!?…。\"'”"
        # running text, a line without links, or links and fragments
        shape = "prose" if words >= 10 and share < 0.3 and ends else "line" if share < 0.3 else "links"
        shapes.append((words, share, ends, shape))
    for k, b in enumerate(found):
        words, share, ends, shape = shapes[k]
        named = b.at.named[0] if b.at.named[0] in ("nothing", "unknown") else "known"
        more = [
            f"words {min(6, words.bit_length())}",
            f"linked {0 if not b.linked else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
            "ends a sentence" if ends else "ends no sentence",
            f"place {4 * k // n}",
            f"{shape} named {named}?",
            f"after {shapes[k - 1][3] if k else 'nothing'}",
            f"before {shapes[k + 1][3] if k + 1 < n else 'nothing'}",
        ]
        if "©" in b.text or "copyright" in b.text.lower():
            more.append("copyright")
        out.append([*b.at.indicators(), *more])
    return out


@dataclass
class CRF:
    index: dict[str, int]
    unary: np.ndarray  # feature x label
    pair: np.ndarray  # label x next label
    first: np.ndarray  # label
    known: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.known = frozenset(self.index)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.unary[[j for j in map(get, r) if j is not None]].sum(0) for r in rows]).reshape(-1, 2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 0."""
        if not rows:
            return []
        s = self.scores(rows).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = s[0][0] + float(self.first[0]), s[0][1] + float(self.first[1])
        back = []
        for x, y in s[1:]:
            back.append((0 if a + p00 >= b + p10 else 1, 0 if a + p01 >= b + p11 else 1))
            a, b = max(a + p00, b + p10) + x, max(a + p01, b + p11) + y
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[str], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3, least: int = 2, hidden: float = 0.1, seed: int = 5) -> CRF:
    """A CRF by maximum likelihood with an L2 penalty (Adam); in each page, blocks that
    begin with MARK are the article. The pages are a bounded training set. In each page some
    of the names (a share of ``hidden``) count as unknown, so that unknown ones have a weight."""
    seen: dict[str, int] = {"last named unknown": least}
    for page in pages:
        for f in {f for r in features(blocks(page)) for f in r}:
            seen[f] = seen.get(f, 0) + 1
    known = frozenset(f for f, n in seen.items() if n >= least)
    index = {f: k for k, f in enumerate(sorted(known))}
    words, rng, data = sorted(f[11:] for f in known if f.startswith("last named ") and f[11:] not in ("nothing", "unknown")), random.Random(seed), []
    for page in pages:
        lost = {w for w in words if rng.random() < hidden}
        found = blocks(page, known - {f"{x} {w}" for w in lost for x in ("named", "last named")})
        y = [int(b.text.startswith(MARK)) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "") or "."
        if found:
            data.append((features(found), y))
    n, longest = len(data), max((len(y) for _, y in data), default=0)
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    at, ids = [], []
    for i, (rows, y) in enumerate(data):
        mask[i, : len(y)] = True
        gold[i, : len(y)] = y
        for t, r in enumerate(rows):
            known = [index[f] for f in r if f in index]
            at += [i * longest + t] * len(known)
            ids += known
    at, ids = np.array(at, np.int64), np.array(ids, np.int64)
    theta = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    lse = lambda x, axis: (t := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - t).sum(axis))
    one = np.eye(2)[gold] * mask[..., None]
    real = [None, np.einsum("ita,itb->ab", one[:, :-1], one[:, 1:]), one[:, 0].sum(0)]
    for step in range(1, rounds + 1):
        s = np.stack([np.bincount(at, theta[0][ids, c], n * longest) for c in (0, 1)], 1).reshape(n, longest, 2)
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0] + theta[2]
        for t in range(1, longest):
            go = lse(forward[:, t - 1, :, None] + theta[1], 1) + s[:, t]
            forward[:, t] = np.where(mask[:, t, None], go, forward[:, t - 1])
        total = lse(forward[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            go = lse(theta[1] + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], go, 0)
        p = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        both = np.exp(forward[:, :-1, :, None] + theta[1] + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        gap = (one - p).reshape(-1, 2)
        grad = [np.stack([np.bincount(ids, gap[at, c], len(index)) for c in (0, 1)], 1), real[1] - both.sum((0, 1)), real[2] - p[:, 0].sum(0)]
        for k in range(3):
            g = grad[k] / n - decay * theta[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            theta[k] = theta[k] + rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return CRF(index, *theta)


def _words(rng: random.Random, n: int) -> str:
    """n made-up words of changing consonants and vowels, in sentences."""
    pick = rng.choice
    out = ["".join(pick("bcdfghjklmnprstvwz") + pick("aeiouyéü") + pick(("", "", "n", "s", "rk")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    at = 0
    while at < n:
        out[at] = out[at].capitalize()
        at += rng.randint(4, 16)
        if at < n:
            out[at - 1] += pick((".", ".", ";", "!", "?"))
        for k in range(at - 3, min(at, n), 7):
            out[k] += pick(("", ","))
    return " ".join(out) + (pick((".", ".", ".", "", "?")) if n > 3 else pick((".", "")))


def labelled_pages(n: int = 900, seed: int = 11) -> list[str]:
    """n pages of varied layout whose article blocks begin with MARK."""
    rng = random.Random(seed)
    pick, some = rng.choice, lambda a, b: _words(rng, rng.randint(a, b))
    sign = lambda: pick(("Copyright", "©", "&copy;", "&#169;", "(c)"))
    link = lambda: f'<a href="/{rng.randint(1, 999)}">{some(1, 4)}</a>'
    lists = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b))) + "</ul>"
    named = lambda names: f'{pick(("class", "id", "class"))}="{pick(names)}"'

    def wrap(tags: str, names: str, inside: str, bare: float = 0.4) -> str:
        tag = pick(tags.split())
        attr = "" if tag not in ("div", "section", "ul", "p", "span", "td") and rng.random() < bare else " " + named(names.split())
        return f"<{tag}{attr}>{inside}</{tag}>"

    def plain() -> str:
        """A name that tells nothing: of the layout, or made by a tool."""
        made = "".join(pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(2, 7)))
        names = ("wrapper", "wrap", "container", "row", "col", "col-md-8", "inner", "outer", "page", "site", "app", "root", "grid", "box", "layout", "column", "left", "center", f"c{rng.randint(1, 40)}", f"css-{made}", f"sc-{made}", made, made)
        return f'{pick(("class", "id", "class"))}="{pick(names)}"'

    def around(inside: str, deep: int = 1) -> str:
        for _ in range(deep):
            inside = f"<div {plain()}>{inside}</div>"
        return inside

    def prose() -> str:
        kind = rng.random()
        body = some(1, 4) if kind < 0.2 else some(5, 25) if kind < 0.5 else some(20, 120)
        if rng.random() < 0.25:
            body += " " + link() + " " + some(2, 20)
        if rng.random() < 0.2:
            body = body.replace(" ", f" <{pick(('b', 'i', 'em', 'strong', 'span'))}>", 1)  # never closed
        if rng.random() < 0.15:
            body = body.replace(" ", "<br>", 1)
        return MARK + body

    def article() -> str:
        out = [f"<h1>{MARK}{some(3, 12)}</h1>"] if rng.random() < 0.7 else []
        if out and rng.random() < 0.2:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.62:
                out.append(f"<p>{prose()}" + pick(("</p>", "</p>", "</p>", "")))
            elif kind < 0.68:
                out.append(f"<{(h := pick(('h2', 'h3')))}>{MARK}{some(2, 8)}</{h}>")
            elif kind < 0.74:
                out.append(f"<{(u := pick(('ul', 'ol')))}>" + "".join(f"<li>{prose()}</li>" for _ in range(rng.randint(2, 5))) + f"</{u}>")
            elif kind < 0.78:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.81:
                out.append(f"<pre>{MARK}{some(5, 30)}</pre>")
            elif kind < 0.84:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{some(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif kind < 0.87:
                out.append(f"<figure><img src=x><figcaption>{MARK}{some(4, 14)}</figcaption></figure>")
            elif kind < 0.91:
                out.append(f"<div>{prose()}</div>")
            else:
                out.append(pick((advert, share, aside, signup, notice))())
        return "".join(out)

    def advert() -> str:
        return wrap("div div aside ins section p", "ad ads advert advertisement ad-slot adsbygoogle sponsored sponsor promo promotion banner ad-banner top-ad", pick((some(3, 18), f"<p>{some(4, 20)}</p>{link()}", link())), 0.1)

    def share() -> str:
        return wrap("div ul", "share social share-buttons social-links sharing follow", lists(2, 4))

    def aside() -> str:
        return wrap("aside div section", "sidebar side-bar related related-posts widget recommended more-stories trending popular", f"<h3>{some(1, 4)}</h3>" + pick((lists(2, 6), f"<p>{some(5, 40)}</p>")))

    def signup() -> str:
        form = f"<form method=post><label>{some(1, 4)}</label><input name=q>" + pick(("", f"<p>{some(4, 15)}</p>", f"<select><option>{some(1, 2)}<option>{some(1, 2)}</select>", f"<textarea>{some(1, 4)}</textarea>")) + f"<button>{some(1, 2)}</button></form>"
        return pick((form, wrap("div section", "newsletter subscribe signup sign-up login search search-form contact-form", form)))

    def notice() -> str:
        return wrap("div section div p", "cookie cookies cookie-notice cookie-banner consent gdpr notice alert alert-box message paywall disclaimer warning modal popup", pick((some(5, 30), f"<p>{some(6, 40)}</p><button>{some(1, 2)}</button>")))

    def comments() -> str:
        one = lambda: wrap("div li article p", "comment comment-body reply user-comment", pick((some(3, 40), f"<b>{some(1, 2)}</b><p>{some(3, 60)}</p>")), 0.2)
        inside = pick(("", f"<h2>{some(1, 3)}</h2>")) + "".join(one() for _ in range(rng.randint(1, 5))) + pick(("", signup()))
        return wrap("section div ol div", "comments comment-list comment-section disqus discussion responses reader-comments replies", inside, 0.1)

    def header() -> str:
        return wrap("header header div", "header site-header masthead top topbar branding logo page-header", pick((f"<h1>{some(1, 3)}</h1>", f"<p>{some(2, 8)}</p>", f"<div>{link()}</div>", f"<a href=/>{some(1, 3)}</a><span>{some(2, 7)}</span>")) + pick(("", lists(3, 6))), 0.7)

    def menu() -> str:
        return wrap("nav nav div ul", "nav navbar navigation menu main-menu breadcrumb breadcrumbs navigation-bar", pick((lists(3, 9), " ".join(link() for _ in range(4)), f"<p>{some(1, 6)}</p>" + lists(2, 4))), 0.7)

    def footer() -> str:
        return wrap("footer footer div", "footer site-footer page-footer bottom copyright legal colophon", pick((f"<small>{sign()} {rng.randint(1995, 2030)} {some(1, 12)}</small>", f"<p>{some(1, 3)} {sign()} {some(2, 9)}</p>", f"{some(3, 25)} | {sign()}", f"<p>{some(3, 25)}</p>" + lists(2, 5), lists(2, 6) + some(2, 12))), 0.7)

    pages = []
    for _ in range(n):
        body = article()
        late = comments() if rng.random() < 0.35 else ""
        kind = rng.random()
        if kind < 0.36:
            core = f"<article>{body}{late if rng.random() < 0.3 else ''}</article>"
            core = pick((core, core, f"<main>{core}</main>", f'<div class="container">{core}</div>'))
        elif kind < 0.58:
            core = f'<div {named("content post post-body entry-content article article-body main story text body-text page-content".split())}>{body}</div>'
        elif kind < 0.64:
            core = f"<main>{body}</main>"
        elif kind < 0.69:
            core = f"<table><tr><td>{lists(2, 5)}</td><td>{body}</td></tr></table>"
        elif kind < 0.75:
            core = body
        elif kind < 0.86:
            core = around(body, rng.randint(1, 3))
        elif kind < 0.94:
            section = f"<section{pick(('', ' ' + plain()))}>"
            core = pick((f"{section}{body}</section>", around(f"{section}{body}</section>"), f"{section}{around(body)}</section>"))
        else:
            core = f"<div>{body}</div>"
        before = [f() for f in (header, menu, advert, notice) if rng.random() < 0.55]
        after = [late if rng.random() < 0.8 else ""] + [f() for f in (aside, share, advert, signup, notice, footer) if rng.random() < 0.4]
        if rng.random() < 0.3:
            before.append(aside())
        rng.shuffle(before)
        before, after = ([around(x) if x and rng.random() < 0.2 else x for x in some_] for some_ in (before, after))
        if rng.random() < 0.08:  # nothing but the text
            pages.append(core)
            continue
        head = [f"<title>{some(2, 9)}</title>", '<meta name="viewport" content="width=device-width">', f'<link rel="stylesheet" href="/{rng.randint(1, 99)}.css">']
        head += [f"<style>.{some(1, 1)} {{ color: #{rng.randint(100, 999)} }}</style>"] * (rng.random() < 0.5)
        head += [f'<script type="application/ld+json">{{"name": "{some(1, 5)} </div> <p>"}}</script>'] * (rng.random() < 0.5)
        rng.shuffle(head)
        head = f"<head>{''.join(head[rng.randint(0, 2) :])}</head>"
        inner = "".join([*before, pick(("", f"<!-- {some(1, 4)} -->")), core, *after])
        whole = f"{head}<body>{around(inner) if rng.random() < 0.25 else inner}"
        pages.append(whole if rng.random() < 0.2 else f"<!DOCTYPE html><html>{whole}</body></html>")
    return pages


def main_text(page: str | None, model: CRF) -> str:
    found = blocks(page, model.known)
    return " ".join(b.text for b, y in zip(found, model.decode(features(found)), strict=True) if y)


def _extractor(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in sliced(batches):
            texts = [main_text(x.as_py(), model) for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, model: CRF, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page; null and empty pages, and those without
    an article block, have the empty text. Repeated rows stay, ids and urls may be null,
    other columns do not matter. Every page is read whole."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # the model has a weight for each feature of a bounded training set
    shared = pages.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_extractor(shared), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
