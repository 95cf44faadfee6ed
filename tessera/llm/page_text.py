"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, the runs of text between block-level tags, each with its ancestors. Features are the
ancestors' tags and the words of their class, id and role, the nearest sectioning element, and the block's text
(length, links, marks, place). The field has two labels, main text or not. It is trained by gradient ascent on
the likelihood of labelled pages that are written by rule (`labelled_pages`), with many layouts and many kinds
of boilerplate, also inside articles. Viterbi gives the labels of a page's blocks; the main blocks, joined, are the
text.

Defined cases: null html counts as empty, and an empty page or one without main text gives an empty text; a page cut
off anywhere is read up to the tag it ends in; elements may be nested to any depth; a page without tags is text; unknown character references stay as they are; repeated rows are extracted
each; null ids and urls are passed on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# HTML's own element groups.
BLOCK = frozenset(
    "html head body title article main section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend label button select option optgroup textarea address details summary dialog menu hgroup noscript "
    "template iframe object video audio canvas svg center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
SECTION = frozenset("head article main nav aside header footer form section dialog noscript template button label select textarea iframe svg".split())
CLOSES_ITS_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Whose content is text up to their own end tag.
PLAIN = frozenset(("title", "textarea", "iframe", "xmp", "noembed", "noframes"))
OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
#: A tag from its name on, by HTML's rules: quotes count only where a value begins, and one that is never closed counts as a
#: letter. No part is tried twice, so the time grows with the length alone.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>""")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | PLAIN}
#: Pages share the places above this depth, and no more places than this in all; both bound what is kept between pages,
#: not what is read.
SHARED_DEPTH, SHARED_PLACES = 200, 20_000


class Shared:
    """What all places of a tree know: which names weigh anything, how many places are kept, and the names in attributes."""

    def __init__(self, known: frozenset[str] | None):
        self.known, self.kept, self.names = known, 0, {}

    def names_in(self, attributes: str) -> tuple[tuple[str, ...], bool]:
        """The words of class, id and role that weigh anything, in order, and whether there are any words at all."""
        found = self.names.get(attributes)
        if found is None:
            every = {w.lower() for m in NAMED.finditer(attributes) for w in WORDS.findall(m[2] or m[3] or m[4] or "")}
            found = tuple(sorted(every if self.known is None else every & self.known)), bool(every)
            if len(attributes) < 200:
                if len(self.names) >= SHARED_PLACES:
                    self.names.clear()
                self.names[attributes] = found
        return found


class Place:
    """An element in the tree of paths that pages share: its tag, and the features of the path to it."""

    __slots__ = ("tag", "parent", "below", "depth", "names", "added", "near", "outer", "named", "path", "features", "shared")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Place | None, open_tags: Counter = Counter(), open_names: Counter = Counter(),
                 has_names: bool = False, known: frozenset[str] | None = None):
        self.tag, self.parent, self.below, self.names = tag, parent, {}, names
        self.shared = parent.shared if parent else Shared(known)
        self.depth = parent.depth + 1 if parent else 0
        #: What the path has from this element on, and not above it.
        self.added = ([] if open_tags[tag] else [f"has={tag}"]) + [f"name={w}" for w in names if not open_names[w]]
        self.near = tag if tag in SECTION else parent.near if parent else "-"
        self.outer = (parent.near if parent else "-") if tag in SECTION else parent.outer if parent else "-"
        self.named = names if names or has_names or not parent else parent.named
        self.path: np.ndarray | None = None
        self.features: np.ndarray | None = None

    def child(self, tag: str, attributes: str, open_tags: Counter, open_names: Counter) -> Place:
        names, has_names = self.shared.names_in(attributes) if attributes else ((), False)
        key = (tag, names, has_names)
        found = self.below.get(key)
        if found is None:
            found = Place(tag, names, self, open_tags, open_names, has_names)
            if self.depth < SHARED_DEPTH and self.shared.kept < SHARED_PLACES:
                self.below[key] = found
                self.shared.kept += 1
        return found

    def next_page(self) -> None:
        """To be called at the root between pages: a full tree is dropped."""
        if self.shared.kept >= SHARED_PLACES:
            self.below.clear()
            self.shared.kept = 0

    def own(self) -> list[str]:
        """The features that are not the path's."""
        return [f"in={self.tag}", f"near={self.near}", f"near={self.near},in={self.tag}", f"near={self.near}<{self.outer}", f"near={self.near}<{self.outer},in={self.tag}", "bias"] + [f"near_name={w}" for w in self.named]

    def described(self) -> list[str]:
        out, up = self.own(), self
        while up is not None:
            out += up.added
            up = up.parent
        return out

    def weighed(self, field: Field) -> np.ndarray:
        """The summed weights of described(); sums of paths are kept, so each element is weighed once at any depth."""
        open_, up = [], self
        while up is not None and up.path is None:
            open_.append(up)
            up = up.parent
        for place in reversed(open_):
            above = place.parent.path if place.parent else np.zeros(2)
            place.path = above + field.weight(place.added) if place.added else above
        return self.path + field.weight(self.own())


def text_features(text: str, linked: int, at: int, n: int) -> list[str]:
    words, links = min((text.count(" ") + 1).bit_length(), 6), 4 * linked // max(1, len(text))
    out = [f"words={words}", f"links={links}", f"links={links},words={words}"]
    if text[-1] in ".!?":
        out.append("ends")
    if "©" in text:
        out.append("copyright")
    if at == 0:
        out.append("first")
    if at == n - 1:
        out.append("last")
    return out


def blocks(page: str, root: Place) -> Iterator[tuple[str, int, Place]]:
    """(text, characters inside links, place) of each leaf block, in page order."""
    at, end, place, parts, linked, links = 0, len(page), root, [], 0, 0
    open_tags, open_names = Counter([root.tag]), Counter()

    def left(until: Place) -> Place:
        """Closes the elements from place up to until, which is closed too; its parent."""
        up = place
        while True:
            open_tags[up.tag] -= 1
            open_names.subtract(up.names)
            if up is until:
                return up.parent
            up = up.parent

    def ended():
        text = " ".join("".join(parts).split())
        parts.clear()
        return text

    def read(run: str) -> None:
        nonlocal linked
        if run:
            run = entities.unescape(run) if "&" in run else run
            parts.append(run)
            if links:
                linked += len(run)

    while at < end:
        o = OPENS.search(page, at)
        read(page[at:o.start() if o else end])
        if o is None:
            break
        at = o.start()
        if o[0] == "<!--":
            close = 0 if page.startswith((">", "->"), at + 4) else page.find("-->", at + 4)
            at = page.find(">", at + 4) + 1 if close == 0 else end if close < 0 else close + 3
            continue
        if o[0] in ("<!", "<?", "</"):  # a comment of another kind
            at = page.find(">", at) + 1 or end
            continue
        m = TAG.match(page, at)
        if m is None:
            break  # the page ends inside a tag
        at = m.end()
        tag = m[2]
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[1] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in RAW:
            if not m[1]:
                close = CLOSE[tag].search(page, at)
                at = close.start() if close else end
        elif tag == "hr" or tag in BLOCK:
            if parts:
                text = ended()
                if text:
                    yield text, linked, place
                linked = 0
            links = 0
            if m[1]:
                if open_tags[tag]:
                    up = place
                    while up.tag != tag:
                        up = up.parent
                    place = left(up)
            elif tag != "hr":
                if place.tag == "p":
                    place = left(place)
                if tag in CLOSES_ITS_KIND and open_tags[tag]:
                    up = place
                    while up.parent is not None and up.tag not in CLOSES_ITS_KIND[tag] and up.tag != tag:
                        up = up.parent
                    if up.tag == tag or (up.tag in ("dt", "dd") and tag in ("dt", "dd")):
                        place = left(up)
                place = place.child(tag, m[3].strip().rstrip("/"), open_tags, open_names)
                open_tags[tag] += 1
                open_names.update(place.names)
                if tag in PLAIN:
                    close = CLOSE[tag].search(page, at)
                    read(page[at:close.start() if close else end])
                    at = close.start() if close else end
    text = ended()
    if text:
        yield text, linked, place


class Field:
    """The conditional random field: weights of features by label, start and step weights. Features that no labelled page has weigh nothing."""

    def __init__(self, known: dict[str, int]):
        self.known, self.w, self.start, self.step = known, np.zeros((len(known), 2)), np.zeros(2), np.zeros((2, 2))

    def ids(self, names: list[str]) -> np.ndarray:
        return np.array([i for i in map(self.known.get, names) if i is not None], np.int64)

    def root(self) -> Place:
        """The root of a tree of paths for this field: words without a weight are not told apart in it."""
        return Place("-", (), None, known=frozenset(n.partition("=")[2] for n in self.known if n.startswith(("name=", "near_name="))))

    def weight(self, names: list[str]) -> np.ndarray:
        return self.w[self.ids(names)].sum(0)

    def emissions(self, found: list[tuple[str, int, Place]]) -> np.ndarray:
        n = len(found)
        out = np.empty((n, 2))
        for i, (text, linked, place) in enumerate(found):
            if place.features is None:
                place.features = place.weighed(self)
            key = tuple(text_features(text, linked, i, n))
            own = self.texts.get(key)
            if own is None:
                own = self.texts[key] = self.weight(list(key))
            out[i] = place.features + own
        return out

    @functools.cached_property
    def texts(self) -> dict:
        return {}

    def viterbi(self, e: np.ndarray) -> list[int]:
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = (self.start + e[0]).tolist()
        back = []
        for x, y in e[1:].tolist():
            from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + s00 if from_a else b + s10) + x, (a + s01 if from_b else b + s11) + y
        label = int(b > a)
        out = [label]
        for pointers in reversed(back):
            label = pointers[label]
            out.append(label)
        return out[::-1]

    def batch(self, pages: list[tuple[list[np.ndarray], list[int]]]) -> tuple:
        """The pages' features, labels and lengths as arrays of one width."""
        longest, n = max(len(y) for _, y in pages), len(pages)
        mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
        for p, (_, y) in enumerate(pages):
            mask[p, :len(y)], gold[p, :len(y)] = True, y
        at = [p * longest + t for p, (x, _) in enumerate(pages) for t in range(len(x))]
        return np.concatenate([ids for x, _ in pages for ids in x]), np.repeat(at, [len(ids) for x, _ in pages for ids in x]), mask, np.eye(2)[gold] * mask[..., None]

    def gradient(self, batch: tuple) -> tuple[float, list[np.ndarray]]:
        """The mean log-likelihood of a page and its gradient; forward and backward sums run over all pages at once, scaled to one."""
        flat, owner, mask, true = batch
        n, longest = mask.shape
        e = np.stack([np.bincount(owner, weights=self.w[flat, c], minlength=n * longest) for c in (0, 1)], 1).reshape(n, longest, 2)
        top = e.max(2, keepdims=True)
        x, a = np.exp(e - top), np.exp(self.step)
        alpha, beta, scale = np.empty_like(x), np.ones_like(x), np.ones((n, longest))
        now = np.exp(self.start) * x[:, 0]
        for t in range(longest):
            if t:
                now = np.where(mask[:, t, None], (now @ a) * x[:, t], now)
            scale[:, t] = np.where(mask[:, t], now.sum(1), 1)
            now = now / scale[:, t, None]
            alpha[:, t] = now
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], (x[:, t + 1] * beta[:, t + 1]) @ a.T / scale[:, t + 1, None], 1)
        p = alpha * beta * mask[..., None]
        over = np.einsum("pti,ij,ptj->ij", alpha[:, :-1], a, x[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * mask[:, 1:, None])
        likelihood = (true * e).sum() + (true[:, 0] * self.start).sum() + np.einsum("pti,ij,ptj->", true[:, :-1], self.step, true[:, 1:]) - (np.log(scale) + top[..., 0] * mask).sum()
        d = (true - p).reshape(-1, 2)
        grads = [np.stack([np.bincount(flat, weights=d[owner, c], minlength=len(self.w)) for c in (0, 1)], 1) / n,
                 (true - p)[:, 0].mean(0), (np.einsum("pti,ptj->ij", true[:, :-1], true[:, 1:]) - over) / n]
        return likelihood / n, grads

    def fit(self, pages: list[tuple[list[np.ndarray], list[int]]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-4) -> None:
        """Adam on the exact log-likelihood."""
        batch, params = self.batch(pages), [self.w, self.start, self.step]
        m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        for k in range(1, rounds + 1):
            _, grads = self.gradient(batch)
            grads[0] = grads[0] - decay * self.w
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] += rate * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.999 ** k)) + 1e-8)


# Names and texts of the labelled pages, stated as fixed values.
MAIN_NAMES = ("content", "post", "entry content", "article body", "story", "main text", "page content", "post body", "entry", "text", "body content", "primary", "mw content text", "site content")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad", "ad slot", "sponsor", "promotion")
SIDE_NAMES = ("sidebar", "side", "widget", "related", "recommended", "popular posts", "trending", "more stories", "secondary", "complementary", "rail", "widget area", "left column")
NOTICE_NAMES = ("cookie notice", "cookie banner", "notice", "consent", "gdpr", "alert", "privacy banner", "cookies", "popup", "modal", "overlay", "warning message")
MENU_NAMES = ("menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "topbar", "links", "tabs", "pagination", "pager", "toc", "portlet", "subnav", "toolbar", "jump to nav", "categories", "catlinks", "site sub")
HEAD_NAMES = ("header", "masthead", "site header", "top", "logo", "branding", "page header", "site title")
FOOT_NAMES = ("footer", "site footer", "bottom", "copyright", "legal", "colophon", "page footer")
FORM_NAMES = ("newsletter", "subscribe", "signup", "search", "login", "contact form", "comment form", "search form")
SHARE_NAMES = ("share", "social", "sharing", "share buttons", "follow", "author bio", "meta", "byline", "tags")
COMMENT_NAMES = ("comments", "comment", "comment list", "replies", "discussion", "responses", "disqus thread", "reader comments", "user comments")


def labelled_pages(n: int = 700, seed: int = 5) -> list[list[tuple[str, str, int]]]:
    """Pages as lists of (markup before, text, label); the markup after a text comes before the next one."""
    rng = np.random.default_rng(seed)
    pick = lambda names: names[rng.integers(len(names))]
    chance = lambda p: rng.random() < p

    def words(low: int, high: int, mark: float = 0.8) -> str:
        n = int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))
        return " ".join("w" * int(rng.integers(1, 11)) for _ in range(max(1, n))) + (rng.choice([".", "!", "?"]) if chance(mark) else "")

    def named(tag: str, names) -> str:
        kind = rng.integers(4)
        value = pick(names)
        value = value.replace(" ", rng.choice(["-", "_", " "])) if kind else value.replace(" ", "-")
        return f'<{tag} id="{value}">' if kind == 0 else f'<{tag} class="{value}">' if kind < 3 else f"<{tag} class='x{rng.integers(9)} {value}'>"

    out = []
    for _ in range(n):
        page: list[tuple[str, str, int]] = []
        before = ["<!DOCTYPE html><html lang='en'><head>"]

        def text(s: str, label: int) -> None:
            page.append(("".join(before), s, label))
            before.clear()

        def listed(k: int, label: int, link: bool) -> None:
            before.append("<ul>")
            for _ in range(k):
                before.append("<li>" + ("<a href='/x'>" if link else ""))
                text(words(1, 4, 0.1), label)
                before.append(("</a>" if link else "") + "</li>")
            before.append("</ul>")

        def aside(tag: str, names, low: int = 2, high: int = 30) -> None:
            before.append(named(tag, names) if names and chance(0.85) or tag == "div" else f"<{tag}>")
            if chance(0.3):
                listed(int(rng.integers(1, 6)), 0, True)
            else:
                for _ in range(int(rng.integers(1, 4))):
                    inner = rng.choice(["", "p", "div", "h3"])
                    before.append(f"<{inner}>" if inner else "")
                    text(words(low, high), 0)
                    before.append(f"</{inner}>" if inner else "")
                    if not inner:
                        break
            before.append(f"</{tag}>")

        def comments() -> None:
            tag = rng.choice(["section", "div", "aside", "ol"])
            before.append(named(tag, COMMENT_NAMES))
            if chance(0.5):
                before.append("<h2>")
                text(words(1, 4, 0.1), 0)
                before.append("</h2>")
            for _ in range(int(rng.integers(1, 5))):
                inner = "li" if tag == "ol" else rng.choice(["div", "article", "p"])
                before.append(f"<{inner} class='comment'>" if chance(0.5) else f"<{inner}>")
                if inner != "p" and chance(0.6):
                    before.append("<p>")
                text(words(2, 60), 0)
                before.append(f"</{inner}>")
            before.append(f"</{tag}>")

        def boilerplate(inside: bool) -> None:
            kind = rng.integers(9)
            if kind == 0:
                aside(rng.choice(["div", "aside", "section"]), AD_NAMES)
            elif kind == 1:
                aside(rng.choice(["aside", "div", "section"]), SIDE_NAMES)
            elif kind == 2:
                aside(rng.choice(["div", "section", "dialog"]), NOTICE_NAMES)
            elif kind == 3:
                aside("nav" if chance(0.5) else "div", MENU_NAMES, 1, 5)
            elif kind == 4:
                before.append("<form>" if chance(0.4) else named("form", FORM_NAMES))
                before.append("<label>")
                text(words(1, 5, 0.2), 0)
                before.append("</label><input><button>")
                text(words(1, 2, 0), 0)
                before.append("</button></form>")
            elif kind == 5:
                aside("div", SHARE_NAMES, 1, 8)
            elif kind == 6 and not inside:
                aside("header", HEAD_NAMES, 1, 8)
            elif kind == 7:
                comments()
            else:
                aside("aside", None)

        bare = chance(0.06)  # a page that is its text and nothing else
        if not bare or chance(0.5):
            before.append("<title>")
            text(words(1, 10, 0.2), 0)
            before.append("</title>")
        before.append("</head><body>" if not bare or chance(0.5) else "")
        order = [lambda: aside("nav", MENU_NAMES if chance(0.4) else None, 1, 5), lambda: aside("header", HEAD_NAMES if chance(0.5) else None, 1, 8), lambda: aside("div", AD_NAMES), lambda: boilerplate(False)]
        for i in rng.permutation(len(order))[:0 if bare else rng.integers(0, 5)]:
            order[i]()
        wrap = 5 if bare else int(rng.choice([0, 1, 2, 3, 4, 5, 6, 7], p=[0.2, 0.14, 0.14, 0.14, 0.14, 0.08, 0.1, 0.06]))
        if wrap == 6:  # columns of a table: links on the left, the text on the right
            before.append("<table><tr>" + ("<td>" if chance(0.5) else named("td", MENU_NAMES + SIDE_NAMES)))
            kind = rng.integers(3)
            if kind == 0:
                listed(int(rng.integers(2, 8)), 0, True)
            elif kind == 1:
                before.append("<a href='/x'>")
                text("<br>".join(words(1, 3, 0) for _ in range(int(rng.integers(1, 8)))), 0)
                before.append("</a>")
            else:
                for _ in range(int(rng.integers(2, 8))):
                    before.append("<p><a href='/x'>" if chance(0.5) else "<div><a href='/x'>")
                    text(words(1, 4, 0.1), 0)
                    before.append("</a></div>")
        shell = ["<article>", "<main>", "<main><article>", named("div", MAIN_NAMES), "<article>" + named("div", MAIN_NAMES), "", "</td><td>", "<div>"][wrap]
        before.append(shell)
        headed = wrap in (0, 2, 4) and chance(0.3)  # the article's own header holds its headline and a line on it
        if headed:
            before.append("<header>")
        if headed or chance(0.7 if not bare else 0.3):
            before.append("<h1>")
            text(words(1, 12, 0.3), 1)
            before.append("</h1>")
        if headed:
            if chance(0.6):
                before.append(named("p", SHARE_NAMES) if chance(0.7) else "<div>")
                text(words(1, 8, 0.2), 0)
                before.append("</p>")
            before.append("</header>")
        elif wrap in (3, 5, 7) and not bare and chance(0.25):  # a slogan below the headline, a table of contents
            before.append(named("div", ("site sub", "tagline", "subtitle line", "content sub")))
            text(words(1, 5, 0.1), 0)
            before.append("</div>")
            if chance(0.5):
                aside("div", MENU_NAMES, 1, 5)
        for _ in range(int(rng.integers(1, 12))):
            if not bare and chance(0.12):
                boilerplate(True)
            kind = rng.choice(["p", "p", "p", "p", "p", "h2", "h3", "blockquote", "pre", "li", "td", "div", "section", "figcaption"])
            if kind == "li":
                listed(int(rng.integers(1, 5)), 1, chance(0.2))
                continue
            opened, closed = {"td": ("<table><tr><td>", "</td></tr></table>"), "figcaption": ("<figure><figcaption>", "</figcaption></figure>"), "section": ("<section><p>", "</p></section>")}.get(kind, (f"<{kind}>", f"</{kind}>"))
            before.append(opened)
            text(words(1, 90) + ("" if chance(0.8) else "<br>" + words(1, 20)), 1)
            before.append("" if kind == "p" and chance(0.2) else closed)
        if not bare and chance(0.15):
            comments()
        before.append({0: "</article>", 1: "</main>", 2: "</article></main>", 3: "</div>", 4: "</div></article>", 5: "", 6: "</td></tr></table>", 7: "</div>"}[wrap])
        tail = [lambda: aside("footer", FOOT_NAMES if chance(0.5) else None), lambda: aside("div", FOOT_NAMES), comments, lambda: boilerplate(False), lambda: aside("aside", SIDE_NAMES if chance(0.6) else None)]
        for i in rng.permutation(len(tail))[:0 if bare else rng.integers(0, 5)]:
            tail[i]()
        out.append(page)
    return out


# Names in small pages, stated as fixed values.
TALK_NAMES = ("thread", "message", "message content", "message body", "post message", "topic", "question", "answer", "mail", "letter", "chat message")
COLUMN_NAMES = ("", "grid", "row", "col", "column", "columns", "cell", "two columns")


def small_pages(n: int = 160, seed: int = 6) -> list[list[tuple[str, str, int]]]:
    """Pages of one or a few blocks, as labelled_pages() gives them: lone blocks, unknown names, threads that are the page
    itself, headed sections, plain columns, and what is never shown."""
    rng = np.random.default_rng(seed)
    pick = lambda names: names[int(rng.integers(len(names)))]
    sentence = lambda low, high: " ".join("w" * int(rng.integers(1, 11)) for _ in range(int(rng.integers(low, high)))) + pick((".", ".", "?", "!", ""))
    few = lambda: " ".join("w" * int(rng.integers(3, 9)) for _ in range(int(rng.integers(1, 4))))

    def element(tag: str, names) -> str:
        name = pick(names)
        return f"<{tag} {pick(('class', 'class', 'id'))}='{name.replace(' ', '-')}'>" if name else f"<{tag}>"

    out = []
    for k in range(n):
        page, kind = [(pick(("", "", "<body>", "<html><body>")), "", 0)], k % 8
        add = lambda before, text, y: page.append((before, text, y))
        unknown = ("", "q", "zz", "k-w", "b9")
        if rng.random() < 0.4:  # links on top, beside or above what follows
            opened, closed = pick((("<div>", "</div>"), ("<p>", "</p>"), ("<table><tr><td>", "</td><td>"), ("<ul><li>", "</li></ul>")))
            add(opened + "<a href='/x'>", "<br>".join(few() for _ in range(int(rng.integers(1, 4)))), 0)
            add("</a>" + closed, "", 0)
        if kind == 0:
            add(element(pick(("div", "div", "p", "section", "pre", "blockquote")), unknown), sentence(3, 60), 1)
        elif kind == 1:
            add(element("div", unknown) * int(rng.integers(1, 4)), few(), 1)
            for _ in range(int(rng.integers(1, 6))):
                add(pick(("</div><div>", "<p>", element("div", unknown))), sentence(4, 50), 1)
        elif kind == 2:
            add(element("div", TALK_NAMES), sentence(4, 50), 1)
            for _ in range(int(rng.integers(0, 5))):
                add("</div>" + element("div", TALK_NAMES), sentence(4, 50), 1)
        elif kind == 3:
            add(element("div", TALK_NAMES) + element("div", TALK_NAMES) + element("div", TALK_NAMES), sentence(4, 50), 1)
        elif kind == 4:
            add(element("section", ("story", "", "article", "q", "content")) + f"<h{rng.integers(1, 4)}>", few(), 1)
            for _ in range(int(rng.integers(1, 6))):
                add("</h1><p>", sentence(6, 60), 1)
        elif kind == 5:
            add(element("div", COLUMN_NAMES) + element("div", COLUMN_NAMES) + "<h1>", few(), 1)
            for _ in range(int(rng.integers(2, 6))):
                add("</h1><p>", sentence(8, 60), 1)
            add("</p></div>" + element("div", COLUMN_NAMES) + pick(("<h3>", "<h2>", "<div>")), few(), 0)
            for i in range(int(rng.integers(2, 7))):
                add("</h3></h2><ul><li><a href='/x'>" if i == 0 else "</a><li><a href='/x'>", few(), 0)
        else:
            add(pick(("<article>", "<main>", "<div>", "<body>")) + "<p>", sentence(6, 60), 1)
            hidden = pick(("template", "noscript")) if kind == 6 else ""
            add(f"<{hidden}>" + pick(("", "<p>", "<div>")) if hidden else f"</p><div role='contentinfo'{pick(('', ' id=q'))}>", sentence(1, 25), 0)
            if hidden:
                add(f"</{hidden}><p>", sentence(6, 60), 1)
        # markup without a text of its own goes before the next text
        joined, before = [], ""
        for markup, text, y in page:
            before += markup
            if text:
                joined.append((before, text, y))
                before = ""
        out.append(joined)
    return out


def read_labelled(page: list[tuple[str, str, int]], root: Place) -> tuple[list[list[str]], list[int]]:
    """The features of the page's blocks, and their labels; a block takes the label of the text it holds."""
    found = list(blocks("".join(b + t for b, t, _ in page), root))
    texts = [(" ".join(entities.unescape(t.replace("<br>", " ")).split()), y) for _, t, y in page]
    if len(found) != len(texts) or any(f[0] != t for f, (t, _) in zip(found, texts)):
        raise ValueError("a labelled page was cut in another way than it was written")
    return [p.described() + text_features(t, k, i, len(found)) for i, (t, k, p) in enumerate(found)], [y for _, y in texts]


@functools.lru_cache(maxsize=1)
def trained(n: int = 900, seed: int = 5) -> Field:
    root = Place("-", (), None)
    pages = [read_labelled(p, root) for p in [*labelled_pages(n, seed), *small_pages()]]
    field = Field({name: i for i, name in enumerate(sorted({f for x, _ in pages for names in x for f in names}))})
    field.fit([([field.ids(names) for names in x], y) for x, y in pages])
    return field


def main_text(page: str | None, field: Field, root: Place) -> str:
    root.next_page()
    found = list(blocks(page or "", root))
    if not found:
        return ""
    return " ".join(text for (text, _, _), label in zip(found, field.viterbi(field.emissions(found))) if label)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. The model is fitted on the driver: its size and data are fixed."""
    model = field or trained()
    weights = (model.known, model.w, model.start, model.step)

    def run(batches):
        own = Field(weights[0])
        own.w, own.start, own.step = weights[1:]
        root = own.root()
        for b in slices(batches):
            texts = [main_text(p.as_py(), own, root) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
