"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A small parser builds the tree of each page (raw-text elements, void elements, implied end tags, comments). Each block
element, and each run of text that stands directly in the root, html or body, gets features: its tag, the words of its
attributes by kind, the same for its ancestors, depth, text and link density of its subtree, how much of that is in
paragraphs and headings, and where it stands among its siblings and after the page's first headings. Gradient-boosted trees give the probability that it
belongs to the article. The decoder then maximizes the likelihood of keep and drop over the whole tree under the rule
that nothing is kept below a dropped element, so ancestors and descendants never contradict each other.

The trees are trained here, on pages that ``sample_page`` composes with known roles (own layouts, seeded; articles in
telling elements, bare in the body, in unnamed divs and in cells of layout tables); the model is a few kilobytes and is broadcast. The job is one scan and one Arrow map of whole pages.

Defined results: null or empty html gives an empty text; white space (Unicode's) inside a block is one space; character
references are decoded run by run of text; inline, foreign and fallback content (math, svg, object, canvas, noscript) is text
of the block it stands in, and goes or stays with it; quotes in a tag count after an equals sign and if they are closed, and
a tag that does not end drops the rest of the page, as browsers do, so that parsing is one pass over any text; pages without article give an empty text; repeated rows are extracted one by one; extra columns are ignored. Elements may
be nested to any depth.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm.tokencount import small_batches

TREES, TREE_DEPTH, RATE, TRAIN_PAGES, SEED = 60, 4, 0.3, 500, 5

_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+(?:>|\Z)", re.S)
# The rest of a tag up to its ">": no value is read twice, and an unclosed quote is an ordinary character.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+")
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop|itemtype)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title noembed noframes".split())
FOREIGN = frozenset("svg math".split())
BLOCKS = frozenset("html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th nav header footer aside form fieldset legend blockquote pre figure figcaption address details summary dialog hr menu center hgroup search select option button label".split())
CLOSES_P = BLOCKS - frozenset("html head body td th tr li dt dd option select button label".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("thead tbody tr td th", ("table",)), "tfoot": ("tbody tr td th", ("table",))}

# Kinds of tags and of attribute words.
TAG_KINDS = {"root": "html body", "article": "article main", "section": "section", "div": "div center", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dt dd", "table": "table caption thead tbody tfoot tr td th", "nav": "nav search", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend select option button label dialog", "quote": "blockquote pre", "figure": "figure figcaption", "head": "head", "loose": "", "other": ""}
WORD_KINDS = {
    "main": "article content post entry story main text body prose maincontent articlebody postbody",
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promoted promotion banner dfp",
    "menu": "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toc skip toolbar tabs",
    "header": "header masthead topbar site logo branding",
    "footer": "footer foot copyright legal colophon contentinfo bottom",
    "side": "sidebar aside side widget widgets related recommended recommendations trending popular complementary rail teaser more",
    "notice": "cookie cookies consent gdpr notice notices alert warning popup modal overlay subscribe newsletter paywall signup dialog",
    "comment": "comment comments disqus reply replies respond discussion thread responses reviews",
    "share": "share sharing social follow likes tweet tags author byline meta",
    "form": "form search login input contact feedback",
}
_TAG_NUMBER = {t: i for i, ts in enumerate(TAG_KINDS.values()) for t in ts.split()}
_WORD_NUMBER = {w: i for i, ws in enumerate(WORD_KINDS.values()) for w in ws.split()}
OTHER, N_TAGS, N_WORDS = len(TAG_KINDS) - 1, len(TAG_KINDS), len(WORD_KINDS)
LOOSE = list(TAG_KINDS).index("loose")
HEADING = _TAG_NUMBER["h1"]
PROSE = frozenset(_TAG_NUMBER[t] for t in ("p", "h1", "blockquote"))
BAD_TAGS = sum(1 << i for i, k in enumerate(TAG_KINDS) if k in ("nav", "header", "footer", "aside", "form", "head"))


class Page:
    """The block elements of a page in order, and its blocks of text with the elements they stand in.

    A run of text right in the root, html or body is an element of its own, with the tag and depth of that one.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.kind, self.words, self.depth = [-1], ["#root"], [0], [0], [0]
        self.chars, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._run: list[str] = []
        self._links = self._linked = 0
        self._parse(source)

    def _flush(self, node: int) -> None:
        if self._run:
            text = "".join(self._run)
            self._run = []
            text = " ".join(text.split())
            if text:
                if self.tag[node] in ("#root", "html", "body"):
                    node = self._add(node, self.tag[node], LOOSE, 0, self.depth[node])
                self.blocks.append((node, text))
                self.chars[node] += len(text)
            self.linked[node] += self._linked
            self._linked = 0

    def _add(self, parent: int, tag: str, kind: int, words: int, depth: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kind.append(kind)
        self.words.append(words)
        self.depth.append(depth)
        self.chars.append(0)
        self.linked.append(0)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open block elements
        opened: Counter[str] = Counter()  # how many of each tag: a deep stack is not searched for a tag that it lacks

        def cut(i: int) -> None:
            opened.subtract(t for t, _ in stack[i:])
            del stack[i:]

        at, end, foreign = 0, len(source), 0
        match = _MARKUP.search
        while True:
            m = match(source, at)
            stop = m.start() if m else end
            if stop > at:
                piece = source[at:stop]
                # References end with their run of text: what markup parts is not one reference.
                self._run.append(entities.unescape(piece) if "&" in piece else piece)
                if self._links:
                    self._linked += len(piece)
            if not m:
                break
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag, closing = tag.lower(), bool(m[1])
            rest = _REST.match(source, at)
            at = rest.end() + 1
            if at > end:
                break
            rest = rest[0]
            if tag in FOREIGN:
                foreign = 0 if closing or rest.endswith("/") else 1
            if tag in RAW and not closing:
                if foreign and rest.endswith("/"):
                    continue  # inside foreign elements a tag may close itself
                # Up to its end tag; without one, all the rest.
                low = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = low.end() if low else end
                continue
            if tag == "br":
                self._run.append(" ")
            elif tag == "a":
                self._links = 0 if closing else 1
            elif tag in BLOCKS:
                node = stack[-1][1]
                self._flush(node)
                self._links = 0
                if closing:
                    for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                        if stack[i][0] == tag:
                            cut(i)
                            break
                    continue
                if tag in CLOSES_P and any(t == "p" for t, _ in stack[-3:]):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            cut(i)
                            break
                if tag in CLOSES:
                    ends, scope = CLOSES[tag]
                    for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends.split()) else ():
                        if stack[i][0] in scope:
                            break
                        if stack[i][0] in ends.split():
                            cut(i)
                            break
                if tag == "hr":
                    continue
                parent = stack[-1][1]
                stack.append((tag, self._add(parent, tag, _TAG_NUMBER.get(tag, OTHER), self._attribute_words(rest), self.depth[parent] + 1)))
                opened[tag] += 1
        self._flush(stack[-1][1])

    @staticmethod
    def _attribute_words(attributes: str) -> int:
        found = 0
        if "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                for w in _PART.findall((m[1] or m[2] or m[3] or "").lower()):
                    n = _WORD_NUMBER.get(w)
                    if n is not None:
                        found |= 1 << n
        return found

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent, kind, words = np.array(self.parent), np.array(self.kind), np.array(self.words)
        tags_up, words_up = [0] * n, [0] * n
        for i in range(1, n):
            p = self.parent[i]
            tags_up[i] = tags_up[p] | 1 << self.kind[p]
            words_up[i] = words_up[p] | self.words[p]
        chars, linked, below = list(self.chars), list(self.linked), [1] * n
        prose, heads = [c if k in PROSE else 0 for c, k in zip(chars, self.kind, strict=True)], [int(k == HEADING) for k in self.kind]
        before = np.minimum(3, np.cumsum(heads) - heads)  # headings so far on the page
        most = [0] * n  # of the children
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            below[p] += below[i]
            prose[p] += prose[i]
            heads[p] += heads[i]
            most[p] = max(most[p], chars[i])
        chars_a, linked_a, below_a = np.array(chars, float), np.array(linked, float), np.array(below, float)
        up = np.maximum(parent, 0)
        siblings = np.bincount(up[1:], minlength=n)[up].astype(float)
        place, seen = np.zeros(n), [0] * n
        for i in range(1, n):
            place[i] = seen[self.parent[i]]
            seen[self.parent[i]] += 1
        of_parent = chars_a / np.maximum(1, chars_a[up])
        tags_a, words_a = np.array(tags_up), np.array(words_up)
        bits = lambda x, m: (x[:, None] >> np.arange(m)) & 1
        numbers = np.column_stack([
            np.array(self.depth), np.log1p(chars_a), np.log1p(below_a), np.log1p(chars_a / below_a), np.minimum(1, linked_a / np.maximum(1, chars_a)),
            chars_a / max(1.0, chars_a[0]), siblings, place / np.maximum(1, siblings - 1), of_parent, np.log1p(np.array(self.chars)), (tags_a & BAD_TAGS) > 0,
            np.array(prose) / np.maximum(1, chars_a), np.log1p(np.array(prose)), np.minimum(3, heads), np.minimum(3, np.array(heads)[up]), before, chars_a / np.maximum(1, np.array(most)[up]),
            np.array(prose) / np.maximum(1, np.array(prose)[up]), np.array(prose)[up] / np.maximum(1, chars_a[up]),
        ])
        return np.column_stack([numbers, kind[:, None] == np.arange(N_TAGS), bits(words, N_WORDS), bits(tags_a, N_TAGS), bits(words_a, N_WORDS)]).astype(np.float32)


class BoostedTrees:
    """Gradient boosting with logistic loss on binned features; trees of fixed depth as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, rate: float = RATE, bins: int = 24):
        self.depth = depth
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        n, d = x.shape
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        score = np.full(n, self.start)
        self.feature = np.zeros((trees, 2**depth - 1), np.int64)
        self.cut = np.full((trees, 2**depth - 1), np.inf, np.float32)
        self.value = np.zeros((trees, 2**depth))
        width = max(len(e) for e in edges) + 1
        cell = binned + np.arange(d) * width
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                at = ((node * d * width)[:, None] + cell).ravel()
                gs = np.bincount(at, np.repeat(g, d), count * d * width).reshape(count, d, width).cumsum(axis=2)
                hs = np.bincount(at, np.repeat(h, d), count * d * width).reshape(count, d, width).cumsum(axis=2)
                g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
                gain[(hs < 0.5) | (h_all - hs < 0.5)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                feature, split = best // width, best % width
                useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
                for k in range(count):
                    if useful[k] and split[k] < len(edges[feature[k]]):
                        self.feature[t, first + k], self.cut[t, first + k] = feature[k], edges[feature[k]][split[k]]
                right = x[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node]
                node = 2 * node + right
            gl, hl = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            self.value[t] = -rate * gl / (hl + 1)
            score += self.value[t][node]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def decode(parent: list[int], logits: np.ndarray) -> np.ndarray:
    """Which elements stay: the likeliest choice in which whatever stands below a dropped element is dropped. The root stays.

    With logit l, keeping a node instead of dropping it is worth l plus what its children are worth, if that is above 0.
    """
    worth = logits.tolist()
    for i in range(len(parent) - 1, 0, -1):
        if worth[i] > 0:
            worth[parent[i]] += worth[i]
    keep = np.zeros(len(parent), bool)
    keep[0] = True
    for i in range(1, len(parent)):
        keep[i] = keep[parent[i]] and worth[i] > 0
    return keep


def sample_page(seed: int) -> tuple[str, list[int]]:
    """A page composed at random and, for each block element in order, 1 if it holds or belongs to the article."""
    r = random.Random(seed)
    out: list[str] = []
    roles: list[int] = []
    letters = "abcdefghijklmnopqrstuvwxyzéüñß"

    def text(lo: int, hi: int) -> str:
        n = int(math.exp(r.uniform(math.log(lo), math.log(hi))))
        return " ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n)) + r.choice([".", "", "!", "&amp;"])

    def element(tag: str, role: int, body, names: str = "", attribute: str = "") -> None:
        roles.append(role)
        attribute = attribute or (f' {r.choice(["class", "id", "class", "role"])}="{r.choice(names.split())}{r.choice(["", "", "-x", " q7", "_box"])}"' if names else "")
        out.append(f"<{tag}{attribute}>")
        body()
        out.append(f"</{tag}>" if tag != "p" or r.random() < 0.8 else "")

    def words(lo: int, hi: int):
        return lambda: out.append(text(lo, hi))

    def inline(lo: int, hi: int):
        def body() -> None:
            out.append(r.choice(["", "<b>", "<em>", ""]) + text(lo, hi) + (f'<a href="/q">{text(1, 4)}</a>' if r.random() < 0.2 else "") + r.choice(["", "<br>", " " + text(1, 20)]))

        return body

    def links(role: int, n: int, item: str = "li"):
        def body() -> None:
            for _ in range(n):
                element(item, role, lambda: out.append(f'<a href="/{text(1, 1)}">{text(1, 5)}</a>' if r.random() < 0.85 else text(1, 6)))

        return body

    def paragraphs(role: int, lo: int, hi: int):
        def body() -> None:
            for _ in range(r.randint(1, 4)):
                element(r.choice(["p", "p", "div"]), role, inline(lo, hi))

        return body

    def loose(role: int, lo: int, hi: int) -> None:
        roles.append(role)
        out.append(f"</p>{text(lo, hi)}" + (f"<br><br>{text(lo, hi)}" if role and r.random() < 0.5 else ""))

    def unnamed(kind: str) -> None:
        """A menu, a site's name or a last line in elements that tell nothing, each told by its text and place."""
        if kind == "menu":
            element(r.choice(["div", "ul"]), 0, links(0, r.randint(2, 8), r.choice(["li", "div", "p"])))
        elif kind == "inline menu":
            element(r.choice(["div", "p"]), 0, lambda: out.append(r.choice([" | ", " ", " &middot; "]).join(f'<a href="/">{text(1, 3)}</a>' for _ in range(r.randint(2, 8)))))
        else:
            element("div", 0, words(1, 9))

    def boilerplate(kind: str) -> None:
        any_body = r.choice([words(1, 60), paragraphs(0, 1, 40), lambda: element("ul", 0, links(0, r.randint(2, 8))), links(0, r.randint(1, 5), "p")])
        if headed := r.random() < 0.3:
            rest = any_body
            any_body = lambda: (element(r.choice(["h2", "h3", "h4"]), 0, words(1, 4)), rest())
        plain = r.random() < 0.4
        if kind == "menu":
            if r.random() < 0.6:
                element("nav", 0, lambda: element("ul", 0, links(0, r.randint(3, 9))), "" if plain else WORD_KINDS["menu"])
            else:
                element(r.choice(["div", "ul"]), 0, links(0, r.randint(3, 9)), WORD_KINDS["menu"])
        elif kind == "comment":
            def comments() -> None:
                for _ in range(r.randint(1, 4)):
                    element(r.choice(["div", "li", "article"]), 0, paragraphs(0, 3, 80), WORD_KINDS["comment"] if r.random() < 0.7 else "")

            element(r.choice(["section", "div", "ol"]), 0, comments, WORD_KINDS["comment"])
        elif kind == "form":
            element("form", 0, lambda: (element("label", 0, words(1, 4)), out.append("<input>"), element("button", 0, words(1, 2))), "" if plain else WORD_KINDS["form"])
        elif kind in ("header", "footer"):
            if r.random() < 0.65:
                element(kind, 0, any_body, "" if plain else WORD_KINDS[kind])
            else:
                element("div", 0, any_body, WORD_KINDS[kind])
        elif kind == "related":
            def teasers() -> None:
                element(r.choice(["h2", "h3", "h4", "p"]), 0, words(1, 4))
                if r.random() < 0.6:
                    element("ul", 0, links(0, r.randint(1, 6)))
                else:
                    for _ in range(r.randint(1, 4)):
                        element(r.choice(["div", "article"]), 0, lambda: (element(r.choice(["h3", "h4"]), 0, lambda: out.append(f'<a href="/">{text(1, 6)}</a>')), element("p", 0, words(3, 30))))

            element(r.choice(["div", "section", "aside"]), 0, teasers, "related related-posts related-articles more-stories recommended recommendations trending popular")
        elif kind == "side" and r.random() < 0.65:
            element("aside", 0, any_body, "" if plain else WORD_KINDS["side"])
        else:
            element(r.choice(["div", "div", "section", "div" if headed else "p"]) if kind != "side" else "div", 0, words(1, 60) if r.random() < 0.5 else any_body, WORD_KINDS[kind])

    def article() -> None:
        if r.random() < 0.85:
            heading = r.choice(["h1", "h1", "h2"])
            (element("header", 1, lambda: element(heading, 1, words(1, 12))) if r.random() < 0.12 else element(heading, 1, words(1, 12), "title headline" if r.random() < 0.2 else ""))
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.75:
                element("p", 1, inline(1, 120), "lead text intro" if r.random() < 0.08 else "")
            elif x < 0.79:
                element(r.choice(["h2", "h3"]), 1, words(1, 8))
            elif x < 0.83:
                element("ul", 1, lambda: [element("li", 1, inline(1, 20)) for _ in range(r.randint(1, 5))])
            elif x < 0.86:
                element(r.choice(["blockquote", "pre"]), 1, words(2, 40))
            elif x < 0.88:
                element("figure", 1, lambda: element("figcaption", 1, words(2, 12)))
            elif x < 0.90:
                element("table", 1, lambda: [element("tr", 1, lambda: [element("td", 1, words(1, 4)) for _ in range(3)]) for _ in range(2)])
            elif x < 0.92:
                element(r.choice(["div", "section"]), 1, lambda: element("p", 1, inline(2, 80)))
            else:
                boilerplate(r.choice(["ad", "ad", "side", "side", "related", "notice", "share", "form"]))
        if r.random() < 0.2:
            boilerplate(r.choice(["side", "related", "comment", "form", "share"]))

    def framed(levels: int) -> None:
        """The article in unnamed divs, the outer ones with something beside it."""
        def inside() -> None:
            if levels == 1:
                return article()
            beside = r.choice([None, "menu", "inline menu", "line"])
            if beside and r.random() < 0.5:
                unnamed(beside)
            framed(levels - 1)
            if beside and r.random() < 0.5:
                unnamed(beside)

        element(r.choice(["div", "div", "section"]), 1, inside)

    def cells() -> None:
        """The article in a cell of a layout table."""
        def row() -> None:
            if r.random() < 0.5:
                element("td", 0, r.choice([links(0, r.randint(2, 7), "p"), lambda: unnamed("inline menu"), lambda: element("ul", 0, links(0, r.randint(2, 7))), lambda: out.append("<br>".join(f'<a href="/">{text(1, 4)}</a>' for _ in range(r.randint(2, 8))))]))
            element("td", 1, article)
            if r.random() < 0.4:
                element("td", 0, lambda: unnamed(r.choice(["menu", "line", "inline menu"])))

        def rows() -> None:
            if r.random() < 0.5:
                element("tr", 0, lambda: element("td", 0, r.choice([words(1, 8), lambda: out.append(f'<a href="/">{text(1, 4)}</a>')])))
            element("tr", 1, row)
            if r.random() < 0.7:
                element("tr", 0, lambda: element("td", 0, words(1, 9)))

        element("table", 1, rows)

    def bare() -> None:
        """The article right in the body, some of it as loose text."""
        article()
        if r.random() < 0.15 and not wrapped:
            loose(1, 20, 150)
            element("p", 1, inline(5, 60))

    def main() -> None:
        x = r.random()
        if telling:
            if x < 0.45:
                element("article", 1, article, "" if r.random() < 0.6 else WORD_KINDS["main"])
            elif x < 0.65:
                element("main", 1, lambda: element("article", 1, article) if r.random() < 0.5 else article())
            else:
                element(r.choice(["div", "section", "div"]), 1, article, WORD_KINDS["main"])
        elif x < 0.4:
            bare()
        elif x < 0.75:
            framed(r.randint(1, 4))
        else:
            cells()

    has, fragment, telling = r.random() < 0.85, r.random() < 0.15, r.random() < 0.6
    wrapped = not fragment and r.random() < 0.3

    def body() -> None:
        most = 1 if fragment else 5  # fragments are a part or two of a page, without its frame
        before = r.sample(["menu", "header", "ad", "notice", "side", "form", "share"], r.randint(0, min(4, most)))
        after = r.sample(["comment", "footer", "side", "ad", "form", "notice", "menu", "share"], r.randint(0, most))

        def inside() -> None:
            stray = 1 if wrapped else r.random()
            for k in before:
                boilerplate(k) if telling or r.random() < 0.6 else unnamed(r.choice(["menu", "inline menu", "line"]))
            if stray < 0.12:
                loose(0, 1, 9)
            if has:
                main()
            if 0.12 < stray < 0.25 and (telling or not has):
                loose(0, 1, 12)
            for k in after:
                boilerplate(k) if telling or r.random() < 0.6 else unnamed(r.choice(["menu", "inline menu", "line"]))

        element("div", int(has), inside, "wrapper page container site" if r.random() < 0.6 else "") if wrapped else inside()

    def whole() -> None:
        element("head", 0, lambda: out.append(f"<title>{text(1, 9)}</title><style>p{{}}</style><script>var a='<p>';</script>"))
        element("body", int(has), body)

    if fragment:
        body()
        return "".join(out), roles
    out.append("<!DOCTYPE html>")
    element("html", int(has), whole, "", ' lang="xx"')
    return "".join(out), roles


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> BoostedTrees:
    """The model; the same for the same arguments."""
    x, y = [], []
    for i in range(pages):
        source, roles = sample_page(seed * 100_000 + i)
        page = Page(source)
        assert len(page.parent) == len(roles) + 1, "the parser sees the elements that were composed"
        x.append(page.features()[1:])
        y.append(np.array(roles, float))
    return BoostedTrees(np.concatenate(x), np.concatenate(y))


def extract(sources: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    logits = model.logits(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        keep = decode(p.parent, logits[at : at + n])
        at += n
        out.append("\n\n".join(text for node, text in p.blocks if keep[node]))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The operator: (page_id, url, text, n_chars) of each row."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = [s or "" for s in batch.column(2).to_pylist()]
            texts: list[str] = []
            for a, b in small_batches(sources, 1_000_000):
                texts += extract(sources[a:b], model.value)
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
