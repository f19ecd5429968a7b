"""HTML extraction by minimum-cut labelling of text blocks.

A page becomes a row of text blocks with their element paths.  A classifier gives every block a cost: what its words,
links and marks look like, and what the elements around it say of themselves (their names, roles, classes and identifiers).  All
costs are finite weights, learnt from a sample; no block is settled beforehand.  They are the capacities to the terminals.  Neighbouring
blocks, blocks near to each other in the document tree, and blocks that the same element speaks for are tied by smoothness edges.  The minimum cut,
found by maximum flow, is the cheapest labelling; blocks on the side of the source are the content.  So a heading or a
short line, which look like a menu, go with the article that holds them.

The classifier has two views that teach each other.  Text, links and place in the page are learnt from blocks whose elements
speak plainly; weights of elements and of words of classes and identifiers are learnt from what the first view is sure of, those of known words near to
their prior.

An article speaks for all its blocks together: it is a node of its own, whose capacity grows with their number, tied to each.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, in_slices, schema

SPACE = " \t\n\f\r"
#: A tag without attribute values, by far the most frequent kind.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)([^<>\"'=]*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)")
_ATTRIBUTE = re.compile(r"[ \t\n\f\r/]*+(?:([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)[ \t\n\f\r]*+(?:(=)[ \t\n\f\r]*+(?:([\"'])|([^ \t\n\f\r>]*+)))?)?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas select option textarea button audio video annotation annotation-xml".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
#: Elements that run inside a line; all others begin a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr script style noscript template svg iframe object canvas select textarea button audio video math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and roles that by their meaning aren't the article, and those that are.
NOT_MAIN = frozenset("nav aside footer header form dialog menu address".split())
MAIN = frozenset(("article", "main"))
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog", "menu": "menu", "menubar": "menu", "article": "article", "main": "main"}
#: Words of classes and identifiers that name what isn't the article, and words that name it.
STRONG = frozenset("nav navbar navigation menu menubar masthead footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs recommended recommendations widget pagination pager comment comments commentlist disqus respond".split())
WEAK = frozenset("header banner aside side related trending reply replies form search copyright legal disclaimer toolbar skip tags tag meta byline complementary contentinfo alert dialog".split())
CONTENT = frozenset("article main content post entry story text articlebody maincontent body".split())
#: Words that say nothing of their own beside others in a class, as in ad-slot or comment-list.
GENERIC = frozenset("area bar block box button buttons center column container div feed footer group header holder icon inline inner item items label left link links list main outer page panel pane placeholder region right row section side site slot small strip top bottom unit view wrap wrapper zone".split()) - {"holder"}
#: Strong words whose boxes may hold article elements, one for each reader's comment.
REPLIES = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that make an article element a teaser of another page or a reader's reply.
TEASER = frozenset("related trending reply replies teaser card".split())
_NEGATED = re.compile(r"^(?:has|with|no|without|not|is)[-_]", re.I)
DEEPEST = 512  # elements below this depth hang there, as in browsers
_TEXT = 13  # features of the text, its links and its place
#: Features of what elements are, with their prior weights, then a hash of the words that no list knows.
PRIOR = {**dict.fromkeys(sorted(NOT_MAIN), -9.0), "address": -2.0, "inside": 2.6, "outside": -2.0, **{f".{w}": -9.0 for w in sorted(STRONG)}, **{f".{w}": -2.5 for w in sorted(WEAK)}, **{f".{w}": 1.2 for w in sorted(CONTENT)}}
NUMBER = {name: _TEXT + k for k, name in enumerate(PRIOR)}
KNOWN = _TEXT + len(PRIOR)
HASHED = 4096
WIDTH = KNOWN + HASHED


class Element:
    """A block element: its meaning (a name of NOT_MAIN or MAIN, or none), words with their amounts, whether it holds the page's core, and characters in it."""

    __slots__ = ("name", "serial", "meaning", "words", "parent", "core", "mass")

    def __init__(self, name, serial, meaning, words, parent):
        self.name, self.serial, self.meaning, self.words, self.parent, self.core, self.mass = name, serial, meaning, words, parent, False, 0

    def mark(self) -> None:
        """This element and all that hold it hold the page's core."""
        up = self
        while up is not None and not up.core:
            up.core = True
            up = up.parent

    def plainly(self, words: frozenset) -> bool:
        """Whether one of ``words`` stands in a class or identifier without words that could change its sense."""
        return any(w in words and amount == 1 for w, amount in self.words.items())

    def speaks(self) -> bool:
        """Whether it says of itself that it is the article or something else."""
        return bool(self.meaning) or self.plainly(STRONG) or self.plainly(TEASER)


class Block:
    __slots__ = ("text", "path", "link")

    def __init__(self, text, path, link):
        self.text, self.path, self.link = text, path, link


class _Scanner:
    """Tags of a page, each character looked at a bounded number of times whatever the markup."""

    def __init__(self, page: str):
        self.page = page
        self.quote = {'"': -1, "'": -1}  # place of the next one, once asked

    def _closing(self, mark: str, at: int) -> int:
        """Place of the next ``mark`` from ``at``; the page's length if there is none."""
        if self.quote[mark] < at:
            k = self.page.find(mark, at)
            self.quote[mark] = len(self.page) if k < 0 else k
        return self.quote[mark]

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """(names with values, place behind the tag, closes itself) from behind a tag's name.

        Unquoted values run to white space or >.  A quote that is never closed, or whose end is followed by
        what can't follow a value while a > stands before it, was left open: the tag then ends at that >.
        """
        page, found, closes = self.page, [], False
        while True:
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            if m[1] is None:
                closes = page[at - 1] == "/" if at else False
                return found, min(at + 1, len(page)), closes
            if m[3]:
                end = self._closing(m[3], at)
                stray = end == len(page) or (end + 1 < len(page) and page[end + 1] not in " \t\n\f\r/>")
                stop = page.find(">", at, end) if stray else -1
                if stop >= 0:
                    found.append((m[1], page[at:stop]))
                    return found, stop + 1, False
                if end == len(page):
                    found.append((m[1], page[at:]))
                    return found, end, False
                found.append((m[1], page[at:end]))
                at = end + 1
            elif m[2]:
                found.append((m[1], m[4]))


def _words(attributes) -> tuple[dict[str, float], str]:
    """(words of class and identifier with their amounts, meaning by role).  Beside unknown words a known one counts a third."""
    words, meaning = {}, ""
    for name, value in attributes:
        name = name.lower()
        if name in ("class", "id"):
            for token in value.split():
                if not _NEGATED.match(token):
                    own = _WORD.findall(_CAMEL.sub(" ", token).lower())
                    sure = all(w in STRONG or w in WEAK or w in GENERIC for w in own)
                    for w in own:
                        known = w in STRONG or w in WEAK
                        words[w] = max(words.get(w, 0.0), 0.3 if known and not sure else 1.0)
        elif name == "role":
            meaning = ROLES.get(value.strip().lower(), "")
    return words, meaning


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order.  Unclosed and stray tags are met as browsers do, roughly; null has none.

    The time is linear in the page whatever its markup: broken tags and quotes aren't scanned
    again, and elements are nested to a depth of ``DEEPEST`` at most.
    """
    page = page or ""
    scan = _Scanner(page)
    stack: list[tuple[str, Element | None]] = []  # (name, element of a block)
    open_: Counter = Counter()
    out: list[Block] = []
    seen: dict[int, Element] = {}
    titles: list[Element] = []
    pieces: list[str] = []
    linked = serial = at = 0
    hidden = in_link = 0
    size = len(page)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tuple(s[1] for s in stack if s[1] is not None), min(1.0, linked / len(text))))
                own = len(text) - min(linked, len(text))
                for e in out[-1].path:
                    seen[e.serial] = e
                    e.mass += own
            pieces.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw and not hidden:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    def drop(first: int):
        nonlocal hidden, in_link
        for name, _ in stack[first:]:
            hidden -= name in HIDDEN
            in_link -= name == "a"
            open_[name] -= 1
        del stack[first:]

    begin = 0  # of the text not yet taken
    while True:
        less = page.find("<", at)
        if less < 0 or less + 1 >= size:
            say(page[begin:])
            break
        then = page[less + 1]
        if then == "!" or then == "?" or (then == "/" and not page[less + 2 : less + 3].isalpha()):
            say(page[begin:less])
            if page.startswith("<!--", less):
                end = less + 4 if page.startswith(">", less + 4) else page.find("-->", less + 4)
                at = size if end < 0 else end + (1 if end == less + 4 and page[end] == ">" else 3)
            else:
                end = page.find(">", less)
                at = size if end < 0 else end + 1
            begin = at
            continue
        if then != "/" and not then.isalpha():  # a lone < is text
            at = less + 1
            continue
        m = _PLAIN.match(page, less)
        if m:
            closing, name, rest = m.groups()
            attributes, behind, closes = (), m.end(), rest.endswith("/")
        else:
            m = _NAME.match(page, less)
            if not m:  # a letter that no tag begins with
                at = less + 1
                continue
            closing, name = m.groups()
            attributes, behind, closes = scan.attributes(m.end())
        say(page[begin:less])
        at = begin = behind
        name = name.lower()
        inline = name in INLINE
        if closing:
            if not open_[name]:
                if not inline and not hidden:
                    flush()
                continue
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            if inline and any(s[1] is not None for s in stack[depth:]):
                # an inline end tag doesn't close the blocks around it
                hidden -= name in HIDDEN
                in_link -= name == "a"
                open_[name] -= 1
                del stack[depth]
                continue
            if not inline and not hidden:
                flush()
            drop(depth)
            continue
        if not inline:
            if not hidden:
                flush()
            closed = CLOSES_ITSELF.get(name)
            if closed:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closed:
                        drop(k)
                        break
                    if stack[k][1] is not None:
                        break
        elif name == "br" and not hidden:
            pieces.append(" ")
        if name in VOID or closes:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[ \t\n\f\r/>])[^>]*+>?", re.I).search(page, at)
            at = begin = end.end() if end else size
            continue
        if len(stack) >= DEEPEST:
            if stack[-1][0] in HIDDEN:
                continue
            drop(len(stack) - 1)
        element = None
        if not inline:
            serial += 1
            words, role = _words(attributes)
            meaning = role or (name if name in NOT_MAIN or name in MAIN else "")
            parent = next((s[1] for s in reversed(stack) if s[1] is not None), None)
            element = Element(name, serial, meaning, {} if name in ("html", "body") else words, parent)
            if name == "h1":
                titles.append(element)
        stack.append((name, element))
        open_[name] += 1
        hidden += name in HIDDEN
        in_link += name == "a"
    flush()
    _mark_core([*seen.values()], titles, sum(len(b.text) * (1 - b.link) for b in out))
    return out


def _within(e: Element | None, what) -> bool:
    while e is not None:
        if what(e):
            return True
        e = e.parent
    return False


def _mark_core(seen: list[Element], titles: list[Element], whole: float) -> None:
    """Mark what holds the page's core: its main element and longest article; without both its first heading of level one; without any what holds
    more than half of its text.  None of them within navigation and the like, replies or teasers of other pages."""
    elsewhere = lambda e: (e.meaning in NOT_MAIN and e.meaning not in ("form", "dialog", "menu")) or e.plainly(REPLIES) or e.plainly(TEASER)
    main = [e for e in seen if e.meaning == "main" and not _within(e, elsewhere)]
    articles = [e for e in sorted(seen, key=lambda e: (-e.mass, e.serial)) if e.meaning == "article" and not _within(e, elsewhere)][:1]
    for e in main + articles:
        e.mark()
    if main or articles:
        return
    for e in titles:
        if not _within(e, elsewhere):
            if e.parent is not None:
                e.parent.mark()
            return
    for e in seen:
        if 2 * e.mass > whole and not _within(e, lambda e: e.meaning in NOT_MAIN or e.plainly(REPLIES)):
            e.core = True


_HASHED: dict = {}


def _feature(word: str) -> int:
    k = NUMBER.get(f".{word}") or _HASHED.get(word)
    if k is None:
        if len(_HASHED) > 200_000:
            _HASHED.clear()
        k = _HASHED[word] = KNOWN + zlib.crc32(word.encode()) % HASHED
    return k


def _own_part(e: Element) -> bool:
    """Whether it is the header or an address of an article."""
    return e.meaning in ("header", "address") and _within(e.parent, lambda up: up.meaning in MAIN)


def elements(block: Block, articled: bool) -> list[tuple[int, float]]:
    """Features of what the elements around a block say, with amounts.  ``articled``: whether the page has an article.

    Elements that hold the page's core say nothing against it, whatever their names.  What says that a box isn't the article
    counts whole at any depth; words of content, and unknown ones, count half as much for each element farther out.  The header and
    addresses of an article belong to it.
    """
    said: dict[int, float] = {}
    amount, inside = 1.0, False
    for k in range(len(block.path) - 1, -1, -1):
        e = block.path[k]
        if e.meaning in MAIN:
            inside = inside or not e.plainly(TEASER)
        elif e.meaning and not (e.core and e.meaning in ("form", "dialog", "menu")):
            if not _own_part(e):
                said[NUMBER[e.meaning]] = 1.0
        good, other = [], []
        for w, share in e.words.items():
            if w in STRONG or w in WEAK:
                if not e.core:
                    said[_feature(w)] = max(said.get(_feature(w), 0.0), share)
            else:
                (good if w in CONTENT else other).append(_feature(w))
        if (good or other) and amount > 0.05:
            for own in (good, other):
                for f in own:
                    said[f] = said.get(f, 0.0) + amount / (len(own) if own is good else 1)
            amount /= 2
    if inside:
        said[NUMBER["inside"]] = 1.0
    elif articled:
        said[NUMBER["outside"]] = 1.0
    return sorted(said.items())


def features(found: list[Block], k: int) -> np.ndarray:
    """Features of the text, links and place of block ``k`` of a page."""
    block = found[k]
    text = block.text
    words = text.count(" ") + 1
    marks = sum(map(text.count, ".,;:!?"))
    around = [b for b in found[max(0, k - 1) : k + 2] if b is not block]
    near = sum(min(b.text.count(" ") + 1, 100) * (1 - b.link) for b in around) / max(1, len(around)) / 50
    place = (k + 0.5) / len(found)
    return np.array([1.0, block.link, min(words, 100) / 50, words < 4, words < 12, words >= 25, min(1.0, marks / words), "©" in text, text.count("|") / words, near, place < 0.1, place > 0.9, len(found) == 1], float)


def prior() -> np.ndarray:
    """Weights before training: plain facts on text, and what elements and some words of classes and identifiers say."""
    w = np.zeros(WIDTH)
    w[:_TEXT] = (0.3, -3.0, 0.8, -0.6, -0.4, 0.8, 1.0, -2.0, -1.0, 0.5, 0.0, -0.3, 1.0)
    for name, value in PRIOR.items():
        w[NUMBER[name]] = value
    return w


def has_article(found: list[Block]) -> bool:
    return any(e.core and e.meaning in MAIN for b in found for e in b.path)


def logits(found: list[Block], w: np.ndarray) -> list[float]:
    """The classifier's cost of every block of its own: above 0 for content.  The text's part is held within 3, so that it can't outweigh elements that speak plainly."""
    articled = has_article(found)
    own = lambda b: sum(w[i] * a for i, a in elements(b, articled) if i != NUMBER["inside"])
    return [float(np.clip(features(found, k) @ w[:_TEXT], -3, 3) + own(b)) for k, b in enumerate(found)]


def train(pages: DataFrame, html_col: str = "html", key: str = "page_id", rows: int = 1000, per_page: int = 40, epochs: int = 4, rate: float = 0.05, pull: float = 0.02, hold: float = 0.5, sure: float = 1.5) -> np.ndarray:
    """Weights of the block classifier, fitted on at most ``per_page`` blocks of about ``rows`` pages (a bounded sample by a hash of the key).

    Pages are cut into blocks where they lie; only features of the sampled blocks, spread evenly over each page, come to the driver.  The
    text's view is fitted to blocks in an article and to those in what speaks against it; the elements' view to the blocks of which
    the text's view is sure (a logit beyond ``sure``).  ``pull`` draws weights to the prior, ``hold`` those of known words and elements, which so stay within 1 / hold of it.
    """
    out = schema(("page", "long"), ("label", "int"), ("x", "array<double>"), ("words", "array<int>"), ("amounts", "array<double>"))
    w0 = prior()

    def describe(batches):
        for batch in in_slices(batches):
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                articled = has_article(found)
                some = range(len(found)) if len(found) <= per_page else np.unique(np.linspace(0, len(found) - 1, per_page).astype(int)).tolist()
                got = []
                for k in some:
                    said = elements(found[k], articled)
                    total = sum(w0[i] * a for i, a in said)
                    label = -1 if total < -4 else int(total > 0 and any(i == NUMBER["inside"] for i, _ in said))
                    got.append((label, features(found, k), said))
                if got:
                    same = zlib.crc32((page or "").encode("utf-8", "replace"))
                    yield pa.RecordBatch.from_arrays([pa.array([same] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1].tolist() for g in got], pa.list_(pa.float64())), pa.array([[k for k, _ in g[2]] for g in got], pa.list_(pa.int32())), pa.array([[a for _, a in g[2]] for g in got], pa.list_(pa.float64()))], out.names)

    some = about(pages.select(key, html_col), key, rows, "html").select(F.col(html_col).cast("string").alias("text"))
    table = some.mapInArrow(describe, out).toArrow()
    label = table.column("label").to_numpy()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, _TEXT)
    words = [list(zip(k, a)) for k, a in zip(table.column("words").to_pylist(), table.column("amounts").to_pylist())]
    order = np.lexsort((*x.T, label, table.column("page").to_numpy()))  # whatever the order in which tasks end
    w = w0.copy()
    rng = np.random.default_rng(0)
    plain = order[label[order] != 0]
    good = label > 0
    share = float(np.mean(good[plain])) if len(plain) else 0.5
    for _ in range(epochs):
        for k in plain[rng.permutation(len(plain))]:
            p = 1 / (1 + np.exp(-np.clip(x[k] @ w[:_TEXT], -20, 20)))
            step = rate * (good[k] - p) * (0.5 / max(0.05, share if good[k] else 1 - share))
            w[:_TEXT] += step * x[k] - rate * pull * (w[:_TEXT] - w0[:_TEXT])
    said = x @ w[:_TEXT]
    taught = [k for k in order if words[k] and abs(said[k]) > sure]
    for _ in range(epochs if taught else 0):
        for k in rng.permutation(taught):
            at = np.array([i for i, _ in words[k]])
            amount = np.array([a for _, a in words[k]])
            p = 1 / (1 + np.exp(-np.clip(w[at] @ amount, -20, 20)))
            w[at] += rate * ((said[k] > 0) - p) * amount - rate * np.where(at < KNOWN, hold, pull) * (w[at] - w0[at])
    return w


def min_cut(source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node, whether it lies on the source's side of the minimum cut (Dinic's maximum flow).

    A node whose own capacities outweigh all its edges is settled beforehand and merged
    with that terminal, which changes no cut of least value.
    """
    n = len(source)
    around = [0.0] * n
    for (a, b), c in edges.items():
        around[a] += c
        around[b] += c
    side: list = [None] * n
    for k in range(n):
        if source[k] - sink[k] > around[k]:
            side[k] = True
        elif sink[k] - source[k] >= around[k]:
            side[k] = False
    open_ = [k for k in range(n) if side[k] is None]
    if not open_:
        return side
    number = {k: i + 2 for i, k in enumerate(open_)}
    to: list[list[list]] = [[] for _ in range(len(open_) + 2)]  # node: [target, capacity, index of reverse]

    def link(a, b, forth, back):
        to[a].append([b, forth, len(to[b])])
        to[b].append([a, back, len(to[a]) - 1])

    into, outof = {k: source[k] for k in open_}, {k: sink[k] for k in open_}
    for (a, b), c in edges.items():
        if side[a] is None and side[b] is None:
            link(number[a], number[b], c, c)
        elif side[a] is None or side[b] is None:
            k, fixed = (a, side[b]) if side[a] is None else (b, side[a])
            (into if fixed else outof)[k] += c
    for k in open_:
        link(0, number[k], into[k], 0.0)
        link(number[k], 1, outof[k], 0.0)
    while True:
        level = [-1] * len(to)
        level[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for b, c, _ in to[a]:
                if c > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[1] < 0:
            break
        next_ = [0] * len(to)
        path: list[list] = []
        a = 0
        while True:  # augment along the level graph, depth first, without recursion
            if a == 1:
                push = min(e[1] for e in path)
                for e in path:
                    e[1] -= push
                    to[e[0]][e[2]][1] += push
                path.clear()
                a = 0
                continue
            while next_[a] < len(to[a]):
                e = to[a][next_[a]]
                if e[1] > 1e-12 and level[e[0]] == level[a] + 1:
                    break
                next_[a] += 1
            if next_[a] < len(to[a]):
                path.append(to[a][next_[a]])
                a = path[-1][0]
            elif path:
                e = path.pop()
                a = to[e[0]][e[2]][0]
                next_[a] += 1
            else:
                break
    for k in open_:
        side[k] = level[number[k]] >= 0
    return side


def costs(found: list[Block], w: np.ndarray, adjacent: float = 0.5, near: float = 0.5, kin: float = 2.8) -> tuple[list[float], list[float], dict[tuple[int, int], float]]:
    """(capacities from the source, to the sink, between nodes) of a page.  Nodes are its blocks, then its articles.

    ``adjacent`` ties blocks that follow each other, less so the farther they lie apart in the document
    tree; ``near`` ties a block to the one before it in the same parent's parent; ``kin`` ties it to the article, if no element within that speaks of another
    part of the page.
    """
    source, sink, edges, last, articles = [], [], {}, {}, {}
    for k, (block, logit) in enumerate(zip(found, logits(found, w))):
        source.append(max(0.0, logit))
        sink.append(max(0.0, -logit))
        if k:
            before = found[k - 1].path
            common = 0
            for a, b in zip(before, block.path):
                if a is not b:
                    break
                common += 1
            apart = len(before) + len(block.path) - 2 * common
            edges[k - 1, k] = adjacent / (1 + max(0, apart - 2))
        box = block.path[-2].serial if len(block.path) > 1 else 0
        if box in last:
            pair = (last[box], k)
            edges[pair] = edges.get(pair, 0.0) + near
        last[box] = k
        speaker = next((e for e in reversed(block.path) if e.speaks() and not _own_part(e)), None)
        if speaker is not None and speaker.meaning in MAIN and not speaker.plainly(TEASER):
            articles.setdefault(speaker.serial, []).append(k)
    for n, held in enumerate(articles.values(), len(found)):
        source.append(max(0.0, w[NUMBER["inside"]] * len(held)))
        sink.append(max(0.0, -w[NUMBER["inside"]] * len(held)))
        edges.update({(k, n): kin for k in held})
    return source, sink, edges


def extract(page: str | None, w: np.ndarray) -> list[Block]:
    """The content blocks of a page, those on the source's side of the minimum cut."""
    found = blocks(page)
    return [b for b, keep in zip(found, min_cut(*costs(found, w))) if keep]


def main_text(pages: DataFrame, w: np.ndarray, key: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, kept columns, text) of every page; null, empty or textless pages give an empty text.

    One pass over whole pages, without a shuffle.  Repeated rows give repeated results and an empty table none;
    columns that aren't kept are ignored, one named ``text`` can't be kept.  Very long
    and broken pages take time in proportion to their length.  A block as likely content as not is left out.
    """
    if "text" in (key, *keep):
        raise ValueError("the column text is the result's; rename the table's own to keep it")
    held = [key, *keep]
    plain = pages.select(*held, F.col(html_col).cast("string").alias("text"))

    def run(batches):
        for batch in in_slices(batches):
            texts = ["\n\n".join(b.text for b in extract(page, w)) for page in batch.column(len(held)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*held, "text"])

    return plain.mapInArrow(run, plain.schema)
