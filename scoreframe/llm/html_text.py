"""Main text of web pages by tag-path ratios.

The text blocks of a page are gathered by their root-to-leaf tag path. For each
path the mean text length and the mean number of punctuation marks of its blocks
are taken (links do not count), smoothed over neighbouring paths in page order
and fused to one score. The scores of the paths add up per container, which is
the outermost ``article`` or ``main``; those that reach a share of the best one
are the content, and all their blocks are kept, in page order. On a page without
them the content is the deepest element that holds most of the score, with what
stands beside it or its parents and is not weak, and the headings before that;
where it is the body, its weak parts are left out. What a tag, class, id or role names as a
menu, header, footer, sidebar, notice, advert, form or comment, and what is
hidden, has no path. Some names are ordinary words ("discussion", "related"): in
an article, and on a page without one, an element that only they name goes if it
is short, mostly links or a run of replies, and stays if it is prose.

Character references are decoded, white space in a block (also from ``<br>``)
becomes one space, and blocks are joined by line feeds. Broken markup is read
the way browsers do it: unclosed paragraphs end at the next block, stray end
tags are ignored, a ``<`` that opens no tag is text.

Null and empty pages have an empty text. One narrow pass; repeated rows are
read one by one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements by their role in a page.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr "
    "ul".split()
)
BESIDE = frozenset("nav header footer aside form search menu dialog fieldset".split())
DROPPED = BESIDE | frozenset(
    "button select textarea noscript template iframe object svg math canvas audio video head".split()
)
#: Those that may stand around a whole page.
AROUND = frozenset(("form", "fieldset"))
CONTAINERS = ("article", "main")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TEXT = HEADINGS | frozenset(
    "address blockquote dd dl dt figcaption figure li ol p pre table tbody td tfoot th thead tr ul".split()
)
# Words of a class or id that name something beside the text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended comment comments "
    "commentlist disqus reply replies respond discussion sidebar side aside widget widgets menu nav "
    "navbar topnav subnav sidenav navigation breadcrumb breadcrumbs pagination pager footer header "
    "masthead topbar toolbar login search copyright colophon disclaimer adsbygoogle".split()
)
#: Those of them that are ordinary words and may name a part of the text.
DOUBTFUL = frozenset(
    "sponsor sponsored promotion banner consent notice notices alert share sharing social related "
    "recommended reply replies respond discussion side aside widget widgets menu navigation login "
    "signup subscription search copyright disclaimer".split()
)
#: Those that no content makes a part of the text.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle comment comments "
    "commentlist disqus nav navbar topnav subnav sidenav navigation breadcrumb breadcrumbs "
    "pagination pager gdpr".split()
)
#: Words with which a class says what the page has and not what the element is.
HAVING = frozenset("no has have with without not hide show".split())
REPLIES = frozenset("reply replies respond response responses message post thread".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar".split()
)
# An open element that a start tag of one of the others ends.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option", "optgroup"]),
    "p": BLOCK,
    "nav": frozenset(CONTAINERS),
}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Share of the best container's score that content reaches.
THRESHOLD = 0.5
#: Share of the score that an element holds if the content lies in it, and share
#: of the best part's score below which a part beside others is left out.
MOST = 0.7
WEAK = 0.1
#: Characters without links below which a text is a label and no prose.
SHORT = 60
#: Characters and marks of a part that is prose whatever its name says.
LONG, MARKS = 300, 3
#: How much more an article counts than text outside of one.
ARTICLE_WEIGHT = 50.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
CONTAINER = re.compile(r"<(?:article|main)\b", re.I)
ATTRIBUTE = re.compile(
    r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?", re.S
)


class Block:
    """A run of text inside one element."""

    __slots__ = ("node", "path", "container", "text", "own", "marks", "heading")

    def __init__(self, node, path, container, text, links, heading):
        self.node, self.path, self.container, self.text = node, path, container, text
        self.own = max(0, len(text) - links)
        self.marks = len(PUNCTUATION.findall(text))
        self.heading = heading


class Tree:
    """The block elements of a page by number, parents before children; 0 is the page.

    Paths are numbered as well, by the path of the parent and the name, so that
    nothing here grows with the depth of a page.
    """

    def __init__(self):
        self.parent, self.tag, self.name, self.path = [0], [""], [""], [0]
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, parent: int, tag: str, name: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.name.append(name)
        self.path.append(self._paths.setdefault((self.path[parent], name), len(self._paths) + 1))
        return len(self.parent) - 1

    def sums(self, own: dict[int, float]) -> list[float]:
        """Per element the sum over all inside of it."""
        total = [0.0] * len(self.parent)
        for node, value in own.items():
            total[node] += value
        for node in range(len(total) - 1, 0, -1):
            total[self.parent[node]] += total[node]
        return total


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(raw)}


def _words(named: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())


def _aside(tag: str, raw: str) -> tuple[bool, frozenset[str], str]:
    """Whether the element stands beside the text whatever its content, the words of
    its names that say so, and its name in a path."""
    if tag in DROPPED and tag not in BESIDE:
        return True, frozenset(), tag
    if not raw or raw.isspace():
        return False, frozenset(), tag
    given = _attributes(raw)
    if "hidden" in given or given.get("aria-hidden") == "true":
        return True, frozenset(), tag
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return True, frozenset(), tag
    if given.get("role", "").lower() in ASIDE_ROLES:
        return True, frozenset(), tag
    if tag in BESIDE:
        return False, frozenset(), tag
    named = f"{given.get('class', '')} {given.get('id', '')}".split()
    if tag == "article":  # "comments-open" is no comment
        words = [w.lower() for w in named]
    else:
        words = [w for one in named for w in _naming(one)]
    plain = tag in HEADINGS or tag in ("html", "body", "main")
    name = f"{tag}.{'.'.join(given.get('class', '').split())}" if given.get("class") else tag
    found = frozenset() if plain else ASIDE_WORDS.intersection(words)
    return False, found, tag if found and not found <= DOUBTFUL else name


def _naming(one: str) -> list[str]:
    """The words of a class or id that name the element."""
    words = _words(one)
    return [] if HAVING.intersection(words) else words


class _Reader:
    """Reads a page into blocks with a stack of open elements."""

    def __init__(self, contained: bool = True):
        #: Whether the page has an article or main.
        self.contained = contained
        self.tree = Tree()
        #: Elements that stand beside the text unless their content says otherwise,
        #: with the words that name them; doubtful elements of the text.
        self.marked: dict[int, frozenset[str]] = {}
        self.doubts: dict[int, bool] = {}
        #: Open doubtful spans with the text before them.
        self.spans: list[tuple[int, int, int]] = []
        # number, whether nothing in it is text
        self.stack: list[tuple[int, bool]] = []
        self.open: dict[str, int] = {}
        self.blind = 0  # open elements without text
        self.beside = 0  # open marked elements
        self.fixed = 0  # those of them that hold no article
        self.articles = 0
        self.container = self.container_depth = 0
        self.parts: list[str] = []
        self.links = 0
        self.in_link = False
        self.blocks: list[Block] = []

    def _settle(self) -> None:
        """Ends a doubtful span: a label or a link goes, prose stays."""
        _, at, links = self.spans.pop()
        text = " ".join("".join(self.parts[at:]).split())
        own = len(text) - (self.links - links)
        if own < SHORT or 2 * own < len(text):
            del self.parts[at:]
            self.links = links

    def flush(self) -> None:
        while self.spans:
            self._settle()
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                node = self.stack[-1][0] if self.stack else 0
                heading = self.tree.tag[node] in HEADINGS
                self.blocks.append(Block(node, self.tree.path[node], self.container, text, self.links, heading))
            self.parts = []
        self.links, self.in_link = 0, False

    def text(self, raw: str) -> None:
        if not self.blind:
            plain = html.unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.in_link:
                self.links += len(plain)

    def _push(self, tag: str, name: str, blind: bool) -> int:
        if tag in CONTAINERS and not blind and not self.blind and self.beside and not self.articles and not self.fixed:
            # A wrapper such as "page with sidebar" that holds the article is none.
            for number, _ in self.stack:
                self.marked.pop(number, None)
            self.beside = 0
        number = self.tree.add(self.stack[-1][0] if self.stack else 0, tag, name)
        self.stack.append((number, blind))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.blind += blind
        if tag in CONTAINERS and not self.blind and not self.beside and not self.container:
            self.articles += 1
            self.container, self.container_depth = self.articles, len(self.stack)
        return number

    def _pop(self) -> None:
        number, blind = self.stack.pop()
        tag = self.tree.tag[number]
        self.open[tag] -= 1
        self.blind -= blind
        if number in self.marked:
            self.beside -= 1
            self.fixed -= tag not in ("div", "section", "form")
        if self.spans and self.spans[-1][0] == number:
            self._settle()
        if len(self.stack) < self.container_depth:
            self.container = self.container_depth = 0

    def start(self, tag: str, raw: str) -> None:
        if tag == "br" or tag == "hr":
            self.text(" ")
            return
        if tag in VOID:
            return
        blind, found, name = _aside(tag, raw)
        # A doubtful name outside of the article is that of no text.
        inside = self.container or not self.contained or (tag == "article" and not self.articles)
        doubt = bool(found) and bool(inside) and (found <= DOUBTFUL or (bool(self.container) and not found & ALWAYS))
        mark = not blind and not doubt and (bool(found) or tag in BESIDE)
        if tag in BLOCK or tag in BESIDE:
            self.flush()
            while self.stack:
                top = self.tree.tag[self.stack[-1][0]]
                if tag in ENDED_BY.get(top, ()) or (top not in BLOCK and top not in DROPPED):
                    self._pop()
                elif tag in CONTAINERS and self.open.get("nav"):
                    self._pop()
                else:
                    break
            number = self._push(tag, name, blind)
            if doubt:
                self.doubts[number] = found <= DOUBTFUL
            elif mark:
                self.marked[number] = found
                self.beside += 1
                self.fixed += tag not in ("div", "section", "form")
        elif blind or mark or doubt:
            if not raw.rstrip().endswith("/"):
                number = self._push(tag, name, blind or mark)
                if doubt:
                    self.spans.append((number, len(self.parts), self.links))
                    self.in_link = self.in_link or tag == "a"
        elif tag == "a":
            self.in_link = True

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag == "br":
            self.text(" ")
        if not self.open.get(tag):
            return
        at = len(self.stack) - 1
        while at >= 0 and (top := self.tree.tag[self.stack[at][0]]) != tag:
            # An inline or paragraph end does not reach out of its container.
            if (tag not in BLOCK or tag == "p") and top in BLOCK and tag not in DROPPED:
                return
            at -= 1
        if at < 0:
            return
        if tag in BLOCK or tag in BESIDE:
            self.flush()
        while len(self.stack) > at:
            self._pop()


def read_blocks(page: str) -> tuple[Tree, list[Block]]:
    """The elements of a page, and the blocks of text that stand beside none of it."""
    reader, at = _Reader(CONTAINER.search(page) is not None), 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            reader.text(page[at : token.start()])
        at = token.end()
        if tag := token["tag"]:
            if token["end"]:
                reader.end(tag.lower())
            else:
                reader.start(tag.lower(), token["attrs"])
    if at < len(page):
        reader.text(page[at:])
    reader.flush()
    facts = _Facts(reader.tree, reader.blocks)
    gone = _beside_text(reader, facts) if reader.marked else set()
    if reader.doubts:
        gone |= _judged(reader, gone)
    blocks = _outside(reader.tree, reader.blocks, gone, reader) if gone else reader.blocks
    return reader.tree, blocks


def _outside(tree: Tree, blocks: list[Block], gone: set[int], reader: _Reader | None = None) -> list[Block]:
    """The blocks in none of the elements; headings of a header in the article stay."""
    near = [0] * len(tree.parent)  # the outermost of the elements around each
    for node in range(1, len(near)):
        near[node] = near[tree.parent[node]] or (node if node in gone else 0)

    def stays(block: Block) -> bool:
        around = near[block.node]
        titled = reader is not None and block.heading and block.container and tree.tag[around] == "header"
        return not around or bool(titled)

    return [b for b in blocks if stays(b)]


class _Facts:
    """Sums over the blocks inside each element, and the best thread there: the most
    text in repeats like comments, which are nested articles, elements named as
    replies, or named elements without heading that begin with a short line such as
    a name and a date."""

    def __init__(self, tree: Tree, blocks: list[Block]):
        size = len(tree.parent)
        self.tree = tree
        self.count, self.own, self.length, self.prose, self.marks = ([0] * size for _ in range(5))
        self.headed, self.first = [False] * size, [None] * size
        self.children: list[list[int]] = [[] for _ in range(size)]
        self.thread = [0] * size
        for node in range(1, size):
            self.children[tree.parent[node]].append(node)
        for block in reversed(blocks):
            node = block.node
            self.count[node] += 1
            self.own[node] += block.own
            self.length[node] += len(block.text)
            self.marks[node] += block.marks
            self.prose[node] += block.own if block.own >= SHORT and block.marks else 0
            self.headed[node] |= bool(block.own) and block.heading
            self.first[node] = block
        order = {id(b): i for i, b in enumerate(blocks)}
        self.place = lambda b: order[id(b)]

    def gather(self, node: int) -> None:
        """Add up an element whose children have been added up."""
        kinds: dict[str, list[int]] = {}
        for child in self.children[node]:
            if not self.count[child]:
                continue
            for sums in (self.count, self.own, self.length, self.prose, self.marks):
                sums[node] += sums[child]
            self.headed[node] |= self.headed[child]
            if self.first[node] is None or self.place(self.first[child]) < self.place(self.first[node]):
                self.first[node] = self.first[child]
            self.thread[node] = max(self.thread[node], self.thread[child])
            if self.tree.tag[child] in ("article", "div", "li", "section"):
                kinds.setdefault(self.tree.name[child], []).append(child)
        for name, each in kinds.items():
            if len(each) < 2:
                continue
            tag, _, classes = name.partition(".")
            signed = classes and all(
                self.count[e] > 1 and len(self.first[e].text) < SHORT
                and not PUNCTUATION.match(self.first[e].text[-1]) and not self.headed[e]
                for e in each
            )
            if tag == "article" or signed or not REPLIES.isdisjoint(_words(classes)):
                self.thread[node] = max(self.thread[node], sum(self.own[e] for e in each))

    def forget(self, node: int) -> None:
        for sums in (self.count, self.own, self.length, self.prose, self.marks, self.thread):
            sums[node] = 0
        self.headed[node], self.first[node] = False, None


def _beside_text(reader: _Reader, facts: _Facts) -> set[int]:
    """The marked elements that are beside the text. One that holds most of the prose
    of the page, and no run of replies, is the page."""
    tree = facts.tree
    for node in range(len(tree.parent) - 1, -1, -1):
        facts.gather(node)
    gone = set()
    for node, found in reader.marked.items():
        wraps = (
            (tree.tag[node] in AROUND or found) and not found & ALWAYS and facts.count[node] > 1
            and facts.prose[node] >= max(LONG, MOST * facts.prose[0])
            and 2 * facts.thread[node] < facts.own[node]
        )
        if not wraps:
            gone.add(node)
    return gone


def _judged(reader: _Reader, gone: set[int]) -> set[int]:
    """The doubtful elements that are no prose, inner ones first."""
    tree, doubts = reader.tree, reader.doubts
    facts = _Facts(tree, _outside(tree, reader.blocks, gone, reader))
    alike: dict[tuple, int] = {}  # doubtful elements of one name under one parent
    some = tree.sums({n: c for n, c in enumerate(facts.count) if c})
    for node in doubts:
        if some[node]:
            key = tree.parent[node], tree.name[node]
            alike[key] = alike.get(key, 0) + 1
    out = set()
    for node in range(len(tree.parent) - 1, -1, -1):
        facts.gather(node)
        if node not in doubts or not facts.count[node]:
            continue
        own = facts.own[node]
        replies = alike[tree.parent[node], tree.name[node]] > 1 and not REPLIES.isdisjoint(_words(tree.name[node]))
        # A name that is no ordinary word asks for more of the content.
        short = own < SHORT if doubts[node] else own < LONG or facts.marks[node] < MARKS
        if replies or short or 2 * own < facts.length[node] or 0 < facts.thread[node] * 2 >= own:
            out.add(node)
            facts.forget(node)
    return out


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weights 1, 2, 1 over neighbours; the ends repeat."""
    wide = np.concatenate([values[:1], values, values[-1:]])
    return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4


def path_scores(blocks: list[Block]) -> dict[tuple, float]:
    """Fused ratio of each (container, path): text length by punctuation, smoothed."""
    keys: dict[tuple, list[int]] = {}
    for block in blocks:
        sums = keys.setdefault((block.container, block.path), [0, 0, 0])
        sums[0] += 1
        sums[1] += block.own
        sums[2] += block.marks
    nodes, own, marks = np.array(list(keys.values()), float).T
    length, points = _smooth(own / nodes), _smooth(marks / nodes)
    fused = length * np.sqrt(1.0 + points) * nodes
    return dict(zip(keys, fused.tolist()))


def select(tree: Tree, blocks: list[Block], threshold: float = THRESHOLD) -> list[Block]:
    """The blocks of the containers whose paths score near the best."""
    if not blocks:
        return []
    scores = path_scores(blocks)
    if not any(b.container for b in blocks):
        return _densest(tree, blocks, scores)
    total: dict[tuple, float] = {}
    for (container, _), score in scores.items():
        weight = ARTICLE_WEIGHT if container else 1.0
        total[container] = total.get(container, 0.0) + score * weight
    bar = threshold * max(total.values())
    return [b for b in blocks if total[b.container] >= bar]


class _Part:
    """An element inside another, or the texts of one path in it."""

    __slots__ = ("node", "blocks", "weight", "plain", "own", "last")

    def __init__(self, node=None):
        self.node, self.blocks = node, []
        self.weight = self.plain = self.own = 0.0
        self.last = -1


def _strong(parts: list[_Part]) -> list[_Part]:
    """The parts that are not weak, by score or by length."""
    bar = WEAK * max(p.plain for p in parts)
    least = max(SHORT, WEAK * max(p.own for p in parts))
    return [p for p in parts if p.plain >= bar or p.own >= least]


def _densest(tree: Tree, blocks: list[Block], scores: dict[tuple, float]) -> list[Block]:
    """The blocks of the deepest element that holds most of the score, and what
    stands beside it or its parents and is not weak, with the headings before the
    last of them all, but for titles of link lists."""
    count: dict[tuple, int] = {}
    for block in blocks:
        key = (block.container, block.path)
        count[key] = count.get(key, 0) + 1
    size = len(tree.parent)
    # Sums over each element; its blocks are neighbours in page order.
    weight, plain, own = [0.0] * size, [0.0] * size, [0.0] * size
    first, last, texts = [len(blocks)] * size, [-1] * size, [[] for _ in range(size)]
    children: list[list[int]] = [[] for _ in range(size)]
    each = []
    for i, block in enumerate(blocks):
        key, node = (block.container, block.path), block.node
        # Smoothing lends weight to small neighbours; the plain score has none.
        each.append((scores[key] / count[key], block.own * (1 + block.marks) ** 0.5))
        weight[node] += each[i][0]
        plain[node] += each[i][1]
        own[node] += block.own
        first[node], last[node] = min(first[node], i), i
        texts[node].append(i)
    for node in range(size - 1, 0, -1):
        up = tree.parent[node]
        weight[up] += weight[node]
        plain[up] += plain[node]
        own[up] += own[node]
        first[up], last[up] = min(first[up], first[node]), max(last[up], last[node])
    for node in range(1, size):
        if last[node] >= 0:
            children[tree.parent[node]].append(node)

    def parts(node: int) -> list[_Part]:
        """What an element is made of, in page order."""
        lines: dict[int, _Part] = {}
        inside = list(texts[node])
        found: list[_Part] = []
        for child in children[node]:
            if tree.tag[child] in TEXT:
                inside.extend(range(first[child], last[child] + 1))
                continue
            part = _Part(child)
            part.weight, part.plain, part.own, part.last = weight[child], plain[child], own[child], last[child]
            found.append(part)
        for i in inside:
            part = lines.setdefault(blocks[i].path, _Part())
            part.blocks.append(i)
            part.weight += each[i][0]
            part.plain += each[i][1]
            part.own += blocks[i].own
            part.last = max(part.last, i)
        return found + list(lines.values())

    def held(part: _Part):
        return part.blocks if part.node is None else range(first[part.node], last[part.node] + 1)

    here, kept = 0, set()
    while True:
        found = parts(here)
        best = max(found, key=lambda p: p.weight)
        if best.node is None or best.weight < MOST * weight[here]:
            break
        strong = [p for p in _strong(found) if p.own and p is not best]
        end = max(p.last for p in [*strong, best])
        names = {id(p) for p in [*strong, best]}
        for part in strong:
            kept.update(held(part))
        for part in found:
            if id(part) in names:
                continue
            rest = [blocks[i] for i in held(part) if not blocks[i].heading]
            if 2 * sum(b.own for b in rest) >= sum(len(b.text) for b in rest):
                kept.update(i for i in held(part) if blocks[i].heading and i < end)
        here = best.node
    if here and tree.tag[here] not in ("html", "body"):
        kept.update(range(first[here], last[here] + 1))
    else:
        for part in _strong(found):
            kept.update(held(part))
        kept.update(i for i in range(first[here], last[here] + 1) if blocks[i].heading)
    return [b for i, b in enumerate(blocks) if i in kept]


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    return "\n".join(b.text for b in select(*read_blocks(page or ""), threshold))


def extract(pages: DataFrame, column: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Replace the page by its main ``text``; adds ``n_chars``.

    Other columns are carried along, but for these two names.
    """
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), threshold) for p in batch.column("__page")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*keep, F.col(column).alias("__page")).mapInArrow(run, schema)
