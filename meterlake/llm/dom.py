"""A small tree of a page's block elements, with what a classifier sees of each."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np

#: A tag, with quotes only where a value may begin. Nothing is tried twice, so that time is in proportion to the length.
TAG = re.compile(r"""<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
TOKEN = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\s\xa0]+")
SENTENCE = re.compile(r"[.!?;:,](?:\s|$)")

#: Fixed lists of element names, after the HTML standard.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title button label".split())
#: Of these the content is text to the first end tag; others hold elements, and may hold their like.
TEXT_ONLY = frozenset("script style textarea title iframe noscript".split())
EDGE_OF = {t: re.compile(rf"<(/?+){t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
#: What a head may hold; anything else ends it.
OF_HEAD = frozenset("head base link meta title style script noscript template bgsound basefont".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body tbody td tfoot th thead tr".split())
SCOPE = frozenset("article aside body div main section table td th li blockquote nav header footer form html dd fieldset".split())
#: Elements that end their like, and what bounds how far they look for it.
ALIKE = (
    (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dd", "dt"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    (frozenset({"td", "th"}), frozenset({"tr"})),
    (frozenset({"p"}), SCOPE),
)
LOOKS = {t: k for k, (names, _) in enumerate(ALIKE[:-1]) for t in names}
P = len(ALIKE) - 1
#: Words of class, id and role attributes, by what they tell.
TOKENS = {
    "body": "article content post entry main body story text page blog news single hentry prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc links skip toolbar",
    "edge": "header masthead footer foot head top bottom copyright colophon banner logo brand",
    "side": "sidebar side aside widget related recommended popular trending complementary recirc more secondary",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion promoted dfp outbrain taboola",
    "notice": "cookie consent gdpr notice popup modal overlay newsletter subscribe signup alert banner dialog paywall",
    "reader": "comment comments comm reply replies respond discussion disqus thread feedback reviews",
    "share": "share sharing social follow like tweet tags meta byline author rating tools actions buttons",
    "form": "form search login contact input field register",
}
GROUPS = list(TOKENS)
GROUP_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        GROUP_OF.setdefault(_w, []).append(_k)
KINDS = ["article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dd dt", "table tbody thead tfoot tr td th", "blockquote pre", "nav", "header hgroup", "footer", "aside", "form fieldset search", "figure figcaption", "body html"]
KIND_OF = {t: k for k, names in enumerate(KINDS) for t in names.split()}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[int, ...] = ()
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    marks: int = 0
    inline: int = 0


@dataclass
class Page:
    """Block elements in page order, and blocks of text as (node, text)."""

    nodes: list[Node]
    blocks: list[tuple[int, str]]


HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(raw: str) -> tuple[tuple[int, ...], bool]:
    groups, hidden = [0] * len(GROUPS), False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for w in TOKEN.findall(value):
                for k in GROUP_OF.get(w, ()):
                    groups[k] += 1
        elif name == "hidden" or name == "style" and HIDES.search(value) or name == "aria-hidden" and value == "true":
            hidden = True
    return tuple(groups), hidden


NONE = (0,) * len(GROUPS)


class Open:
    """An open block element: its node, links that are open in it, and where on the stack the nearest element
    of each row of ALIKE is that one like it would end (-1 for none)."""

    __slots__ = ("tag", "node", "anchors", "nearest")

    def __init__(self, tag: str, node: int, nearest: tuple[int, ...]):
        self.tag, self.node, self.anchors, self.nearest = tag, node, 0, nearest


def _nearest(tag: str, place: int, above: tuple[int, ...]) -> tuple[int, ...]:
    return tuple([place if tag in names else -1 if tag in stop else a for (names, stop), a in zip(ALIKE, above, strict=True)])


def _end_of(tag: str, source: str, at: int) -> int | None:
    """Where an element whose content is skipped ends, its like inside counted; None if it never does."""
    depth = 1
    for m in EDGE_OF[tag].finditer(source, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif tag not in TEXT_ONLY and not m[0].endswith("/>"):
            depth += 1
    return None


def parse(source: str) -> Page:
    """Elements that aren't closed end where a block that can't be inside them begins or their parent ends.
    Scripts, styles and other elements without text of the page are skipped with all they hold; so is a tag or
    comment that never ends. Time is in proportion to the length of the source, whatever it holds: only blocks
    are on the stack, each knows what it may end, and what isn't closed further on is searched once."""
    nodes, blocks = [Node("html", -1, 0, NONE)], []
    stack = [Open("html", 0, (-1,) * len(ALIKE))]
    opened: dict[str, int] = {"html": 1}
    never_closed: set[str] = set()
    text: list[str] = []
    anchors = 0
    in_head = False

    def flush() -> None:
        if text:
            own = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if own:
                node = stack[-1].node
                blocks.append((node, own))
                nodes[node].chars += len(own)
                nodes[node].marks += len(SENTENCE.findall(own))

    def pop(to: int) -> None:
        nonlocal anchors
        flush()
        for gone in stack[to:]:
            anchors -= gone.anchors
            opened[gone.tag] -= 1
        del stack[to:]

    def said(part: str) -> None:
        nonlocal in_head
        if in_head:
            if not part.strip():
                return
            in_head = False  # text ends a head, as in browsers
        text.append(part)
        if anchors and (n := len(part.strip())):
            nodes[stack[-1].node].link_chars += n

    at, end = 0, len(source)
    while at < end:
        start = source.find("<", at)
        if start < 0:
            said(source[at:])
            break
        if start > at:
            said(source[at:start])
        mark = source[start + 1 : start + 2]
        if mark in ("!", "?"):
            comment = source.startswith("<!--", start)
            stop = source.find("-->", start + 2) if comment else source.find(">", start)
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        after = source[start + 2 : start + 3]
        if mark == "/" and after and not (after.isascii() and after.isalpha()):
            stop = source.find(">", start)  # no end tag, so a comment
            at = end if stop < 0 else stop + 1
            continue
        if not (mark.isascii() and mark.isalpha() or mark == "/" and after):
            said("<")
            at = start + 1
            continue
        m = TAG.match(source, start)
        if not m:
            break
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "head" or in_head and tag not in OF_HEAD:
            in_head = tag == "head" and not closing and len(nodes) == 1
        if tag == "head":
            continue
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                close = None if tag in never_closed else _end_of(tag, source, at)
                if close is not None:
                    at = close
                else:
                    never_closed.add(tag)
                    if tag in ("script", "style", "textarea", "template", "noscript"):
                        at = end
            text.append(" ")
        elif tag in VOID:
            text.append(" ")
        elif tag not in BLOCK:
            own = stack[-1]
            if closing:
                if tag == "a" and own.anchors:
                    own.anchors -= 1
                    anchors -= 1
                continue
            nodes[own.node].inline += 1
            if tag == "a":
                nodes[own.node].links += 1
                own.anchors += 1
                anchors += 1
        elif closing:
            if opened.get(tag, 0) > (tag == "html"):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
        else:
            flush()
            if tag in CLOSES_P and stack[-1].nearest[P] >= 0:
                pop(stack[-1].nearest[P])
            if tag in LOOKS and stack[-1].nearest[LOOKS[tag]] >= 0:
                pop(stack[-1].nearest[LOOKS[tag]])
            if tag == "html":
                continue
            parent = stack[-1].node
            tokens, hidden = _attributes(m[3]) if m[3].strip() else (NONE, False)
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens, hidden))
            nodes[parent].children.append(len(nodes) - 1)
            stack.append(Open(tag, len(nodes) - 1, _nearest(tag, len(stack), stack[-1].nearest)))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return Page(nodes, blocks)


FEATURES = 28 + 3 * len(GROUPS) + len(KINDS)


def features(page: Page) -> np.ndarray:
    """One row for each node: of the element, of all below it, of its ancestors and of its siblings."""
    nodes = page.nodes
    n = len(nodes)
    chars, links, linked, marks, tags, paras = ([0] * n for _ in range(6))
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        chars[k] += node.chars
        links[k] += node.links
        linked[k] += node.link_chars
        marks[k] += node.marks
        tags[k] += 1 + node.inline
        paras[k] += node.tag == "p" and node.chars > 60
        if node.parent >= 0:
            p = node.parent
            for column in (chars, links, linked, marks, tags, paras):
                column[p] += column[k]
    total = max(chars[0], 1)
    before, so_far = [0] * n, 0
    for k, node in enumerate(nodes):
        before[k] = so_far
        so_far += node.chars
    above: list[tuple[int, ...]] = [NONE] * n
    inside: list[list[int]] = [[0] * len(KINDS)] * n
    rows = np.zeros((n, FEATURES), np.float32)
    for k, node in enumerate(nodes):
        if node.parent >= 0:
            p = node.parent
            above[k] = tuple(map(max, above[p], nodes[p].tokens)) if any(nodes[p].tokens) else above[p]
            kind = KIND_OF.get(nodes[p].tag, -1)
            if (kind >= 11 or 0 <= kind < 3) and not inside[p][kind]:
                inside[k] = [*inside[p][:kind], 1, *inside[p][kind + 1 :]]
            else:
                inside[k] = inside[p]
        siblings = nodes[node.parent].children if node.parent >= 0 else [0]
        around = chars[node.parent] - chars[k] if node.parent >= 0 else 0
        c, t = chars[k], tags[k]
        parent_tokens = nodes[node.parent].tokens if node.parent >= 0 else NONE
        rows[k] = [
            node.depth,
            math.log1p(c),
            c / total,
            c / t,
            linked[k] / (c + 1),
            links[k] / t,
            marks[k] / (c + 1) * 100,
            math.log1p(paras[k]),
            math.log1p(t),
            math.log1p(node.chars),
            node.chars / (c + 1),
            before[k] / total,
            (before[k] + c) / total,
            len(node.children),
            len(siblings),
            around / (len(siblings) - 1) / total if len(siblings) > 1 else 0,
            c / (around + c + 1),
            chars[node.parent] / total if node.parent >= 0 else 1,
            paras[node.parent] if node.parent >= 0 else 0,
            linked[node.parent] / (chars[node.parent] + 1) if node.parent >= 0 else 0,
            node.hidden,
            inside[k][11] + inside[k][14],
            inside[k][12] + inside[k][13],
            inside[k][15],
            inside[k][0],
            inside[k][1],
            inside[k][2],
            KIND_OF.get(nodes[node.parent].tag, -1) in (0, 1) if node.parent >= 0 else 0,
            *node.tokens,
            *parent_tokens,
            *above[k],
            *(x == KIND_OF.get(node.tag, -1) for x in range(len(KINDS))),
        ]
    return rows


#: A page with so many characters of prose outside of links has a main text.
LEAST_PROSE = 80


def decode(page: Page, log_odds: np.ndarray, price: float = 0.25) -> list[str]:
    """The blocks of the best consistent choice: a subtree is kept whole, dropped whole, or, at a price,
    split into its own text and its children's choices. So nothing is kept below what is dropped whole.

    A page with prose has a main text: if the best choice keeps no block of it, the subtree is kept
    for which this costs least."""
    nodes = page.nodes
    yes = -np.logaddexp(0, -log_odds)
    no = -np.logaddexp(0, log_odds)
    keep, drop = yes.tolist(), no.tolist()
    split, best = [0.0] * len(nodes), [0.0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        own = max(float(yes[k]), float(no[k]))
        children = nodes[k].children
        keep[k] += sum(keep[c] for c in children)
        drop[k] += sum(drop[c] for c in children)
        split[k] = own - price + sum(best[c] for c in children) if children else -math.inf
        best[k] = max(keep[k], drop[k], split[k])
    choice = [0] * len(nodes)
    for k, node in enumerate(nodes):
        up = choice[node.parent] if node.parent >= 0 else 2
        if up != 2:
            choice[k] = up
        elif best[k] == split[k]:
            choice[k] = 2
        else:
            choice[k] = int(keep[k] >= drop[k])
    kept = [choice[node] == 1 or choice[node] == 2 and log_odds[node] > 0 for node, _ in page.blocks]
    prose = [len(SENTENCE.findall(text)) > 0 and len(text) >= LEAST_PROSE // 2 for _, text in page.blocks]
    plain = sum(nodes[k].chars - nodes[k].link_chars for k in {node for (node, _), p in zip(page.blocks, prose) if p})
    if plain >= LEAST_PROSE and not any(k and p for k, p in zip(kept, prose)):
        inside = {node for (node, _), p in zip(page.blocks, prose) if p}
        for k in range(len(nodes) - 1, 0, -1):
            if k in inside:
                inside.add(nodes[k].parent)
        chosen = max(inside, key=lambda k: (keep[k] - drop[k], k))
        below = {chosen}
        for k in range(chosen + 1, len(nodes)):
            if nodes[k].parent in below:
                below.add(k)
        kept = [k or node in below for k, (node, _) in zip(kept, page.blocks)]
    return [text for k, (_, text) in zip(kept, page.blocks) if k]
