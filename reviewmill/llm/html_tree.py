"""A forgiving reader of one HTML page: its text blocks and the subtrees they lie in."""

from __future__ import annotations

import re
from html import unescape

import xxhash

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Start and end of these separate blocks; all other elements are inline.
BLOCK = set(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "col", "colgroup", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "button", "select"}
#: An element ends an open one of these, unless one of the limits lies between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr"}, {"table"}),
}
#: Never part of an article.
DROPPED = set(
    "head script style noscript template iframe object embed svg canvas nav footer aside form button select "
    "input textarea label fieldset menu dialog title audio video map".split()
)
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of a class or id that mark what surrounds an article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored promo promotion promoted "
    "banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup sidebar sidebars sidenav rail widget widgets related recommended recommendations share "
    "sharing social breadcrumb breadcrumbs menu menus nav "
    "navbar navigation topnav topbar footer copyright pagination pager toolbar login search skip "
    "teaser teasers paywall disclaimer".split()
)
#: Words that mark reader comments, which may well be longer than the article.
COMMENTS = set("comment comments commentlist disqus respond replies reply".split())
#: With one of these a class name speaks of the layout of the whole, as in ``with-sidebar``.
LAYOUT = set("has with no without open closed enabled disabled".split())
#: An element marked by ``MARKS`` alone that holds this share of the page's text is a frame around it.
FRAME_SHARE = 0.8
#: Elements that hold an article.
ARTICLES = {"article"}
#: These hold an article's title when inside it and the site's otherwise.
HEADS = {"header", "masthead"}
#: Inside an article only such a subtree can be a template; its paragraphs always stay.
BOXES = set("div section ul ol dl table figure details header center address".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "dropped", "marked", "head", "main", "holds_main", "children", "hash", "size")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, marked: bool, head: bool, main: bool):
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped, marked
        self.head, self.main, self.holds_main, self.children = head, main, False, []
        self.hash = self.size = 0


def _marked(attrs: str) -> tuple[bool, bool, bool, bool]:
    """(never shown or comments, marked as surroundings, as a head, as main) by its attributes."""
    if not attrs.strip():
        return False, False, False, False
    values = {}
    for name, value in _ATTR.findall(attrs):
        values.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    role = values.get("role", "").strip().lower()
    if role == "main":
        return False, False, False, True
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or role in ROLES:
        return True, False, False, False
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return True, False, False, False
    words: set[str] = set()
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        parts = _WORDS.findall(_CAMEL.sub(" ", name).lower())
        if LAYOUT.isdisjoint(parts):
            words.update(parts)
    return not COMMENTS.isdisjoint(words), not MARKS.isdisjoint(words), not HEADS.isdisjoint(words), False


def read_tree(html: str) -> tuple[Node, list[Node]]:
    """The root and all nodes; a node's children are nodes and texts in page order."""
    root = Node("", None, False, False, False, False)
    nodes, at, end = [], root, len(html)
    lower, pos, text_from = None, 0, 0

    while True:
        i = html.find("<", pos)
        if i < 0 or i + 1 >= end:
            at.children.append(html[text_from:])
            return root, nodes
        after = html[i + 1]
        if after in "!?":
            at.children.append(html[text_from:i])
            if html.startswith("<!--", i):
                j = html.find("-->", i + 2)
                pos = end if j < 0 else j + 3
            else:
                j = html.find(">", i)
                pos = end if j < 0 else j + 1
            text_from = pos
            continue
        m = _TAG.match(html, i) or _LOOSE.match(html, i)
        if not m:
            if after.isalpha() and after.isascii() or after == "/" and html[i + 2 : i + 3].isalpha():
                at.children.append(html[text_from:i])  # a tag that never ends swallows the rest
                return root, nodes
            pos = i + 1
            continue
        at.children.append(html[text_from:i])
        pos = text_from = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if closing:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        if tag in RAW:
            lower = lower or html.lower()
            if len(lower) == end:
                j = lower.find(f"</{tag}", pos)
            else:  # lower-casing changed the length
                found = re.compile(f"</{tag}", re.I).search(html, pos)
                j = found.start() if found else -1
            pos = text_from = end if j < 0 else j
            continue
        if tag in CLOSES_P:
            node = at
            while node.parent is not None and node.tag not in ("p", "button", "td", "th", "table"):
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in SIBLINGS:
            ends, limits = SIBLINGS[tag]
            node, found = at, None
            while node.parent is not None and node.tag not in limits:
                if node.tag in ends:
                    found = node
                node = node.parent
            if found is not None:
                at = found.parent
        never, marked, head, is_main = _marked(attrs)
        whole = tag in ("html", "body", "main")  # a class of these speaks of the page's layout
        node = Node(tag, at, never and not whole or tag in DROPPED, marked and not whole,
                    head and not whole or tag == "header", is_main or tag == "main")
        nodes.append(node)
        at.children.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            at = node


def _from_below(root: Node) -> list[Node]:
    """All nodes, every one after the nodes inside it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    order.reverse()
    return order


def _hash(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def _subtree_hashes(order: list[Node]) -> None:
    """Hash of every node's tag, texts without their numbers, and subtrees."""
    for node in order:
        parts = [node.tag]
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"<{c.hash}>")
            elif c and not c.isspace():
                parts.append(_DIGITS.sub("0", " ".join(c.split())))
        node.hash = _hash(parts)


def _exact_hash(node: Node) -> int:
    """Hash of a subtree's texts, numbers included."""
    parts, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, Node):
            stack.extend(reversed(at.children))
        else:
            parts.extend(at.split())
    return _hash(parts)


def _sizes(order: list[Node]) -> None:
    """Characters of every node's text outside of what is dropped."""
    for node in order:
        node.size = 0 if node.dropped else sum(
            c.size if isinstance(c, Node) else len(c) - c.count(" ") for c in node.children)


def _settle(root: Node, nodes: list[Node], order: list[Node]) -> list[Node]:
    """Decide what is dropped; the outermost nodes that hold an article, if any."""
    _sizes(order)
    frame = FRAME_SHARE * root.size
    for n in nodes:  # a node comes after those around it
        n.dropped = n.dropped or n.parent.dropped or n.marked and n.size < frame
    _sizes(order)
    alive = [n for n in nodes if not n.dropped and n.size]
    mains = [n for n in alive if n.tag in ARTICLES] or [n for n in alive if n.main]
    known, outer = set(map(id, mains)), []
    for n in mains:
        up = n.parent
        while up is not None and id(up) not in known and not up.holds_main:
            up.holds_main = True
            up = up.parent
        while up is not None and id(up) not in known:
            up = up.parent
        if up is None:
            outer.append(n)
    return outer


def read_page(html: str) -> tuple[int, list[int], list[tuple[str, bool, list[int]]]]:
    """What the page is known by, its subtrees that could be a template, and its blocks in order.

    A page is known by its article where it has one that cannot be a template, else by all blocks.

    A block is its text, whether it lies in the marked article, and the hashes of the subtrees
    around it that could be a template. Neighbouring blocks alike in both are one. What is dropped
    in any case has a hash, but no block. Around an article, every element could be a template;
    inside, only a box; the article itself only beside at least as much other text. An article,
    and an element with ``FRAME_SHARE`` of the text, is recognised by its exact text.
    """
    root, nodes = read_tree(html)
    order = _from_below(root)
    _subtree_hashes(order)
    mains = _settle(root, nodes, order)
    chosen = set(map(id, mains))
    blocks: list[tuple[str, bool, tuple[int, ...]]] = []
    subtrees: set[int] = set()
    teasers: set[int] = set()
    run: list[str] = []

    def flush(inside: bool, path: tuple[int, ...]) -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            if blocks and blocks[-1][1:] == (inside, path):
                text = f"{blocks[-1][0]} {text}"
                blocks.pop()
            blocks.append((text, inside, path))

    # Depth first without recursion: [node, next child, in an article, path].
    stack = [[root, 0, False, ()]]
    while stack:
        frame = stack[-1]
        node, k, inside, path = frame
        if k == len(node.children):
            stack.pop()
            if node.tag in BLOCK:
                flush(inside, path)
            continue
        frame[1] += 1
        child = node.children[k]
        if not isinstance(child, Node):
            if child:
                run.append(child)
            continue
        opens = id(child) in chosen
        if child.tag in BLOCK:
            flush(inside, path)
        if child.dropped or child.head and not (inside or opens or child.holds_main):
            if child.tag in BLOCK and child.tag != "head":
                subtrees.add(child.hash)
            continue
        found = None
        if opens:
            if 2 * child.size <= root.size:
                found = _exact_hash(child)
                teasers.add(found)
        elif inside:
            if child.tag in BOXES:
                found = child.hash
        elif not child.holds_main and child.tag in BLOCK and child.tag not in ("html", "body"):
            found = child.hash if child.size < FRAME_SHARE * root.size else _exact_hash(child)
        deeper = path
        if found is not None and child.size:
            deeper = (*path, found)
            subtrees.add(found)
        stack.append([child, 0, inside or opens, deeper])
        if opens and child.tag not in BLOCK:
            flush(inside, path)
    flush(False, ())
    article = [text for text, inside, path in blocks if inside and teasers.isdisjoint(path)]
    known_by = _hash(article or [text for text, _, _ in blocks])
    return known_by, sorted(subtrees), [(text, inside, list(path)) for text, inside, path in blocks]
