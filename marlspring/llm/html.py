"""Operator 6: main text of HTML pages by wrappers inferred for each host.

A page is a stream of tokens; inline markup is transparent, so what remains are block elements and text
slots. A host's wrapper is a union-free regular expression over these: page after page is aligned with
it; runs of like siblings become repeated groups, elements that only one side has become optional
groups, texts become slots. All pages take part: a task folds its pages of a host into one wrapper,
and these are folded in two steps by host.

Groups of the wrapper get roles. Names and marks say what is the article and what is beside it; where
a page names no article, the wrapper decides: a group whose text, over all pages of the host, is mostly
linked is a menu, and a slot that holds the same text on more than half of a host's pages
(``CONSTANT_PAGES`` at least) is template, not content. Pages with one longest text count as one there, so copies
of an article don't make it a template. Every page that names no article is then matched with its host's wrapper: a group
that can be only one of the wrapper's is in a menu or not as that one is; groups that could be several are judged by their path, which
these share; what the wrapper has never seen (none, as all pages are in it) would be judged by the page alone.

Wrappers are a small table joined by host (Spark broadcasts it only if its written size allows, and
splits hot hosts otherwise). No task gathers a host's pages: what meets by host are at most as many
wrappers as there were tasks, dealt over ``SALTS`` first. Template texts of a host are no more than twice
the blocks of a page. All pages are extracted whole where they are read.

Defined results: null and empty html give an empty text; a page without article text gives an empty
text; unclosed and stray tags, quotes and comments are tolerated, in time linear in the page; elements
nested deeper than ``MAX_DEPTH`` stand beside each other at that depth, as in browsers, with all of their text; a null url belongs to the host
``''``; repeated rows give repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspring.llm.common import passing_tables, slices, written

#: Deepest nesting of elements, tasks that a host's wrappers are dealt to, and pages from which on a text may be template.
MAX_DEPTH, SALTS, CONSTANT_PAGES = 200, 32, 4
#: Siblings that are aligned in order (more are folded by their key), and shapes or paths that a task holds before it passes its wrappers on.
SIBLINGS, HELD = 64, 100_000
#: Share of linked text from which on a group is a menu.
LINKED = 0.6

#: Elements by their part in a page.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "canvas", "object", "select", "head", "title", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font hr i img input ins kbd label link mark meta q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr html body".split())
ARTICLE = ("article", "main")
ASIDE = frozenset("nav footer aside form button dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose id, within an article, is a slug and no mark.
SLUGGED = HEADINGS | {"section", "p"}
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ()}
#: Tokens of a class or role, and words of an id outside of articles, that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies "
    "consent notice notices alert newsletter subscribe subscription share sharing social comment comments reply replies disqus related recommended popup modal overlay login signup search toolbar pagination pager widget".split()
)

#: Words that make a mark tell of the page's layout, and marks of article elements that aren't the article.
LAYOUT = frozenset("has with no without layout".split())
TEASER = frozenset("comment comments reply replies ad ads advert sponsored related recommended promo".split())

#: Words that mark a compound token, and words that may stand beside them; any other word makes it a name of something else.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent newsletter subscribe share sharing social comment comments reply replies disqus related recommended sidebar popup modal breadcrumb breadcrumbs pagination".split()
)
BESIDE = MARKS | frozenset(
    "user users reader readers list lists section bar bars slot slots box boxes area block blocks unit units container wrapper wrap form thread threads link links button buttons icon icons post posts article articles site page top bottom left right message policy widgets item items panel inner outer content body text".split()
)

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r">|=\s*[\"']")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")
#: A group of a wrapper's expression opens, with what it holds itself, or ends.
_GROUP = re.compile(r"<([^/>][^>]*)>(-?#?)|(</>)(?:\)(\+?)(\??))?")


def _compound(name: str, words: list[str]) -> set[str]:
    """The marks in a token of several words (``user-comments``, ``ad-slot``), if all its words speak of such a part; an article's own tokens have none."""
    found = set(words)
    return found & STRONG if name not in ARTICLE and found <= BESIDE else set()


def _key(name: str, attributes: str) -> str:
    """An element's name with the words of its marks: ``div.ad``.

    A whole token of class or role is the word itself, a part of one ``~word``; an id gives ``##id`` if it is one word, else ``#word``.
    Of compound tokens that name a part of the page, such as ``cookie-bar``, the strong words count as whole ones.
    """
    marks: set[str] = set()
    for attribute, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        attribute, value = attribute.lower(), (a or b or c).lower()
        if attribute in ("class", "role"):
            for token in value.split():
                words = _WORD.findall(token)
                marks |= {token} if words == [token] else {"~" + w for w in words} | _compound(name, words)
        elif attribute == "id":
            words = _WORD.findall(value)
            marks |= {"##" + value} if words == [value.strip()] else {"#" + w for w in words} | {"##" + w for w in _compound(name, words)}
        elif attribute == "hidden" and not value.startswith("until"):
            marks.add("advert")
    return ".".join([name, *sorted(marks)])


def _unmarked(key: str) -> str:
    """The key of an element whose marks say nothing of what it holds."""
    name, *marks = key.split(".")
    return ".".join([name, *sorted({"~" + m.lstrip("~#") for m in marks})])


def _marked(key: str) -> bool:
    """Whether a whole token of class or role is a mark."""
    return not MARKS.isdisjoint(key.split(".")[1:])


class Element:
    """A block element of a page: its key (which may lose its marks when an article opens below) and its parent."""

    __slots__ = ("key", "name", "parent")

    def __init__(self, key: str, name: str, parent: Element | None):
        self.key, self.name, self.parent = key, name, parent


class _Tags:
    """Finds tags; linear in the page, whatever is left open."""

    def __init__(self, html: str):
        self.html, self.broken, self.last = html, False, html.rfind(">")

    def end(self, at: int) -> int:
        """Behind the > that ends the tag at a place, or -1; a > within a quoted value ends none if the value is closed."""
        if at > self.last:
            return -1
        k = at
        while not self.broken:
            m = _STOP.search(self.html, k)
            if m is None:
                self.broken = True  # what follows is cut at the next > from now on
            elif m[0] == ">":
                return m.end()
            else:
                close = self.html.find(m[0][-1], m.end())
                k = m.end() if close < 0 else close + 1
        return self.html.find(">", at) + 1


def blocks(html: str) -> list[tuple[Element | None, str, int]]:
    """(innermost block element, text, characters in links) of each block of a page with text, in order."""
    out: list[tuple[Element | None, str, int]] = []
    stack: list[Element] = []
    held: dict[str, list[int]] = {}  # places in the stack by name
    framed: list[list[Element]] = []  # what stands around each article or main
    text: list[str] = []
    linked = inside = at = 0
    tags, endless = _Tags(html), set()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((stack[-1] if stack else None, whole, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) * (inside > 0)

    def cut(k: int) -> None:
        while len(stack) > k:
            held[stack.pop().name].pop()

    def highest(*names: str) -> int:
        return max((held[n][-1] for n in names if held.get(n)), default=-1)

    end = len(html)
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            add(html[at:])
            break
        m = _NAME.match(html, begin + 2 if html.startswith("/", begin + 1) else begin + 1)
        mark = html[begin + 1 : begin + 2]
        if html.startswith("<!--", begin):
            stop = html.find("-->", begin + 4)
            stop = end if stop < 0 else stop + 3
        elif mark in ("!", "?"):
            stop = html.find(">", begin) + 1
        else:
            stop = tags.end(m.end()) if m else 0
        if stop <= 0:  # no tag
            add(html[at : begin + 1])
            at = begin + 1
            continue
        add(html[at:begin])
        at = stop
        if mark in ("!", "?"):
            continue
        closing, name, attributes = mark == "/", m[0].lower(), html[m.end() : stop - 1]
        if name in _RAW_END and not closing:
            if name != "title" and attributes.rstrip().endswith("/"):
                continue
            tail = None if name in endless else _RAW_END[name].search(html, at)
            if tail:
                at = tail.end()
            else:
                endless.add(name)
                if name != "head":  # an unclosed raw element takes the rest
                    at = end
            continue
        if name == "a":
            inside = 0 if closing else 1
        if name == "br":
            text.append(" ")
        if name in INLINE or name in VOID or name in _RAW_END:
            continue
        flush()
        if closing:
            if held.get(name):
                cut(held[name][-1])
            continue
        if stack and stack[-1].name == "p":  # a block element ends an open paragraph
            cut(len(stack) - 1)
        if name in SAME_ENDS:
            mates = ("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,)
            mate = highest(*mates)
            if mate > highest(*SAME_ENDS[name]):
                cut(mate)
        if len(stack) >= MAX_DEPTH:
            cut(MAX_DEPTH - 1)
        if name in ARTICLE and not any(held.get(n) for n in ARTICLE):
            framed.append(list(stack))
        held.setdefault(name, []).append(len(stack))
        stack.append(Element(_key(name, attributes), name, stack[-1] if stack else None))
    flush()
    # Frames around an article have no marks; only beside an article without marked frames do others' frames keep theirs.
    bare = [not any(_marked(e.key) for e in frame) for frame in framed]
    for frame in [f for f, free in zip(framed, bare) if free or not any(bare)]:
        for e in frame:
            e.key = _unmarked(e.key)
    return out


def _under(role: str, key: str) -> str:
    """The role of an element within one of a role: open, main, header (in an article), aside."""
    if role == "aside":
        return role
    name, *marks = key.split(".")
    found = MARKS & set(marks)
    if role == "open" and name not in ARTICLE:
        found |= MARKS & {m.lstrip("#") for m in marks if m[0] == "#"}
    elif name not in SLUGGED and name not in ARTICLE and "section" not in marks:  # ids of sections are slugs of their titles
        found |= MARKS & {m[2:] for m in marks if m[:2] == "##"}
    if "sidebar" in found and LAYOUT & {m.lstrip("~#") for m in marks}:  # a frame around the article that tells of its layout
        found = found - {"sidebar"}
    if role in ("main", "header") and found == {"header"} and name not in ASIDE:
        return "main" if name in HEADINGS else "header"
    if name in ASIDE or (found and (name not in ARTICLE or role != "open" or TEASER & found)):
        return "aside"
    if name == "header":
        return "header" if role == "main" else "aside"
    if role == "header":
        return "main" if name in HEADINGS else "header"
    return "main" if name in ARTICLE or not {"articlebody", "#articlebody", "##articlebody"}.isdisjoint(marks) else role


class Places:
    """Paths of elements as numbers, with the role that names and marks along each give."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.keys, self.roles = [-1], [""], ["open"]

    def of(self, element: Element | None, known: dict[Element, int]) -> int:
        chain = []
        while element is not None and element not in known:
            chain.append(element)
            element = element.parent
        at = known[element] if element is not None else 0
        for e in reversed(chain):
            if (at, e.key) not in self.number:
                self.number[at, e.key] = len(self.keys)
                self.parent.append(at)
                self.keys.append(e.key)
                self.roles.append(_under(self.roles[at], e.key))
            known[e] = at = self.number[at, e.key]
        return at

    def role(self, at: int) -> str:
        return "aside" if self.roles[at] == "header" else self.roles[at]

    def path(self, at: int) -> str:
        keys = []
        while at:
            keys.append(self.keys[at])
            at = self.parent[at]
        return "/".join(reversed(keys))


class Group:
    """A node of a wrapper: an element, whether optional or repeated or a slot of text, its groups in order, and the characters of its own texts, all and linked."""

    __slots__ = ("chars", "groups", "into", "key", "linked", "menu", "optional", "repeated", "slot")

    def __init__(self, key: str, optional: bool = False, repeated: bool = False, slot: bool = False, groups: list[Group] | None = None, chars: int = 0, linked: int = 0):
        self.key, self.optional, self.repeated, self.slot, self.groups = key, optional, repeated, slot, groups or []
        self.chars, self.linked, self.menu = chars, linked, False
        self.into: Group | None = None

    def now(self) -> Group:
        """The group that this one has become part of."""
        g = self
        while g.into is not None:
            g = g.into
        if g is not self:
            self.into = g
        return g

    def add(self, other: Group) -> None:
        """Aligns another occurrence of the element with this one."""
        other.into = self
        self.chars += other.chars
        self.linked += other.linked
        self.slot |= other.slot
        self.repeated |= other.repeated
        self.optional |= other.optional
        mine, theirs = self.groups, other.groups
        if mine or theirs:
            merged: list[Group] = []
            for how, a, b, c, d in SequenceMatcher(None, [g.key for g in mine], [g.key for g in theirs], autojunk=False).get_opcodes():
                if how == "equal":
                    for g, h in zip(mine[a:b], theirs[c:d]):
                        g.add(h)
                        merged.append(g)
                else:
                    for g in [*mine[a:b], *theirs[c:d]]:
                        g.optional = True
                        merged.append(g)
            self.groups = fold(merged)

    def folded(self) -> None:
        for g in self.groups:
            g.folded()
        self.groups = fold(self.groups)

    def weigh(self, role: str = "open") -> tuple[int, int]:
        """Marks groups that, with what is below them, are mostly linked as menus, where nothing names the article; gives their characters, all and linked."""
        if role != "open":
            return 0, 0
        below = [g.weigh(_under(role, g.key)) for g in self.groups]
        chars, linked = self.chars + sum(c for c, _ in below), self.linked + sum(n for _, n in below)
        self.menu = linked > LINKED * chars
        return chars, linked

    def expression(self) -> str:
        """The group as a regular expression: ``#`` is a slot of text, ``-`` stands in a menu."""
        inner = ("-" if self.menu else "") + ("#" if self.slot else "") + "".join(g.expression() for g in self.groups)
        whole = f"<{self.key}>{inner}</>"
        return f"({whole}){'+' if self.repeated else ''}{'?' if self.optional else ''}" if self.repeated or self.optional else whole

    def plain(self) -> list:
        return [self.key, self.optional, self.repeated, self.slot, [g.plain() for g in self.groups], self.chars, self.linked]

    @staticmethod
    def of(plain: list) -> Group:
        return Group(*plain[:4], [Group.of(g) for g in plain[4]], *plain[5:])

    @staticmethod
    def read(expression: str) -> Group:
        """The root of a wrapper from its expression."""
        open_ = [Group("")]
        for key, inner, end, repeated, optional in _GROUP.findall(expression):
            if end:
                g = open_.pop()
                g.repeated, g.optional = bool(repeated), bool(optional)
            else:
                g = Group(key, slot="#" in inner)
                g.menu = "-" in inner
                open_[-1].groups.append(g)
                open_.append(g)
        return open_[0]


def fold(groups: list[Group]) -> list[Group]:
    """Runs of siblings of one kind become one repeated group; of very many kinds in turn, all of one kind do."""
    out: list[Group] = []
    first: dict[str, Group] = {}
    many = len(groups) > SIBLINGS
    for g in groups:
        like = first.get(g.key) if many else out[-1] if out and out[-1].key == g.key else None
        if like is not None:
            like.add(g)
            like.repeated = True
        else:
            out.append(g)
            first[g.key] = g
    return out


def page_wrapper(found: list[tuple[Element | None, str, int]]) -> tuple[Group, list[Group]]:
    """The wrapper that one page makes: its block elements as groups, its texts as slots; and the group of each text (``now``)."""
    root, slots = Group(""), []
    made: dict[Element, Group] = {}
    for element, _, _ in found:
        chain = []
        while element is not None and element not in made:
            chain.append(element)
            element = element.parent
        g = made[element] if element is not None else root
        for e in reversed(chain):
            made[e] = Group(e.key)
            g.groups.append(made[e])
            g = made[e]
        g.slot = True
        slots.append(g)
    root.folded()
    return root, slots


def in_menus(page: Group, wrapper: Group) -> dict[Group, bool]:
    """Which groups of a page stand in a menu of the host's wrapper, for those that can be only one of its groups.

    A page's groups keep the wrapper's order. Those of one key are known one by one where they are as many as the wrapper's, or as many as its
    groups of that key that no page lacks.
    """
    out: dict[Group, bool] = {}
    left = [(page, wrapper, False)]
    while left:
        mine, its, menu = left.pop()
        out[mine] = menu = menu or its.menu
        sides: list[dict[str, list[Group]]] = [{}, {}]
        for side, g in zip(sides, (mine, its)):
            for x in g.groups:
                side.setdefault(x.key, []).append(x)
        for key, some in sides[0].items():
            like = sides[1].get(key, [])
            if len(like) != len(some):
                like = [x for x in like if not x.optional]
            if len(like) == len(some):
                left += [(a, b, menu) for a, b in zip(some, like)]
            elif menu:
                left += [(a, Group(key), True) for a in some]
    return out


class HostWrapper:
    """A host's wrapper as it grows: the expression, and each path's characters, linked ones, and named role."""

    def __init__(self) -> None:
        self.root: Group | None = None
        self.shapes: dict[int, list[Group]] = {}
        self.paths: dict[str, list] = {}

    def see(self, found: list[tuple[Element | None, str, int]], at: list[int], places: Places) -> None:
        """One more page; pages of a shape (runs of like paths count once) are aligned once."""
        begins = [i for i, (a, before) in enumerate(zip(at, [-1, *at])) if a != before]
        shape = hash(tuple(at[i] for i in begins))
        if shape not in self.shapes:
            root, slots = page_wrapper(found)
            self._align(root)
            self.shapes[shape] = [slots[i].now() for i in begins]
        groups, run = self.shapes[shape], -1
        for a, before, (_, text, linked) in zip(at, [-1, *at], found):
            run += a != before
            told = self.paths.setdefault(places.path(a), [0, 0, places.role(a)])
            group = groups[run].now()
            told[0] += len(text)
            told[1] += min(linked, len(text))
            group.chars += len(text)
            group.linked += min(linked, len(text))

    def _align(self, root: Group) -> None:
        if self.root is None:
            self.root = root
        else:
            self.root.add(root)

    def merge(self, raw: str) -> None:
        told = json.loads(raw)
        self._align(Group.of(told["root"]))
        for path, (chars, linked, role) in told["paths"].items():
            mine = self.paths.setdefault(path, [0, 0, role])
            mine[0] += chars
            mine[1] += linked

    def told(self) -> str:
        return json.dumps({"root": self.root.plain() if self.root else Group("").plain(), "paths": self.paths})

    def roles(self) -> dict[str, str]:
        """The role of each path; where nothing names the article, a group of mostly linked text is a menu."""
        mass: dict[str, list[int]] = {}
        for path, (chars, linked, role) in self.paths.items():
            if role == "open":
                keys = path.split("/") if path else []
                for k in range(1, len(keys) + 1):
                    m = mass.setdefault("/".join(keys[:k]), [0, 0])
                    m[0] += chars
                    m[1] += linked
        menu = {path for path, (chars, linked) in mass.items() if linked > LINKED * chars}
        out = {}
        for path, (_, _, role) in self.paths.items():
            keys = path.split("/")
            out[path] = "aside" if role == "open" and any("/".join(keys[:k]) in menu for k in range(1, len(keys) + 1)) else role
        return out


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def main_text(html: str | None, wrapper: dict | None) -> str:
    """The texts of a page whose group is the article's, joined by blank lines; ``wrapper`` has the host's groups, roles by path and constant (path, hash) pairs.

    Whether a text stands in a menu its group decides, else its path (all groups of that path together), else the text alone.
    """
    found = blocks(html or "")
    places, known = Places(), {}
    at = [places.of(e, known) for e, _, _ in found]
    if any(places.role(a) == "main" for a in at):
        return "\n\n".join(t for a, (_, t, _) in zip(at, found) if places.role(a) == "main")
    roles, constant = (wrapper["roles"], wrapper["constant"]) if wrapper else ({}, set())
    paths = {a: places.path(a) for a in set(at)}
    page, slots = page_wrapper(found) if wrapper else (None, [None] * len(found))
    known_menus = in_menus(page, wrapper["groups"]) if wrapper else {}
    kept = []
    for a, slot, (_, text, linked) in zip(at, slots, found):
        path = paths[a]
        menu = known_menus.get(slot.now()) if slot else None
        if menu is None:
            menu = roles[path] == "aside" if path in roles else linked > LINKED * len(text)
        if places.role(a) == "open" and not menu and (path, text_hash(text)) not in constant:
            kept.append(text)
    return "\n\n".join(kept)


def wrapper_parts(pages: DataFrame) -> DataFrame:
    """Of every page (host, html): each task's wrappers of hosts (wrapper), and the open slots of pages that name no article (path, text, longest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, HostWrapper] = {}
        places, n = Places(), 0

        def out() -> pa.RecordBatch:
            k = len(held)
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.told() for w in held.values()], pa.string()), pa.nulls(k, pa.string()), none, none], names)

        for batch in batches:
            for part in slices(batch, "html"):
                slots: list[tuple] = []
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found, known = blocks(html or ""), {}
                    at = [places.of(e, known) for e, _, _ in found]
                    w = held.setdefault(host, HostWrapper())
                    before = len(w.shapes) + len(w.paths)
                    w.see(found, at, places)
                    n += 1 + len(w.shapes) + len(w.paths) - before
                    if found and not any(places.role(a) == "main" for a in at):
                        opened = [(places.path(a), text_hash(t), len(t)) for a, (_, t, _) in zip(at, found) if places.role(a) == "open"]
                        longest = max(opened, key=lambda o: (o[2], o[1]), default=(None, None))[1]
                        slots += [(host, path, h, longest) for path, h in sorted({(p, h) for p, h, _ in opened})]
                if slots:
                    host, path, h, longest = zip(*slots)
                    yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.nulls(len(slots), pa.string()), pa.array(path, pa.string()), pa.array(h, pa.int64()), pa.array(longest, pa.int64())], names)
                if n > HELD:
                    yield out()
                    held.clear()
                    places, n = Places(), 0
        yield out()

    names = ["host", "wrapper", "path", "text", "longest"]
    return pages.select("host", "html").mapInArrow(run, "host string, wrapper string, path string, text long, longest long")


def _merged(group: pd.DataFrame) -> HostWrapper:
    w = HostWrapper()
    for raw in group["wrapper"]:
        w.merge(raw)
    return w


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON: expression, roles by path), constant (slots with template text) of every host (host, html)."""
    parts = written(wrapper_parts(pages))

    def some(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [_merged(group).told()]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        w = _merged(group)
        w.root.weigh()
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps({"expression": "".join(g.expression() for g in w.root.groups), "roles": w.roles()})]})

    dealt = parts.where("wrapper IS NOT NULL").select("host", "wrapper", F.expr(f"pmod(xxhash64(wrapper), {SALTS})").alias("salt"))
    wrappers = dealt.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string").groupBy("host").applyInPandas(whole, "host string, wrapper string")
    slots = written(parts.where("wrapper IS NULL").select("host", "path", "text", "longest").distinct())
    all_ = slots.select("host", "longest").distinct().groupBy("host").agg(F.count("*").alias("all"))
    often = slots.groupBy("host", "path", "text").agg(F.count("*").alias("n")).where(f"n >= {CONSTANT_PAGES}")
    constant = often.join(all_, "host").where("2 * n > all").groupBy("host").agg(F.collect_list(F.struct("path", "text")).alias("constant"))
    return wrappers.join(constant, "host", "left")


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every whole page."""
    hosted = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))).alias("host"),
    )
    with passing_tables(pages.sparkSession) as keep:
        wrappers = keep(written(host_wrappers(hosted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for page, host, wrapper, constant in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), part.column(5)):
                    if host not in known:
                        if len(known) >= 1000:
                            known.clear()
                        told = json.loads(wrapper.as_py()) if wrapper.is_valid else {"roles": {}, "expression": ""}
                        known[host] = {"roles": told["roles"], "groups": Group.read(told["expression"]), "constant": {(c["path"], c["text"]) for c in constant.as_py() or []}}
                    texts.append(main_text(page, known[host]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return hosted.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper", "constant").mapInArrow(run, "page_id long, url string, text string, n_chars long")
