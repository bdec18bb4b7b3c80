"""Main text of HTML pages by wrappers: union-free regular expressions inferred from each host's token streams.

Token streams are made well formed first (implied end tags), so that a mismatch can be resolved for a balanced span at a
time. A host's pages are aligned one after the other with the wrapper so far: a part that some pages lack becomes
optional, a part that comes again becomes repeated, parts that follow each other in either order become one repeated
group, and a text that differs becomes a slot. A wrapper holds counts and which part follows which; aligning adds these
up, so it is commutative and associative: tasks align their own pages, partial wrappers are aligned in any tree, and a
host's wrapper is the same for every order and partitioning of its pages.

What the wrapper shows decides what is article: blocks whose texts are the same in different articles are the template's,
repeated groups of links are menus, and a part that holds the host's slots stays whatever its class says. Names of tags
and classes are what a page says itself about its parts; a class alone only takes containers whose whole name is furniture.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, map_batches, shuffle_partitions, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][\w:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)/?>|<(/?)([A-Za-z][\w:-]*+)([^>]*+)>|([^<]++|<)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WHITE = re.compile(r"[\x20\x09-\x0D\x85\xA0  -     　]+")

# Element names of HTML, and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg canvas audio video select datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th")}
FENCE = frozenset("ul ol dl table select article section body html main".split())
MAIN_TAGS = frozenset(("article", "main"))
FURNITURE_TAGS = frozenset("head nav footer aside form menu dialog button script style".split())
CONTAINERS = frozenset("div section ul ol dl table tr td aside header span details fieldset center".split())
#: Elements that go as a whole where their texts are fixed; headings, labels and parts of sentences don't.
TEMPLATE_TAGS = frozenset("div section ul ol dl table p address header details fieldset center".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
FURNITURE_WORDS = COMMENT_WORDS | frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer footnav copyright sidebar widget widgets related recommended trending popular cookie cookies consent gdpr notice share sharing social subscribe subscription newsletter signup login popup modal overlay toolbar contentinfo complementary hidden".split())
HEADER_WORDS = frozenset("header banner masthead topbar".split())
#: Words that leave a name what it is: `cookie-bar` is furniture, `notice-period` is not.
NEUTRAL_WORDS = frozenset("area article articles bar block body bottom box btn button buttons card cards column container content count desktop email entry fixed float form full global grid group holder icons image images inline inner items js left link links list main message mobile module more news outer page pane panel policy post posts primary privacy reader readers region right row secondary section site slot small sticky stories story text thread top unit user users width wrap wrapper".split())
#: Words that may be furniture's or the article's: they count where the wrapper shows a fixed text or a menu.
WEAK_WORDS = FURNITURE_WORDS | HEADER_WORDS | frozenset("aside alert colophon discussion follow legal register search skip".split())
MAIN_WORDS = frozenset("article articlebody main content post entry story maincontent postcontent entrycontent bodytext".split())

#: Different signatures of one tag under one element; with more of them the class tells nothing, and they count as one.
WIDE = 64
#: Share of an element's characters in links from which on its repeated parts are a menu.
LINKED = 0.8
#: A task hands over what it has aligned when it holds so many wrapper nodes; this changes no result.
HELD_NODES = 50_000
#: Partial wrappers of one host that a task aligns at a time; with more of them they are aligned in a tree.
FAN_IN = 64
#: Pages of one host for each share of the host in a join that is not broadcast.
SHARE_PAGES = 10_000


@lru_cache(65_536)
def signature(tag: str, attributes: str) -> str:
    """The tag and its names, each in lower case with words joined by `-`: class and role, ids that have a known word, and `hidden`."""
    names: list[str] = []
    for name, *values in ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                names.append("hidden")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            names.append("hidden")
        elif name in ("class", "id", "role"):
            for token in unescape(value).split():
                words = re.findall(r"[a-z]+(?:\d(?!\d))?", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())  # longer numbers tell pages apart, not parts
                if words and (name != "id" or not (WEAK_WORDS | MAIN_WORDS).isdisjoint([w.rstrip("0123456789") for w in words])):
                    names.append("-".join(words))
    return tag + "".join(f".{w}" for w in dict.fromkeys(names))


@lru_cache(65_536)
def named(sig: str) -> tuple[str, bool, bool, bool, bool, bool]:
    """(tag, whether a name is furniture's, is a reader comments' or hidden, might be furniture's, is a header's, is the article's)."""
    tag, *names = sig.split(".")
    words = [re.sub(r"\d", "", n).split("-") for n in names]
    known = lambda w, those: any(x in those for x in w) and all(x in those or x in NEUTRAL_WORDS for x in w)
    strong = any(known(w, FURNITURE_WORDS) for w in words)
    main = tag in MAIN_TAGS or any(w in (["main"], ["article"]) for w in words) or any(set(w) <= MAIN_WORDS for w in words)
    return tag, strong, any(known(w, COMMENT_WORDS | {"hidden"}) for w in words), any(x in WEAK_WORDS for w in words for x in w), any(known(w, HEADER_WORDS) for w in words), main


def page_tree(html: str) -> list:
    """[signature, children] of a page; a text is a str. Balanced: implied ends are filled in, stray ends ignored."""
    root: list = ["", []]
    stack, at, opened = [root], 0, Counter()
    while m := TOKEN.match(html, at):
        at = m.end()
        text = m[7]
        if text is not None:
            stack[-1][1].append(text)
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                name = stack[k][0].split(".", 1)[0]
                if name == tag:
                    end_from(stack, k, opened)
                    break
                if name in FENCE and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            if not (tag == "svg" and (m[3] or m[6] or "").endswith("/")):
                end = raw_end(tag).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            close_open(stack, ("p",), opened)
        if tag in CLOSES:
            close_open(stack, CLOSES[tag], opened)
        if tag == "br" or tag in VOID:
            stack[-1][1].append([tag, []])
        else:
            given = m[3] if m[3] is not None else m[6] or ""
            node: list = [(signature if len(given) < 1000 else signature.__wrapped__)(tag, given), []]
            stack[-1][1].append(node)
            stack.append(node)
            opened[tag] += 1
    return root


@lru_cache(64)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def end_from(stack: list, k: int, opened: Counter) -> None:
    """Ends the open elements from the k-th on."""
    for x in stack[k:]:
        opened[x[0].split(".", 1)[0]] -= 1
    del stack[k:]


def close_open(stack: list, names: tuple[str, ...], opened: Counter) -> None:
    """Ends the open element of one of these names, with all in it, unless a list, table or section is in between."""
    if not any(opened[n] for n in names):
        return
    for k in range(len(stack) - 1, 0, -1):
        name = stack[k][0].split(".", 1)[0]
        if name in names:
            end_from(stack, k, opened)
            return
        if name in FENCE or name == "div" and names == ("li",):
            return


class Part:
    """An element of a wrapper, over all places where pages have it.

    n: places; filled: whether a place has a text; text: that whole text in normal form if always the same, "" if there is
    none, None (a slot) if it differs; least, most: the digests of the articles on whose pages the text stood; direct,
    chars: places with a text that is in none of its elements, and the characters of those; parts: its elements by signature; follows: which part was seen next to which (`#` is the text);
    parents: places of the element above that have this one; again: whether one of them has it twice; wide: tags whose
    elements count as one here.
    """

    __slots__ = ("again", "chars", "direct", "filled", "follows", "least", "most", "n", "parents", "parts", "text", "wide")

    def __init__(self) -> None:
        self.n = self.direct = self.chars = self.least = self.most = self.parents = 0
        self.again, self.filled, self.text = False, False, ""
        self.parts: dict[str, Part] = {}
        self.follows: set[tuple[str, str]] = set()
        self.wide: set[str] = set()

    def part(self, sig: str) -> Part:
        """The part of this signature, made if need be."""
        sig = self.name(sig)
        found = self.parts.get(sig)
        if found is None:
            found = self.parts[sig] = Part()
            if len(self.parts) > WIDE:
                self.narrow()
                found = self.parts[self.name(sig)]
        return found

    def name(self, sig: str) -> str:
        """The signature under which the part is kept."""
        if self.wide:
            tag = sig.split(".", 1)[0]
            return tag if tag in self.wide else sig
        return sig

    def narrow(self) -> None:
        """Elements of a tag with more than WIDE signatures become one optional, repeated part.

        More signatures in a part of the pages are more in all of them, so it does not matter when this is seen.
        """
        tags = Counter(s.split(".", 1)[0] for s in self.parts)
        self.wide |= {t for t, m in tags.items() if m > WIDE}
        for sig in [s for s in self.parts if "." in s and s.split(".", 1)[0] in self.wide]:
            one = self.parts.pop(sig)
            tag = sig.split(".", 1)[0]
            if tag in self.parts:
                self.parts[tag].align(one)
            else:
                self.parts[tag] = one
        for tag in self.wide & self.parts.keys():
            self.parts[tag].parents, self.parts[tag].again = 0, True
        self.follows = {(self.name(a), self.name(b)) for a, b in self.follows}

    def own(self, text: str | None, least: int, most: int) -> None:
        """Aligns the text: one that differs becomes a slot."""
        if self.filled:
            if self.text != text:
                self.text = None
            least, most = min(self.least, least), max(self.most, most)
        else:
            self.filled, self.text = True, text
        self.least, self.most = (0, 0) if self.text is None else (least, most)

    def align(self, other: Part) -> None:
        """Takes in another wrapper of the same element."""
        self.n, self.parents, self.again = self.n + other.n, self.parents + other.parents, self.again or other.again
        self.follows |= other.follows
        self.wide |= other.wide
        self.direct, self.chars = self.direct + other.direct, self.chars + other.chars
        if other.filled:
            self.own(other.text, other.least, other.most)
        for sig, theirs in other.parts.items():
            if sig in self.parts:
                self.parts[sig].align(theirs)
            else:
                self.parts[sig] = theirs
        if self.wide or len(self.parts) > WIDE:
            self.narrow()

    def take(self, tree: list, article: int, asked: bool = False) -> str | None:
        """Takes in a place of the element on a page; the text in it, if asked for or if it was always the same so far."""
        self.n += 1
        asked_own = asked
        asked = asked or self.text is not None
        texts: list[str] = []
        seen: set[str] = set()
        last, own = "", 0
        for x in tree[1]:
            if isinstance(x, str):
                if x.isspace():
                    continue
                own += len(x.strip())
                texts.append(x)
                sig = "#"
            else:
                one = self.part(x[0])
                text = one.take(x, article, asked)
                if text:
                    texts.append(text)
                sig = self.name(x[0])
                if sig in seen:
                    one.again = True
                elif sig not in self.wide:
                    one.parents += 1
                seen.add(sig)
            if last:
                self.follows.add((last, sig))
            last = sig
        if own:
            self.direct += 1
            self.chars += own
        if self.wide:
            self.narrow()
        text = text_key(" ".join(texts)) if asked else None
        if text:
            self.own(text, article, article)
        return text if asked_own else None

    def nodes(self) -> int:
        return 1 + sum([x.nodes() for x in self.parts.values()])

    def groups(self) -> list[list[str]]:
        """The parts in an order in which they come; those that come in either order together, as one repeated group."""
        names = sorted({"#", *self.parts} if self.direct else self.parts)
        after: dict[str, set[str]] = {a: set() for a in names}
        for a, b in self.follows:
            if a != b:
                after[a].add(b)
        reach: dict[str, set[str]] = {}
        for a in names:
            seen, todo = set(), [a]
            while todo:
                for b in after[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            reach[a] = seen
        out, placed = [], set()
        for a in sorted(names, key=lambda x: (-len(reach[x] | {x}), x)):
            if a not in placed:
                out.append([a, *[b for b in names if b != a and b in reach[a] and a in reach[b]]])
                placed |= set(out[-1])
        return out

    def expression(self) -> str:
        """The wrapper as a regular expression: `?` optional, `+` repeated, `*` both, `#` a slot, quoted a fixed text."""

        def told(sig: str) -> str:
            if sig == "#":
                return ("#" if self.text is None or self.parts else json.dumps(self.text, ensure_ascii=False)) + "?" * (self.direct < self.n)
            x = self.parts[sig]
            inner = x.expression()
            return (f"{sig}({inner})" if inner else sig) + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[int(x.parents < self.n), int(x.again)]

        return " ".join([told(g[0]) if len(g) == 1 else f"({' '.join([told(x) for x in g])})+" for g in self.groups()])

    def flat(self) -> list:
        """The wrapper as a list without nesting, the same for equal wrappers."""
        out: list = []

        def put(sig: str, x: Part) -> None:
            names = sorted(x.parts)
            at = {s: i for i, s in enumerate(["#", *names])}
            out.extend((sig, x.n, int(x.filled), x.text, x.least, x.most, x.direct, x.chars, x.parents, int(x.again), sorted([at[a], at[b]] for a, b in x.follows), sorted(x.wide), len(names)))
            for s in names:
                put(s, x.parts[s])

        put("", self)
        return out


def deep() -> None:
    """Lets Python recurse as deep as markup nests; such calls need no C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))


def text_key(text: str) -> str:
    """The text in normal form, or a digest of one over 200 characters."""
    text = WHITE.sub(" ", text).strip(" ")
    return text if len(text) <= 200 else "#" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def read_wrapper(flat: list) -> Part:
    at = 0

    def get() -> tuple[str, Part]:
        nonlocal at
        x = Part()
        sig, x.n, x.filled, x.text, x.least, x.most, x.direct, x.chars, x.parents, again, follows, wide, size = flat[at : at + 13]
        at += 13
        x.again, x.filled, x.wide = bool(again), bool(x.filled), set(wide)
        names = ["#"]
        for _ in range(size):
            s, part = get()
            x.parts[s] = part
            names.append(s)
        x.follows = {(names[a], names[b]) for a, b in follows}
        return sig, x

    return get()[1]


def article_digest(tree: list) -> int:
    """Of a page's three longest texts: copies of an article on other pages are one article."""
    texts: list[str] = []

    def walk(nodes: list) -> None:
        for x in nodes:
            if isinstance(x, str):
                texts.append(x)
            else:
                walk(x[1])

    walk(tree[1])
    longest = [WHITE.sub(" ", t).strip(" ") for t in heapq.nlargest(3, set(texts), key=lambda t: (len(t), t))]
    return int.from_bytes(hashlib.md5("\n".join(longest).encode("utf-8", "surrogatepass")).digest()[:6], "big")


def page_wrapper(html: str | None, into: Part | None = None) -> Part:
    """A page as a wrapper, or aligned with one."""
    deep()
    tree, into = page_tree(html or ""), into or Part()
    into.take(tree, article_digest(tree))
    return into


OUT, MAIN, NAMED = 1, 2, 3


def roles(wrapper: Part) -> list:
    """[role, {signature: the same for the part}, tags that count as one] of each part that has a role, or holds one that has.

    OUT: furniture. MAIN: an article by its tag or name; NAMED: by a weaker name. Decided by:
    - tags of furniture and containers whose whole name is furniture, unless they hold the article: an `article` or
      `main`, or, in wrappers without one, most of the slots' characters that are no links;
    - fixed texts, the same in two articles or more, and repeated groups of links: furniture outside the article if they
      are blocks and no headings; in the article, and for parts that are no containers, only with a name that may be
      furniture's.
    """
    told: dict[int, tuple[int, int, int, int, bool]] = {}

    def strict(sig: str) -> bool:
        tag, _, comments, _, _, _ = named(sig)
        return not comments and (tag in MAIN_TAGS or tag in ("div", "section") and not {"main", "article"}.isdisjoint(sig.split(".")))

    def is_fixed(x: Part) -> bool:
        return x.filled and x.text is not None and x.least != x.most

    def weigh(sig: str, x: Part, linked: bool) -> tuple[int, int, int, int, bool]:
        """(characters; of them in links; in articles by tag or name; in slots but not in links; whether links are repeated)."""
        linked = linked or sig.split(".", 1)[0] == "a"
        chars, links, marked, slots, menu = x.chars, x.chars if linked else 0, 0, 0 if linked else x.chars, False
        for s, y in x.parts.items():
            c, k, m, v, again = weigh(s, y, linked)
            chars, links, marked, slots, menu = chars + c, links + k, marked + m, slots + v, menu or again or y.again and k > 0
        told[id(x)] = (chars, links, chars if strict(sig) else marked, 0 if is_fixed(x) else slots, menu)
        return told[id(x)]

    _, _, all_marked, all_slots, _ = weigh("", wrapper, False)

    def decide(sig: str, x: Part, inside: bool, outer: bool) -> list | None:
        """outer: the element is html, body or the page itself."""
        tag, strong, comments, weak, header, main = named(sig)
        chars, links, marked, slots, menu = told[id(x)]
        fixed = is_fixed(x)
        listed = menu and links >= LINKED * chars
        if comments:
            holder = 0 < marked == all_marked
        elif all_marked:
            holder = 2 * marked > all_marked and not inside
        else:
            holder = tag not in ("nav", "footer", "aside", "head") and 2 * slots > all_slots
        role = 0
        if outer or holder or tag in MAIN_TAGS and not (inside and strong):
            pass
        elif tag in FURNITURE_TAGS or "hidden" in sig.split("."):
            role = OUT
        elif strong and (tag in CONTAINERS or tag in MAIN_TAGS) or (tag == "header" or header) and not inside or weak and (fixed or listed):
            role = OUT
        elif not inside and tag in TEMPLATE_TAGS and (fixed or listed):
            role = OUT
        if role == OUT:
            return [OUT, {}, []]
        if main and not inside and not outer and not comments and chars and "hidden" not in sig.split("."):
            role = MAIN if strict(sig) else NAMED
        inner = {}
        for s, y in x.parts.items():
            found = decide(s, y, inside or role > 0, outer and s.split(".", 1)[0] in ("html", "body"))
            if found:
                inner[s] = found
        return [role, inner, sorted(x.wide)] if role or inner else None

    return decide("", wrapper, False, True) or [0, {}, []]


def role_of(found: list | None, sig: str) -> list | None:
    """What is known of a part of an element with these roles."""
    if not found:
        return None
    tag = sig.split(".", 1)[0]
    return found[1].get(sig if tag not in found[2] else tag)


def flat_roles(found: list) -> list:
    out: list = []

    def put(sig: str, x: list) -> None:
        out.extend((sig, x[0], x[2], len(x[1])))
        for s in sorted(x[1]):
            put(s, x[1][s])

    put("", found)
    return out


@lru_cache(4096)
def read_roles(told: str) -> list:
    flat, at = json.loads(told), 0

    def get() -> tuple[str, list]:
        nonlocal at
        sig, role, wide, size = flat[at : at + 4]
        at += 4
        x: list = [role, {}, wide]
        for _ in range(size):
            s, part = get()
            x[1][s] = part
        return sig, x

    return get()[1]


def article_text(html: str | None, found: list) -> str:
    """The blocks of a page's article, by the roles of its host's wrapper: of its MAIN parts, else its NAMED ones, else all."""
    deep()
    tree = page_tree(html or "")[1]
    present: set[int] = set()

    def look(nodes: list, known: list | None) -> None:
        for x in nodes:
            if not isinstance(x, str) and (here := role_of(known, x[0])) and here[0] != OUT:
                present.add(here[0])
                look(x[1], here)

    look(tree, found)
    wanted = MAIN if MAIN in present else NAMED if NAMED in present else 0
    blocks: list[list[str]] = [[]]

    def walk(nodes: list, known: list | None, inside: bool) -> None:
        for x in nodes:
            if isinstance(x, str):
                if inside:
                    blocks[-1].append(x)
                continue
            here = role_of(known, x[0])
            tag = x[0].split(".", 1)[0]
            if here and here[0] == OUT:
                blocks.append([])
                continue
            if tag in ("br", "td", "th", "option"):
                blocks[-1].append(" ")
            block = tag in BLOCK
            if block:
                blocks.append([])
            if inside or here:
                walk(x[1], here, inside or here[0] == wanted)
            if block:
                blocks.append([])

    walk(tree, found, not wanted)
    texts = (WHITE.sub(" ", unescape("".join(b))).strip(" ") for b in blocks)
    return "\n".join(t for t in texts if t)


def host_of(column: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """pages(url, html, ...) -> (host, wrapper, n_pages): one wrapper for each host, from all of its pages.

    Each task aligns its pages; a host then has a partial wrapper of each task, which are aligned in a tree of FAN_IN,
    by tasks that hold two wrappers at a time. A null html is an empty page.
    """
    spark = pages.sparkSession

    def row(held: list[tuple[str, Part]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([json.dumps(w.flat(), ensure_ascii=False) for _, w in held], pa.string()), pa.array([w.n for _, w in held], pa.int64())], names=["host", "wrapper", "n_pages"])

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        known: dict[str, Part] = {}
        pages_held = 0
        for b in batches:
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                known[host] = page_wrapper(html, known.get(host))
            pages_held += b.num_rows
            if pages_held >= 1024:
                pages_held = 0
                if sum([w.nodes() for w in known.values()]) > HELD_NODES:
                    yield from handed(known)
                    known = {}
        yield from handed(known)

    def handed(known: dict[str, Part]) -> Iterator[pa.RecordBatch]:
        hosts = list(known)
        for at in range(0, len(hosts), 64):
            yield row([(h, known[h]) for h in hosts[at : at + 64]])

    def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        host, held = None, None
        for b in batches:
            for h, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                one = read_wrapper(json.loads(w))
                if held is not None and h == host:
                    held.align(one)
                else:
                    if held is not None:
                        yield row([(host, held)])
                    host, held = h, one
        if held is not None:
            yield row([(host, held)])

    schema = "host string, wrapper string, n_pages long"
    found = written(map_batches(pages.select(host_of().alias("host"), "html"), by_task, schema), "wrappers")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        if most == 1:
            return found
        share = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN_IN)))
        parted = found.withColumn("share", share).repartition(shuffle_partitions(spark), "host", "share").sortWithinPartitions("host", "share")
        # rows of two shares of a host that meet in a task are aligned too
        found = written(map_batches(parted.select("host", "wrapper"), by_host, schema), "wrappers")


def host_roles(wrappers: DataFrame) -> DataFrame:
    """(host, roles, n_pages) of (host, wrapper, n_pages)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for b in batches:
            told = [json.dumps(flat_roles(roles(read_wrapper(json.loads(w)))), ensure_ascii=False) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(told, pa.string()), b.column("n_pages")], names=["host", "roles", "n_pages"])

    return map_batches(wrappers, each, "host string, roles string, n_pages long")


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars), a row for each row.

    Nulls: a null html is an empty page with an empty text; a null url, or one without a host, belongs to the host "".
    A host with a single page gets a wrapper from it alone, in which nothing is fixed. Equal rows are kept; an empty
    table gives no rows; the order of rows does not matter. Markup is never cut: tags left open end with their parents,
    an unclosed comment ends with the page, nests may be of any depth. A page whose article has no text has none.
    Further columns are ignored.
    """
    found = written(host_roles(host_wrappers(pages)), "roles")
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    if fits_broadcast(found):
        joined = rows.join(F.broadcast(found), "host", "left")
    else:  # a host with many pages takes as many shares of them, each with its roles
        shares = (F.col("n_pages") / SHARE_PAGES).cast("long") + 1
        many = found.where(F.col("n_pages") > SHARE_PAGES).select("host", shares.alias("shares"))
        spread = rows.join(F.broadcast(many), "host", "left") if fits_broadcast(many) else rows.join(many, "host", "left")
        spread = spread.withColumn("share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("shares", F.lit(1).cast("long"))))
        joined = spread.join(found.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))), ["host", "share"], "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for b in batches:
            texts = [article_text(h, read_roles(w)) for h, w in zip(b.column("html").to_pylist(), b.column("roles").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(joined.select("page_id", "url", "html", "roles"), each, "page_id long, url string, text string, n_chars long")
