"""Main text of web pages by wrappers inferred from the pages of a host.

A wrapper is a regular expression without unions over tags and text: every node holds its children in
order, each child required, optional or repeated, and text that differs between pages is a slot. A page
is the wrapper of itself, with equal neighbours folded into a repeated child. Wrappers are aligned one
after the other: the longest common run of children is matched, children on one side only become
optional, texts that differ become slots. Alignment is the same work at every level, so each task folds
its own pages by host first and only wrappers are shuffled, then folded by host again.

A host's wrapper says where its main text is: from the body down, the deepest node that holds all the
text that is neither link text nor in parts that menus, notices, adverts, forms, comments and the like
are made of. Classes, ids and roles mark such parts on containers only; where a mark's word may as well
name main text, the host's wrapper decides by words and links. A page's blocks are the texts of that node's
block elements: its slots, repeated and optional parts. Constants go: lines that every page with text at
their place holds, wherever they stand among their siblings, where at least three different pages have
it; lists, tables and the like only as a whole, headings only if nothing below them stays.

Plan: two narrow passes over the pages and a shuffle of wrappers, in two rounds so that a host with
most of the pages is folded by many tasks. A wrapper's size follows the templates of a site, not its
page count; a task holds those of HELD hosts. What was decided for each host is written and broadcast
if it is small; beyond that pages are joined with it by host and salt.

Children of one name are one part of the wrapper, wherever among their siblings they stand: a body whose
paragraphs and lists alternate in every page's own way is p+ and ul+, not a sequence as long as the
longest page. Tags and class words settle what alignment cannot see: menus, adverts and footers whose
text differs from page to page.

Defined results. Null or empty html: empty text. Null url: the host ''. A page whose host wrapper names
no node that it has: its own wrapper decides. Null ids and repeated rows: pages like others. Very long
pages: read whole. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import table, written

# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these names, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "option", "legend", "summary"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never main text.
APART = frozenset("nav header footer aside form script style noscript template iframe svg math button select textarea input label head title dialog menu object embed canvas".split())
#: Elements whose classes speak of the page.
WHOLE = frozenset({"html", "body", "main", "article"})
#: Words in class, id or role that mark such parts.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|footer|sidebar|aside|widget|"
    r"cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|signup|social|share|sharing|related|comment|comments|disqus|reply|replies|respond|form|search|login|pagination|pager)"
    r"(?:$|[\s_-])"
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story)(?:$|[\s_-])")
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
#: A tag with a quote that never ends: up to the next sign.
OPEN_QUOTE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
#: Words that, joined to one that is no mark (form-factor, related-work), may name main text: the wrapper decides.
WEAK = re.compile(r"^(?:banner|promo|menu|header|aside|notice|social|share|sharing|related|response|respond|reply|replies|form|search|login|subscribe|pager)$")
#: Elements that a class, id or role can mark as apart, and those of them whose id is no anchor.
MARKED = frozenset("div ul ol dl menu section center details fieldset figure".split())
NAMED = MARKED - {"section", "figure"}
#: What makes a part with a weak mark none of the main text, as constants and more links than text do.
CONTROLS = frozenset("input button select textarea form option".split())
#: It is main text if it holds some of these with words, or so many words a page without.
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li td th dd figcaption".split())
PART_WORDS = 20
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TEXT = "#text"


class Node:
    __slots__ = ("name", "parts")

    def __init__(self, name: str):
        self.name = name  # tag, with the signs that set it apart
        self.parts: list = []  # str or Node, in order


def signature(tag: str, attributes: str) -> str:
    """The tag with a sign for what its class, id and role say: '*' main text (a word says so and is no
    mark of another part itself), '!' a part that is none, '?' one that may be none, and names without
    digits. Headings, paragraphs, tables and inline elements are never marked, ids of sections are anchors."""
    if not attributes or "=" not in attributes:
        return tag
    found = [(a.lower(), f"{b}{c}{d}".lower().split()) for a, b, c, d in ATTRIBUTE.findall(attributes)]
    said = [w for _, words in found for w in words]
    if not said:
        return tag
    marked = [bool(MARKS.search(w)) for w in said]
    main = any(ARTICLE.search(w) and not m for w, m in zip(said, marked, strict=True))
    marks = [w for a, words in found for w in words if MARKS.search(w) and (a != "id" or tag in NAMED)] if tag in MARKED else []
    sign = "*" if main else "." if not marks else "?" if all(map(weak, marks)) else "!"
    named = ".".join(w for w in said if not re.search(r"[0-9]", w))
    return f"{tag}{sign}{named if len(named) <= 80 else digest(named)}"


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def weak(word: str) -> bool:
    parts = [x for x in re.split(r"[_-]", word) if x]
    marks = [x for x in parts if MARKS.search(x)]
    return len(marks) < len(parts) and all(map(WEAK.search, marks))


def tag_of(name: str) -> str:
    return re.split(r"[!*.?]", name, maxsplit=1)[0]


def apart(name: str) -> bool:
    return tag_of(name) in APART or "!" in name


def parse(page: str) -> Node:
    root = Node("root")
    stack, names, at = [root], ["root"], 0

    def close(to: int) -> None:
        del stack[to:], names[to:]

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].parts.append(page[at:])
            break
        if lt > at:
            stack[-1].parts.append(page[at:lt])
        m = TAG.match(page, lt) or OPEN_QUOTE.match(page, lt)
        if not m:  # a bare sign
            stack[-1].parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if k > 0:
                    close(k)
            continue
        if tag in ENDS_P and "p" in names:
            close(len(names) - 1 - names[::-1].index("p"))
        if tag in ENDS:
            ended, bound = ENDS[tag]
            k = len(names) - 1
            while k > 0 and names[k] not in bound:
                if names[k] in ended:
                    close(k)
                k -= 1
        node = Node(signature(tag, m[3]))
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            names.append(tag)
    return root


# A wrapper is [required, repeated, words of own text, words of it in links, constant or None, {name: wrapper}] in
# a list; flat() writes it as JSON. The root also has {place: [pages, some of their hashes, {line: words}]}
# with the lines that every page with text at the place holds there.
PAGES, REPEATED, WORDS, LINKED, CONSTANT, CHILDREN, LINES = range(7)


def wrapper_of(node: Node) -> list:
    """A page's own wrapper: children of one name fold into one that is repeated."""
    root: list = [1, 0, 0, 0, None, {}, lines_of(node)]
    todo = [(node, root, tag_of(node.name) == "a", True)]
    while todo:  # no recursion: pages nest as deep as they like
        node, w, linked, first = todo.pop()
        said = [x for part in node.parts if isinstance(part, str) for x in part.split()]
        text = constant(" ".join(said)) if said else None
        w[CONSTANT] = text if first or w[CONSTANT] == text else None
        w[WORDS] += len(said)
        w[LINKED] += len(said) if linked else 0
        below, here = [], set()
        for part in node.parts:
            if isinstance(part, str):
                continue
            new = part.name not in w[CHILDREN]
            child = w[CHILDREN].setdefault(part.name, [1, 0, 0, 0, None, {}])
            if part.name in here:
                child[REPEATED] = 1
            here.add(part.name)
            below.append((part, child, linked or tag_of(part.name) == "a", new))
        todo.extend(reversed(below))
    return root


def lines_of(root: Node) -> dict[str, list]:
    found = lines([root], ROOT)
    page = line_hash(ROOT, "\n".join(x[TEXT_OF] for x in found))
    out: dict[str, list] = {}
    for at, tag, group, words, text in found:
        held = out.setdefault(str(at), [1, [page], {}])[2]
        # words that weights() may leave out: none of what may be kept after all
        held[line_hash(at, text)] = 0 if group or tag in HEADINGS else words
    return out


def line_hash(at: int, text: str) -> str:
    return blake2b(b"%d %b" % (at, text.encode("utf-8", "replace")), digest_size=7).hexdigest()


def _lines_of_both(a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
    out = a | b
    for at in a.keys() & b.keys():
        (n, pages, held), (m, more, other) = a[at], b[at]
        out[at] = [n + m, sorted({*pages, *more})[:ENOUGH], {k: min(w, other[k]) for k, w in held.items() if k in other}]
    return out


def constant(text: str) -> str:
    """A text, or of a long one its start and a digest, which differ when the texts do."""
    return text if len(text) <= 80 else f"{text[:60]}#{digest(text)}"


def align(a: list, b: list) -> list:
    """The wrapper that covers both: matched children in common order, the others optional (they are in
    fewer pages than their parent), texts that differ become slots (no constant)."""
    root = _both(a, b)
    if len(a) > LINES and len(b) > LINES:
        root.append(_lines_of_both(a[LINES], b[LINES]))
    todo = [(a, b, root)]
    while todo:
        a, b, w = todo.pop()
        for name in _order(list(a[CHILDREN]), list(b[CHILDREN])):
            x, y = a[CHILDREN].get(name), b[CHILDREN].get(name)
            if x and y:
                w[CHILDREN][name] = _both(x, y)
                todo.append((x, y, w[CHILDREN][name]))
            else:
                w[CHILDREN][name] = x or y
    return root


def _both(a: list, b: list) -> list:
    return [a[PAGES] + b[PAGES], a[REPEATED] | b[REPEATED], a[WORDS] + b[WORDS], a[LINKED] + b[LINKED], a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None, {}]


def _order(left: list[str], right: list[str]) -> list[str]:
    """Every name once, the common ones in their order."""
    if left == right:
        return left
    names: list[str] = []
    i = j = 0
    for name in [*_common(left, right), None]:
        while i < len(left) and left[i] != name:
            names.append(left[i])
            i += 1
        while j < len(right) and right[j] != name:
            names.append(right[j])
            j += 1
        if name is not None:
            names.append(name)
            i, j = i + 1, j + 1
    return list(dict.fromkeys(names))


def flat(w: list) -> str:
    """A wrapper as JSON without nesting: parents before children, each with its parent's number."""
    out, todo = [], [(w, "root", -1)]
    while todo:
        node, name, parent = todo.pop()
        out.append([parent, name, *node[:CHILDREN], *node[CHILDREN + 1 :]])
        todo.extend((c, k, len(out) - 1) for k, c in reversed(node[CHILDREN].items()))
    return json.dumps(out)


def unflat(said: str) -> list:
    made: list[list] = []
    for parent, name, *values in json.loads(said):
        w = [*values[:CHILDREN], {}, *values[CHILDREN:]]
        if parent >= 0:
            made[parent][CHILDREN][name] = w
        made.append(w)
    return made[0]


def _common(a: list[str], b: list[str]) -> list[str]:
    """The longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def expression(w: list, name: str = "root") -> str:
    """The wrapper as a regular expression: (...)+ repeated, (...)? optional, #slot for text."""
    out: list[str] = []
    todo: list = [(w, name, None)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        w, name, parent_pages = item
        text = "" if not w[WORDS] else "#slot" if w[CONSTANT] is None else repr(w[CONSTANT])
        optional = parent_pages is not None and w[PAGES] < parent_pages
        sign = ("*" if optional else "+") if w[REPEATED] else "?" if optional else ""
        out.append(f"{'(' if sign else ''}<{name}>{text}")
        todo.append(f"</{name}>{')' + sign if sign else ''}")
        todo.extend((c, k, w[PAGES]) for k, c in reversed(w[CHILDREN].items()))
    return "".join(out)


def weights(w: list, name: str = "root") -> tuple[dict[int, int], list[int]]:
    """By identity of each wrapper node: its words that may be main text; and the places of the parts with
    a weak mark that hold none. Link text is none, but for headings, which often link to their own page."""
    order, todo = [], [(w, name, False, ROOT)]
    while todo:
        node, k, headed, at = todo.pop()
        headed = headed or tag_of(k) in HEADINGS
        order.append((node, k, headed, at))
        todo.extend((c, n, headed, place(at, n)) for n, c in node[CHILDREN].items())
    out: dict[int, int] = {}
    links: dict[int, int] = {}
    controls: dict[int, bool] = {}
    set_out: dict[int, int] = {}
    dropped = []
    for node, k, headed, at in reversed(order):  # children come after their parents
        linked = 0 if headed else node[LINKED]
        pages, seen, held = w[LINES].get(str(at), (0, (), {}))
        fixed = pages * sum(held.values()) if len(seen) >= ENOUGH else 0
        words = node[WORDS] - linked - fixed + sum(out[id(c)] for c in node[CHILDREN].values())
        linked += sum(links[id(c)] for c in node[CHILDREN].values())
        off = apart(k)
        controls[id(node)] = tag_of(k) in CONTROLS or any(controls[id(c)] for c in node[CHILDREN].values())
        set_out[id(node)] = words if tag_of(k) in PARAGRAPHS else sum(set_out[id(c)] for c in node[CHILDREN].values())
        if "?" in k and (linked > words or controls[id(node)] or (set_out[id(node)] <= 0 and words < PART_WORDS * node[PAGES])):
            dropped.append(at)
            off = True
        out[id(node)], links[id(node)] = (0, 0) if off else (words, linked)
    return out, dropped


#: Different pages that must hold a line before it counts as constant.
ENOUGH = 3
#: Elements whose lines belong together: they are constant only as a whole.
GROUP = frozenset("table dl ul ol pre blockquote figure details".split())
#: A place is a hash of the names from the root to a node.
ROOT = 0


def place(parent: int, name: str) -> int:
    return int.from_bytes(blake2b(b"%d %b" % (parent, name.encode("utf-8", "replace")), digest_size=7).digest(), "big")


def main_path(w: list) -> list[str]:
    return decide(w)["path"]


def decide(w: list) -> dict:
    """path: names from the root to the node of the main text, down as long as one block child holds all
    the words that may be main text, so nothing of it is left behind. off: places of parts that are none.
    fixed: lines that all pages with text at their place hold, where ENOUGH different pages have it."""
    path = []
    fixed = [k for _, seen, lines in w[LINES].values() if len(seen) >= ENOUGH for k in lines]
    held, dropped = weights(w)
    while held[id(w)]:
        kids = [(k, c) for k, c in w[CHILDREN].items() if tag_of(k) in BLOCK and held[id(c)] == held[id(w)]]
        if not kids or tag_of(kids[0][0]) in ("p", "li", "td", "pre", "blockquote", *HEADINGS):
            break
        k, w = kids[0]
        path.append(k)
    return {"path": path, "off": dropped, "fixed": fixed}


def at_path(root: Node, path: list[str]) -> list[Node]:
    found = [root]
    for name in path:
        found = [c for f in found for c in f.parts if isinstance(c, Node) and c.name == name]
    return found


def lines(nodes: list[Node], at: int, off: frozenset[int] = frozenset(), placed: bool = True) -> list[tuple]:
    """(place, tag, group, words not in links, text) of the lines of block elements in nodes, all of them at
    one place, without the parts that are off. Group: the number of the outermost GROUP, 0 for none."""
    out: list[tuple] = []
    said: list[str] = []
    words, groups = 0, 0
    of: tuple = (at, "", 0)

    def flush() -> None:
        nonlocal words
        line = " ".join(entities.unescape("".join(said)).split())
        if line:
            out.append((*of, words, line))
        said.clear()
        words = 0

    for top in nodes:
        flush()
        # node, next part, its place, (place, tag, group) of its block, in a link, in a heading
        todo: list = [(top, 0, at, (at, tag_of(top.name), 0), tag_of(top.name) == "a", tag_of(top.name) in HEADINGS)]
        while todo:  # no recursion: pages nest as deep as they like
            node, k, here, block, linked, headed = todo.pop()
            if k == len(node.parts):
                if tag_of(node.name) in BLOCK:
                    flush()
                continue
            todo.append((node, k + 1, here, block, linked, headed))
            part = node.parts[k]
            if isinstance(part, str):
                said.append(part)
                if not part.isspace():
                    of = block
                    words += len(part.split()) if headed or not linked else 0
                continue
            tag = tag_of(part.name)
            there = place(here, part.name) if placed else ROOT
            if apart(part.name) or there in off:
                if tag in BLOCK:
                    flush()
            elif tag == "br":
                said.append(" ")
            elif tag in BLOCK:
                flush()
                group = block[2]
                if not group and tag in GROUP:
                    groups += 1
                    group = groups
                todo.append((part, 0, there, (there, tag, group), linked, headed or tag in HEADINGS))
            else:
                todo.append((part, 0, there, block, linked or tag == "a", headed))
    flush()
    return out


LINE_AT, LINE_TAG, LINE_GROUP, _, TEXT_OF = range(5)


def blocks(nodes: list[Node], at: int = ROOT, off: frozenset[int] = frozenset(), fixed: frozenset[str] = frozenset()) -> list[str]:
    """Texts of the block elements in nodes without what is off and what is constant: lines and whole
    groups. A constant heading stays with what stays below it, and a page of nothing else stays."""
    found = lines(nodes, at, off, bool(off or fixed))
    if not fixed:
        return [x[TEXT_OF] for x in found]
    same = [line_hash(x[LINE_AT], x[TEXT_OF]) in fixed for x in found]
    varied = {x[LINE_GROUP] for x, c in zip(found, same, strict=True) if not c}
    keep, below = [], False
    for x, c in zip(reversed(found), reversed(same), strict=True):
        stays = not c or (x[LINE_GROUP] > 0 and x[LINE_GROUP] in varied) or (x[LINE_TAG] in HEADINGS and below)
        keep.append(stays)
        below = stays
    kept = [x[TEXT_OF] for x, stays in zip(found, reversed(keep), strict=True) if stays]
    return kept if any(not c for c in same) else [x[TEXT_OF] for x in found]


def text_of(page: str | None, plan: dict | None) -> str:
    """The main text by what its host's wrapper decided, or by its own."""
    if not page:
        return ""
    root = parse(page)
    nodes = at_path(root, plan["path"]) if plan is not None else []
    if not nodes or plan is None:
        plan = decide(wrapper_of(root))
        nodes = at_path(root, plan["path"])
    at = ROOT
    for name in plan["path"]:
        at = place(at, name)
    return "\n".join(blocks(nodes, at, frozenset(plan["off"]), frozenset(plan["fixed"])))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


#: Salts for the first round of folding by host.
SALTS = 32
#: Bytes of plans up to which they are broadcast.
BROADCAST = 64 << 20


#: Hosts whose wrappers a task holds before it hands them on.
HELD = 1000


def wrappers(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, pages, plan, expression); written."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch["host"], batch["page"], strict=True):
                if page:
                    w = wrapper_of(parse(page))
                    held[host] = align(held[host], w) if host in held else w
                if len(held) > HELD:
                    yield pd.DataFrame({"host": list(held), "w": [flat(w) for w in held.values()]})
                    held = {}
        if held:  # an empty frame has no types
            yield pd.DataFrame({"host": list(held), "w": [flat(w) for w in held.values()]})

    def fold(batch: pd.DataFrame) -> list:
        total = None
        for w in map(unflat, batch["w"]):
            total = align(total, w) if total else w
        return total

    def some(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "w": [flat(fold(batch))]})

    def whole(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        w = fold(batch)
        return pd.DataFrame({"host": [key[0]], "pages": [w[PAGES]], "plan": [json.dumps(decide(w))], "expression": [expression(w)]})

    read = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("page"))
    first = read.mapInPandas(own, "host string, w string").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    second = first.groupBy("host", "salt").applyInPandas(some, "host string, w string")
    return written(second.groupBy("host").applyInPandas(whole, "host string, pages long, plan string, expression string"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text."""
    plans = wrappers(pages, html, url).select("host", "plan")

    @F.pandas_udf("string")
    def main(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, where in batches:
            yield pd.Series([text_of(t, json.loads(p) if p else None) for t, p in zip(texts, where, strict=True)], dtype=object)

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("page"), host_of(F.col(url)).alias("host"))
    size = plans.agg(F.sum(F.octet_length("plan") + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST:
        told = rows.join(F.broadcast(plans), "host", "left")
    else:  # a host's pages go to SALTS tasks
        dealt = plans.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        told = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["host", "salt"], "left")
    return told.select("page_id", "url", main("page", "plan").alias("text"))


def op7(spark, sf_dir):
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
