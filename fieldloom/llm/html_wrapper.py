"""Main text of pages by wrappers, inferred from the pages of each host.

A wrapper is a union-free regular expression over page tokens, kept as a tree: an element with its
parts in order, each part required or optional, once or repeated, and texts that are constant or a
slot. It is inferred by aligning one page after another with what was found so far.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.url_filter import split_url
from fieldloom.session import stored

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split())
#: An opening tag of the key closes open elements of the value, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
CONTAINERS = frozenset("ul ol dl table select body article section div main nav aside footer header form blockquote td th".split())
#: Elements that close an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Elements that never hold main text.
APART = frozenset(
    "head nav header footer aside form button select option input menu dialog script style noscript template iframe object embed "
    "applet canvas svg math audio video textarea title map".split())
#: Words of a class, id or role that mark what is no main text.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget related recommended share "
    "sharing social cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login comment comments "
    "commentlist disqus respond reply replies pagination pager skip toolbar".split())
#: Words before a mark in a class that says what an element has ("with-sidebar"), not what it is.
_HAS = frozenset("with without has have no not hide show".split())
MAIN_MARKS = frozenset("main content article post entry story articlebody".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*$", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")


@dataclass(slots=True)
class Node:
    """An element of a page: name with class and id, and elements and texts in order."""

    name: str
    tag: str
    apart: bool = False
    main: bool = False
    parts: list = field(default_factory=list)
    mark: int = 0


#: Kinds of marks: by a later word of a class, by its first word, hidden.
_SOFT, _FIRM, _HIDDEN = 1, 2, 3


def _marks(tag: str, attributes: str) -> tuple[str, int, bool]:
    """Name suffix, what kind of mark sets the element apart (0: none), whether it is main text.
    What a class of the whole page says marks nothing, nor does one of ``main``, nor a class like
    "with-sidebar"; an ``article`` is set apart only by what a class or role begins with."""
    if not attributes or attributes.isspace():
        return "", 0, False
    suffix, apart, main = [], 0, False
    for match in _ATTRIBUTE.finditer(attributes):
        key = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if key in ("hidden", "aria-hidden"):
            if (key == "hidden" and match[0].lower() == "hidden") or value.lower() == "true":
                apart = _HIDDEN
            continue
        if tag not in ("html", "body", "main"):
            for first, *later in filter(None, ([w.lower() for w in _WORD.findall(x)] for x in value.split())):
                if first in MARKS:
                    apart = max(apart, _FIRM)
                elif tag != "article" and first not in _HAS and not MARKS.isdisjoint(later):
                    apart = max(apart, _SOFT)
                main |= first in MAIN_MARKS or (tag != "article" and not MAIN_MARKS.isdisjoint(later))
        if key in ("class", "role"):
            suffix.append("." + " ".join(sorted(value.split())))
    return "".join(suffix), apart, main and not apart


def _released(root: Node) -> None:
    """Take marks off layout containers that merely name what they have beside the text.

    A mark by a class, id or role goes when the element holds a ``main``; when it holds an
    ``article`` and no ``main`` or ``article`` lies outside marked elements; when it holds what is
    marked as main text, nothing such lies outside, and it has more than half of the page's text;
    and when it is a mark by a later word, and elements of its name have more than half.
    """
    below: dict[int, tuple[int, set[str]]] = {}

    def measure(node: Node, inside: bool) -> tuple[int, set[str]]:
        """Characters below, and which kinds of main elements (and "out:" those outside of marks)."""
        size, kinds = 0, set()
        for part in node.parts:
            if isinstance(part, str):
                size += len(part.strip())
            elif part.mark == _HIDDEN or (part.apart and not part.mark) or part.tag in RAW or part.tag in APART:
                continue
            else:
                n, found = measure(part, inside or part.mark > 0)
                size, kinds = size + n, kinds | found
                if not part.mark and (part.main or part.tag in ("main", "article")):
                    kind = part.tag if part.tag in ("main", "article") else "marked"
                    kinds |= {kind} if inside else {kind, "out:" + kind}
        below[id(node)] = size, kinds
        return size, kinds

    total, kinds = measure(root, False)
    outside = {k[4:] for k in kinds if k.startswith("out:")}
    soft: dict[str, int] = {}

    def outermost(node: Node) -> list[Node]:
        out = []
        for part in node.parts:
            if isinstance(part, Node) and id(part) in below:
                out += [part] if part.mark else outermost(part)
        return out

    todo = outermost(root)
    while todo:
        soft.clear()
        for node in todo:
            soft[node.name] = soft.get(node.name, 0) + below[id(node)][0]
        free = []
        for node in todo:
            size, held = below[id(node)]
            if (
                "main" in held
                or ("article" in held and not outside & {"main", "article"})
                or ("marked" in held and not outside and 2 * size > total)
                or (node.mark == _SOFT and 2 * soft[node.name] > total)
            ):
                node.apart, node.mark = False, 0
                free.append(node)
        todo = [x for node in free for x in outermost(node)]


#: Levels of a tree. Deeper elements are taken for the one they are in: its text is theirs.
MOST_LEVELS = 200


def parse(page: str) -> Node:
    """The page as a tree. Ends that are left out are put in by the usual rules, ends without a
    beginning are ignored, and what is open at the end of the page is closed.

    Below :data:`MOST_LEVELS` levels only elements that are set apart or marked as main text become
    nodes of their own, outermost ones; other elements share the parts of the one around, with a blank
    where a block begins or ends. So no tree is deeper than that and two more, however deep the page."""
    root = Node("#page", "#page")
    stack = [root]
    at, n = 0, len(page)
    known: dict[tuple[str, str], tuple[str, int, bool]] = {}
    marked = False
    kept: list[tuple[int, str]] = []
    # Where the open elements of each tag stand in the stack; where containers, those that are no cells,
    # and elements that are not inline stand. So no tag makes the parser look through the stack.
    standing: dict[str, list[int]] = {}
    containers, walls, solid = [0], [0], [0]

    def last(tag: str) -> int:
        return standing[tag][-1] if standing.get(tag) else 0

    def push(node: Node) -> None:
        standing.setdefault(node.tag, []).append(len(stack))
        for places, member in ((containers, node.tag in CONTAINERS), (walls, node.tag in CONTAINERS and node.tag not in ("td", "th")),
                               (solid, node.tag not in INLINE)):
            if member:
                places.append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        for node in stack[k:]:
            standing[node.tag].pop()
        del stack[k:]
        for places in (containers, walls, solid):
            while places[-1] >= k:
                places.pop()

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].parts.append(page[at:upto])

    for match in _TOKEN.finditer(page):
        if match.start() < at:
            continue
        text(match.start())
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            continue
        tag = tag.lower()
        if match[1] or match[4]:
            if len(stack) > MOST_LEVELS and tag not in INLINE:
                stack[-1].parts.append(" ")
            k = last(tag)
            if k and (tag not in INLINE or k > solid[-1]):
                cut(k)
            continue
        if tag in BLOCKS and last("p") > containers[-1]:
            cut(last("p"))
        if tag in CLOSES:
            k = max(map(last, CLOSES[tag]))
            if k and k >= walls[-1]:
                cut(k)
        key = (tag, match[3] or "")
        marks = known.get(key)
        if marks is None:
            marks = known[key] = _marks(*key)
        node = Node(tag + marks[0], tag, tag in APART or marks[1] > 0, tag in ("article", "main") or marks[2], mark=marks[1])
        marked |= marks[1] in (_SOFT, _FIRM)
        shared = len(stack) > MOST_LEVELS and tag not in RAW and tag not in VOID
        if shared:
            # Elements kept below the limit, by what they are kept for.
            del kept[bisect_left(kept, len(stack), key=lambda k: k[0]) :]
            kinds = {kind for _, kind in kept}
            own = "apart" if node.apart else "main" if node.main else None
            if own and own not in kinds:
                kept.append((len(stack), own))
                shared = False
        if shared:
            if tag not in INLINE:
                stack[-1].parts.append(" ")
            node.parts = stack[-1].parts
        else:
            stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not (match[3] or "").endswith("/"):
                at = end.end() if end else n
        elif tag not in VOID and not (match[3] or "").endswith("/"):
            push(node)
    text(n)
    if marked:
        _released(root)
    return root


# --- wrappers --------------------------------------------------------------------------------
#
# A wrapper element is a dict: n name, o optional, r repeated, k parts; the text slots of a part list
# are dicts with t (the constant text, or None for a slot) and c (characters seen). Marks: a, m.


def _constant(text: str) -> str:
    """A text as wrappers compare it: white space made equal, a long one by its digest."""
    text = " ".join(text.split())
    return text if len(text) <= 64 else "#" + hashlib.md5(text.encode()).hexdigest()


def _same(x: dict, y: dict) -> bool:
    return x.get("n") == y.get("n")


def _squeezed(parts: list[dict]) -> list[dict]:
    """Neighbours of one name become one repeated part; then runs of two to four names that repeat
    become repeated parts as well, each aligned with the one before."""
    out: list[dict] = []
    for part in parts:
        if out and _same(out[-1], part):
            out[-1] = _merged(out[-1], part)
            if "n" in part:
                out[-1]["r"] = True
        else:
            out.append(part)
    for width in (2, 3, 4):
        k = 0
        while k + 2 * width <= len(out):
            if all(_same(out[k + j], out[k + width + j]) for j in range(width)):
                for j in range(width):
                    out[k + j] = _merged(out[k + j], out[k + width + j])
                    if "n" in out[k + j]:
                        out[k + j]["r"] = True
                del out[k + width : k + 2 * width]
            else:
                k += 1
    return out


def expression(node: Node) -> dict:
    """The wrapper of a single page. Inline elements and their texts belong to the text around."""
    parts: list[dict] = []
    for part in node.parts:
        if isinstance(part, str):
            if part.strip():
                parts.append({"t": _constant(part), "c": len(part)})
        elif part.tag in INLINE and not part.apart:
            parts += expression(part)["k"]
        elif part.tag not in RAW and part.tag not in VOID:
            parts.append(expression(part))
    return {"n": node.name, "k": _squeezed(parts), "a": node.apart, "m": node.main}


def _merged(x: dict, y: dict) -> dict:
    """Two parts of one name: texts that differ become a slot, elements align their parts."""
    if "n" not in x:
        same = x["t"] is not None and x["t"] == y["t"]
        out = {"t": x["t"] if same else None, "c": x["c"] + y["c"]}
    else:
        out = {"n": x["n"], "k": _aligned(x["k"], y["k"]), "a": x["a"] and y["a"], "m": x["m"] or y["m"]}
    for flag in ("o", "r"):
        if x.get(flag) or y.get(flag):
            out[flag] = True
    return out


def _aligned(x: list[dict], y: list[dict]) -> list[dict]:
    """Align two lists by a longest common subsequence of names; what one side lacks is optional."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if _same(x[i], y[j]) else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if _same(x[i], y[j]):
            out.append(_merged(x[i], y[j]))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            out.append({**x[i], "o": True})
            i += 1
        else:
            out.append({**y[j], "o": True})
            j += 1
    out += [{**p, "o": True} for p in x[i:]] + [{**p, "o": True} for p in y[j:]]
    return _squeezed(out)


def _mass(part: dict) -> int:
    """Characters in text slots below, apart from what is marked."""
    if "n" not in part:
        return part["c"] if part["t"] is None else 0
    return 0 if part["a"] else sum(map(_mass, part["k"]))


def content_paths(wrapper: dict) -> tuple[list[str], list[str]]:
    """What the wrapper says about main text: paths of elements that hold it, and constant texts.

    Elements marked as main text hold it, all of them (nested ones once). Without any, the whole page holds it, less the texts that are the same
    on every page, and these are named.
    """
    found: list[str] = []
    fixed: list[str] = []

    def walk(part: dict, path: str) -> None:
        if "n" not in part:
            if part["t"] is not None and not part.get("o"):
                fixed.append(part["t"])
            return
        if part["a"]:
            return
        path = f"{path}/{part['n']}"
        if part["m"]:
            found.append(path)
            return
        for p in part["k"]:
            walk(p, path)

    walk(wrapper, "")
    if found:
        return found, []
    varies = _mass(wrapper) > 0
    return [""], sorted(set(fixed)) if varies else []


def extract(page: Node, paths: list[str], fixed: list[str]) -> str:
    """Texts of the page in the elements the wrapper names, in order; blocks joined by one space."""
    wanted, constant, out = set(paths), set(fixed), []

    def take(node: Node) -> None:
        for part in node.parts:
            if isinstance(part, str):
                if not constant or _constant(part) not in constant:
                    out.append(part)
            elif part.tag in RAW or part.apart:
                if part.tag not in INLINE:
                    out.append(" ")
            elif part.tag in INLINE:
                take(part)
            else:
                out.append(" ")
                take(part)
                out.append(" ")

    def walk(node: Node, path: str) -> bool:
        if node.apart:
            return False
        if node.tag not in INLINE:  # wrappers don't name inline elements
            path = f"{path}/{node.name}"
        if path in wanted:
            take(node)
            out.append(" ")
            return True
        return any([walk(p, path) for p in node.parts if isinstance(p, Node)])

    if "" in wanted:
        take(page)
    else:
        walk(page, "")
    # References are decoded after the markup is gone, so that they never become markup.
    return " ".join(html.unescape("".join(out)).split())


def page_text(page: str, paths: list[str] | None, fixed: list[str] | None) -> str:
    """Main text by the host's wrapper; by the page's own one where that finds nothing."""
    tree = parse(page)
    found = extract(tree, paths, fixed or []) if paths else ""
    return found or extract(tree, *content_paths(expression(tree)))


_PARTIAL = "host string, part int, wrapper string, pages long"


def _folded(rows: Iterator[tuple[str, int]]) -> tuple[dict, int]:
    total, pages = None, 0
    for text, n in rows:
        wrapper = json.loads(text)
        total = wrapper if total is None else _merged(total, wrapper)
        pages += n
    return total, pages


def infer_wrappers(pages: DataFrame, html_col: str = "html", groups: int = 64) -> DataFrame:
    """Rows (host, wrapper as JSON, pages) from pages with ``host`` and whole HTML texts.

    Every task aligns its pages of a host, one after another, so a host with a third of all pages
    is one wrapper for each task; these are aligned in ``groups``, then the groups' wrappers.
    """
    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[dict, int]] = {}
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                own = expression(parse(page or ""))
                if host in found:
                    wrapper, n = found[host]
                    found[host] = (_merged(wrapper, own), n + 1)
                else:
                    found[host] = (own, 1)
        rows = [(h, zlib.crc32(json.dumps(w).encode()) % groups, json.dumps(w), n) for h, (w, n) in found.items()]
        yield pd.DataFrame(rows, columns=["host", "part", "wrapper", "pages"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("wrapper")
        wrapper, n = _folded(zip(rows["wrapper"], rows["pages"], strict=True))
        return pd.DataFrame({"host": rows["host"].iloc[:1].to_numpy(), "part": [0], "wrapper": [json.dumps(wrapper)], "pages": [n]})

    partial = pages.select("host", F.col(html_col).alias("html")).mapInPandas(infer, _PARTIAL)
    grouped = partial.groupBy("host", "part").applyInPandas(fold, _PARTIAL)
    return grouped.groupBy("host").applyInPandas(fold, _PARTIAL).select("host", "wrapper", "pages")


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id, url, text, n_chars`` for each row of ``pages``: the main text of the whole HTML.

    Wrappers are inferred for each host (pages without one share the empty host) and say which
    elements of its pages hold main text (:func:`content_paths`). From each page the texts in these
    elements are taken in order, less navigation, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments in them (known by their names, classes, ids and roles).
    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one space. A page on which its host's wrapper finds nothing has a wrapper of its own.
    Null and empty pages give an empty text; repeated rows give equal rows; an empty table gives no
    rows; other columns are not read.
    """
    host, _ = split_url(F.col(url_col))
    hosted = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    wrappers = infer_wrappers(hosted)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [content_paths(json.loads(w)) for w in batch["wrapper"]]
            yield pd.DataFrame({"host": batch["host"], "paths": [p for p, _ in found], "fixed": [f for _, f in found]})

    plans = stored(wrappers.mapInPandas(plan, "host string, paths array<string>, fixed array<string>"), "plans")
    schema = T.StructType([
        T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                page_text(page, list(paths) if paths is not None else None, list(fixed) if fixed is not None else None) if page else ""
                for page, paths, fixed in zip(batch["html"], batch["paths"], batch["fixed"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return hosted.join(plans, "host", "left").select("id", "url", "html", "paths", "fixed").mapInPandas(work, schema)
