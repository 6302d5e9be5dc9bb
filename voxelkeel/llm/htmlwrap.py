"""Main text of web pages by union-free regular expressions, one wrapper per host.

A page is read into a stream of element and text tokens with implied ends put in. Every element's
children are a sequence; tandem repeats in it (up to ``LONGEST_PERIOD`` tokens) become repeated groups, text becomes a
slot. The streams of a host are then aligned one after another: tokens that both have are joined, element by
element, what only one has becomes optional, and new repeats are folded. The outcome, a regular expression
without alternatives over tags, slots, optional and repeated groups, accepts every page of the host.

Slots carry totals over the host's pages: pages, characters, characters in links, and whether the text is
always the same. They say which part is the article: the ``article`` or ``main`` element where there is one
that is no teaser or comment, otherwise the element in which most of the running text lies. Menus, headers, footers,
sidebars, notices, adverts, forms and comments inside it are cut by their element or class, lists of links by
their share of link text, and slots that say the same on all of many pages while others change.

On Spark: a pass over the pages yields streams and slot totals, added up in the tasks and then per (host,
stream) and (host, slot); hosts are dealt over tasks and each task folds the distinct streams of one host after
another, most frequent first, so that results do not depend on how pages lie in partitions. Pages meet the
wrapper of their host in a join that keeps hot hosts where they are.

Defined results: null html is empty; a page without text has an empty text; a null or odd url belongs to the host
of no name; repeated rows are extracted row by row; an empty table gives no row; other columns are
ignored, whatever their names; pages of any length are read whole; elements nested over ``DEEPEST`` deep
count as part of the element at that depth.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import join_keeping_hot, shuffle_partitions, staged

LONGEST_PERIOD, DEEPEST = 4, 60
#: Hosts whose streams a task adds up before it passes them on.
WAITING_FACTS = 50_000
#: A slot is template text when it says the same on at least so many pages.
SAME_ON = 5

# Elements by how a browser reads them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
# What an element or a word of its class says.
BOILERPLATE_TAGS = frozenset("nav header footer aside form noscript template object svg canvas audio video button select datalist dialog menu head map".split())
BOILERPLATE_WORDS = frozenset("nav navbar navigation menu topbar header masthead footer sidebar aside ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus discussion related recommended teaser share sharing social breadcrumb breadcrumbs pagination pager toolbar widget search copyright".split())
CONTENT_WORDS = ("article", "main", "content", "entry", "post", "story", "body", "text")
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "search", "main": "main", "dialog": "modal", "alert": "alert", "article": "article"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/\"'>]+)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=20_000)
def label_of(name: str, attributes: str) -> tuple[str, bool]:
    """The token of an element, ``name`` or ``name.word``, and whether it is not shown."""
    if not attributes.strip(" />"):
        return name, False
    found = {}
    for key, value, bare in _ATTRIBUTE.findall(attributes.rstrip(">")):
        found.setdefault((key or bare).lower(), value.strip("\"'"))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    role = ROLES.get(found.get("role", "").lower()) or ("article" if "articlebody" in found.get("itemprop", "").lower() else None)
    named = " ".join(html.unescape(found.get(k, "")) for k in ("class", "id"))
    words = [w.lower() for w in _WORDS.findall(named)]
    word = role or next((w for w in words if w in BOILERPLATE_WORDS), None) or next((w for w in CONTENT_WORDS if w in words), None)
    if word is None and name not in INLINE:
        word = next((t.lower() for t in named.split() if t.isalpha() and t.isascii() and len(t) <= 24), None)
    if name in INLINE and word not in BOILERPLATE_WORDS:
        word = None
    return (f"{name}.{word}" if word else name), hidden


def read_page(page: str) -> Iterator[tuple[str, str]]:
    """Events of a page in order: ("open", label), ("close", label), ("text", decoded), ("space", ""), ("link", "1" or "").

    Only elements that break lines or are named like boilerplate open and close; what is not shown is left out.
    """
    stack: list[tuple[str, str | None, bool]] = []  # name, label if it is a token, shown
    hidden = at = 0

    def close(depth: int) -> Iterator[tuple[str, str]]:
        nonlocal hidden
        while len(stack) > depth:
            name, label, shown = stack.pop()
            if not shown:
                hidden -= 1
            elif label is not None and not hidden:
                yield "close", label
            if name == "a":
                yield "link", ""

    def depth_of(names: set[str] | frozenset[str], stops: set[str] | frozenset[str] = frozenset()) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stops:
                return None
        return None

    for match in _MARKUP.finditer(page):
        if match.start() < at:
            continue
        if match.start() > at and not hidden:
            yield "text", html.unescape(page[at : match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        if match[1]:
            depth = depth_of({name})
            if depth is not None:
                yield from close(depth)
            elif name not in INLINE:
                yield "space", ""
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if name == "textarea":
                yield "space", ""
            continue
        if name not in IN_HEAD and stack and (depth := depth_of({"head"})) is not None:
            yield from close(depth)
        if name in CLOSES_P and (depth := depth_of({"p"}, frozenset({"table", "td", "th", "button"}))) is not None:
            yield from close(depth)
        if name in CLOSED_BY and (depth := depth_of(*CLOSED_BY[name])) is not None:
            yield from close(depth)
        if name in VOID:
            if name not in ("img", "input", "wbr"):
                yield "space", ""
            continue
        if name == "a" and (depth := depth_of({"a"}, CLOSES_P)) is not None:
            yield from close(depth)
        label, unseen = label_of(name, match[3])
        token = label if name not in INLINE or "." in label else None
        stack.append((name, token, not unseen))
        if unseen:
            hidden += 1
        elif token is not None and not hidden:
            yield "open", token
        if name == "a":
            yield "link", "1"
    if at < len(page) and not hidden:
        yield "text", html.unescape(page[at:])
    yield from close(0)


# Streams as nested sequences: an item is (token, may be absent, may repeat, items inside).
SLOT = ("#", False, False, ())
#: Items over this many in one sequence are joined to one repeated group in which each may be absent.
LONGEST_SEQUENCE = 64
LOOSE = "(*)"


def _group(items: tuple) -> str:
    return "(" + " ".join(x[0] for x in items) + ")"


def _joined(a: tuple, b: tuple) -> tuple:
    """One item for two of the same token, of which a page has one or the other."""
    inside = a[3] if a[3] == b[3] else _loose(a[3] + b[3]) if a[0] == LOOSE else tuple(map(_joined, a[3], b[3])) if a[0][0] == "(" else align(a[3], b[3])
    return a[0], a[1] or b[1], a[2] or b[2], inside


def _in_a_row(a: tuple, b: tuple) -> tuple:
    """One item for two of the same token that follow one another."""
    token, _, _, inside = _joined(a, b)
    return token, a[1] and b[1], token != "#", inside


def _loose(items: tuple) -> tuple:
    found: dict[str, tuple] = {}
    for item in items:
        for x in item[3] if item[0] == LOOSE else (item,):
            found[x[0]] = _joined(found[x[0]], x) if x[0] in found else x
    return tuple((t, True, r, inside) for t, _, r, inside in sorted(found.values(), key=lambda x: x[0]))


class Sequence:
    """Items in order with tandem repeats folded as they come."""

    def __init__(self):
        self.items: list[tuple] = []

    def push(self, item: tuple) -> None:
        items = self.items
        if len(items) == 1 and items[0][0] == LOOSE:
            items[0] = (LOOSE, False, True, _loose((items[0], item)))
            return
        items.append(item)
        while self._fold():
            pass
        if len(items) > LONGEST_SEQUENCE:
            items[:] = [(LOOSE, False, True, _loose(tuple(items)))]

    def _fold(self) -> bool:
        items = self.items
        if len(items) > 1 and items[-1][0] == items[-2][0]:
            items[-2:] = [_in_a_row(items[-2], items[-1])]
            return True
        for period in range(1, LONGEST_PERIOD + 1):
            tail = items[-period:]
            if len(items) <= period or any(x[0][0] == "(" for x in tail):
                return False
            before = items[-period - 1]
            if before[0][0] == "(" and before[0] == _group(tail):
                items[-period - 1 :] = [(before[0], before[1], True, tuple(map(_joined, before[3], tail)))]
                return True
            if period == 1 and before[0][0] == "(" and before[0] != LOOSE and before[3][-1][0] == tail[0][0]:
                last = _in_a_row(before[3][-1], tail[0])
                items[-2:] = [(*before[:3], (*before[3][:-1], (last[0], before[3][-1][1], *last[2:])))]
                return True
            if period > 1 and len(items) >= 2 * period and [x[0] for x in items[-2 * period : -period]] == [x[0] for x in tail]:
                inside = tuple(map(_joined, items[-2 * period : -period], tail))
                items[-2 * period :] = [(_group(inside), False, True, inside)]
                return True
        return False


def _regrouped(items: tuple, groups: dict[str, int]) -> list[tuple]:
    """``items`` with runs that are one turn of a known group put into it."""
    out = list(items)
    for name, size in groups.items():
        k = 0
        while k + size <= len(out):
            if _group(out[k : k + size]) == name:
                out[k : k + size] = [(name, False, False, tuple(out[k : k + size]))]
            k += 1
    return out


def align(a: tuple, b: tuple) -> tuple:
    """A sequence that covers both: the longest run of common tokens joined, all others optional, new repeats folded."""
    if a == b:
        return a
    if any(len(x) == 1 and x[0][0] == LOOSE for x in (a, b)):
        return ((LOOSE, any(not x for x in (a, b)) or any(x[0][1] for x in (a, b) if len(x) == 1), True, _loose(a + b)),)
    groups = {x[0]: len(x[3]) for x in (*a, *b) if x[0][0] == "("}
    if groups:
        a, b = _regrouped(a, groups), _regrouped(b, groups)
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = Sequence(), 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.push(_joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and longest[i + 1][j] >= longest[i][j + 1]):
            out.push((a[i][0], True, *a[i][2:]))
            i += 1
        else:
            out.push((b[j][0], True, *b[j][2:]))
            j += 1
    return tuple(out.items)


class Page:
    """The stream of a page and what its slots hold: path -> [characters, characters in links, checksum of the text]."""

    def __init__(self, page: str):
        self.slots: dict[str, list[int]] = {}
        labels: list[str] = []
        open_items = [Sequence()]
        path, linked, waiting = "", 0, False
        for kind, value in read_page(page):
            if kind == "text":
                shown = value.split()
                if shown:
                    size = sum(map(len, shown))
                    slot = self.slots.setdefault(path, [0, 0, 0])
                    slot[0] += size
                    slot[1] += size if linked else 0
                    slot[2] = zlib.crc32(" ".join(shown).encode("utf-8", "replace"), slot[2])
                    waiting = True
            elif kind == "link":
                linked += 1 if value else -1
            elif kind == "open":
                labels.append(value)
                if len(labels) <= DEEPEST:
                    if waiting:
                        open_items[-1].push(SLOT)
                        waiting = False
                    open_items.append(Sequence())
                    path = "/".join(labels)
            elif kind == "close":
                labels.pop()
                if len(labels) < DEEPEST:
                    if waiting:
                        open_items[-1].push(SLOT)
                        waiting = False
                    inside = tuple(open_items.pop().items)
                    open_items[-1].push((value, False, False, inside))
                    path = "/".join(labels)
        if waiting:
            open_items[-1].push(SLOT)
        self.stream = tuple(open_items[0].items)


def _frozen(items: list) -> tuple:
    return tuple((t, o, r, _frozen(inside)) for t, o, r, inside in items)


# What of a wrapper is the article.

def _is_boilerplate(label: str) -> bool:
    tag, _, word = label.partition(".")
    return tag in BOILERPLATE_TAGS or word in BOILERPLATE_WORDS


def _is(label: str, what: str) -> bool:
    return what in label.split(".") and not _is_boilerplate(label)


class Element:
    """A path of the wrapper with the totals of its slots and of what lies under it."""

    def __init__(self, label: str, path: str):
        self.label, self.path = label, path
        self.inside: dict[str, Element] = {}
        self.own = [0, 0, 0, 0, 0]  # pages, characters, characters in links, least and greatest checksum
        self.running = 0

    def grow(self, items: tuple) -> None:
        for token, _, _, inside in items:
            if token[0] == "(":
                self.grow(inside)
            elif token != "#":
                child = self.inside.setdefault(token, Element(token, f"{self.path}/{token}" if self.path else token))
                child.grow(inside)

    def add_up(self, totals: dict[str, list[int]]) -> int:
        self.own = totals.get(self.path, self.own)
        self.running = self.own[1] - self.own[2] + sum(x.add_up(totals) for x in self.inside.values())
        return self.running

    def walk(self) -> Iterator[Element]:
        yield self
        for x in self.inside.values():
            yield from x.walk()


CONTAINERS = frozenset("html body div section main article center table tbody tr td form span".split())


def article_rule(wrapper: tuple, totals: dict[str, list[int]]) -> dict[str, list[str]]:
    """Paths under which the article lies (``roots``) and paths within them that are cut."""
    top = Element("", "")
    top.grow(wrapper)
    whole = top.add_up(totals)

    def blocked(x: Element) -> bool:
        if not _is_boilerplate(x.label):
            return False
        tag = x.label.partition(".")[0]
        if tag in BOILERPLATE_TAGS and tag != "form":
            return True
        # a name such as "page-with-sidebar", or a form, around the whole page
        around = any(_is(y.label, "article") or _is(y.label, "main") or (y.label.partition(".")[0] == "h1" and 2 * x.running > whole) for y in x.walk() if y is not x)
        return not around and 10 * x.running <= 9 * whole

    def named(x: Element, what: str) -> Iterator[Element]:
        if _is(x.label, what):
            yield x
        elif not blocked(x):
            for y in x.inside.values():
                yield from named(y, what)

    articles, mains = list(named(top, "article")), list(named(top, "main"))
    roots = articles if 5 * sum(x.running for x in articles) >= sum(x.running for x in mains) and articles else mains
    if not roots:
        root = top
        while True:
            heirs = [x for x in root.inside.values() if x.label.partition(".")[0] in CONTAINERS and not blocked(x) and 2 * x.running > root.running]
            if not heirs:
                break
            root = heirs[0]
        roots = [root]
    cut: list[str] = []
    kept: list[Element] = []

    def visit(x: Element, within: bool) -> None:
        header = within and x.label == "header" and (articles or mains)
        if within and blocked(x) and not header:
            cut.append(x.path)
            return
        kept.append(x)
        for y in x.inside.values():
            visit(y, True)

    for root in roots:
        visit(root, False)
    slots = [x for x in kept if x.own[1]]
    varied = any(x.own[3] != x.own[4] for x in slots)
    drop = []
    for x in slots:
        pages, size, linked, low, high = x.own
        tag = x.label.partition(".")[0]
        if (10 * linked > 6 * size and tag in ("li", "ul", "ol", "div", "td", "span")) or (varied and pages >= SAME_ON and low == high):
            drop.append(x.path)
    return {"roots": sorted(x.path for x in roots), "cut": sorted(cut), "drop": sorted(drop)}


def main_text(page: str, rule: dict[str, list[str]]) -> str:
    """The text of ``page`` that ``rule`` takes for the article: white space as one space, blocks joined by one."""
    roots, cut, drop = set(rule["roots"]), set(rule["cut"]), set(rule["drop"])
    labels: list[str] = []
    paths, taken = [""], ["" in roots]
    parts: list[str] = []
    for kind, value in read_page(page):
        if kind == "text":
            if taken[-1] and paths[-1] not in drop:
                parts.append(value)
        elif kind == "open":
            labels.append(value)
            path = "/".join(labels) if len(labels) <= DEEPEST else paths[-1]
            paths.append(path)
            taken.append((taken[-1] or path in roots) and path not in cut)
            parts.append(" ")
        elif kind == "close":
            labels.pop()
            paths.pop()
            taken.pop()
            parts.append(" ")
        elif kind == "space":
            parts.append(" ")
    return " ".join("".join(parts).split())


# On Spark.

FACTS = "host string, kind int, key string, pages long, chars long, linked long, low long, high long"
RULES = "host string, pages long, wrapper string, rule string"
TEXT = "page_id long, url string, text string, n_chars long"


def host_of(url: Column) -> Column:
    """The host of a url in lower case; an empty string for a url that names none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_facts(pages: DataFrame) -> DataFrame:
    """Distinct streams of each host (kind 0) and totals of each of its slots (kind 1), over ``pages`` (host, html)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple[str, int, str], list[int]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, *v) for k, v in waiting.items()], columns=[c.split()[0] for c in FACTS.split(", ")])
            waiting.clear()
            return out

        def add(key: tuple[str, int, str], chars: int, linked: int, check: int) -> None:
            old = waiting.get(key)
            if old is None:
                waiting[key] = [1, chars, linked, check, check]
            else:
                old[:] = old[0] + 1, old[1] + chars, old[2] + linked, min(old[3], check), max(old[4], check)

        for batch in batches:
            for host, page in zip(batch.host, batch.html):
                read = Page(page)
                add((host, 0, json.dumps(read.stream, separators=(",", ":"))), 0, 0, 0)
                for path, slot in read.slots.items():
                    add((host, 1, path), *slot)
                if len(waiting) > WAITING_FACTS:
                    yield flush()
        yield flush()

    facts = pages.mapInPandas(read, FACTS)
    return facts.groupBy("host", "kind", "key").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high"))


def infer_wrappers(facts: DataFrame) -> DataFrame:
    """One wrapper per host and the rule of what of it is the article."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, wrapper, n, totals = None, None, 0, {}
        out: list[tuple] = []

        def end() -> None:
            if host is not None:
                out.append((host, n, json.dumps(wrapper or (), separators=(",", ":")), json.dumps(article_rule(wrapper or (), totals))))

        for batch in batches:
            for fact in batch.itertuples(index=False):
                if fact.host != host:
                    end()
                    host, wrapper, n, totals = fact.host, None, 0, {}
                if fact.kind == 0:
                    stream = _frozen(json.loads(fact.key))
                    wrapper = stream if wrapper is None else align(wrapper, stream)
                    n += fact.pages
                else:
                    totals[fact.key] = [fact.pages, fact.chars, fact.linked, fact.low, fact.high]
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RULES.split(", ")])
                out.clear()
        end()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RULES.split(", ")])

    dealt = facts.repartition(shuffle_partitions(facts.sparkSession), "host")
    return dealt.sortWithinPartitions("host", "kind", F.desc("pages"), "key").mapInPandas(infer, RULES)


@lru_cache(maxsize=2000)
def _rule(text: str) -> dict[str, list[str]]:
    return json.loads(text)


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text of the article and its length in code points."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    wrappers = staged(infer_wrappers(host_facts(read.select("host", "html"))), "wrappers").select("host", "pages", "rule")
    total = wrappers.agg(F.sum("pages")).first()[0] or 0

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(page, _rule(rule)) for page, rule in zip(batch.html, batch.rule)]
            yield pd.DataFrame({"page_id": batch.page_id.astype("Int64"), "url": batch.url, "text": text, "n_chars": list(map(len, text))})

    return join_keeping_hot(read, wrappers, "host", "pages", total).select("page_id", "url", "html", "rule").mapInPandas(extract, TEXT)
