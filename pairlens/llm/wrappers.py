"""Main-text extraction by wrappers inferred per host.

A wrapper is a union-free regular expression over tag tokens: a sequence of
items that may be optional ``?``, repeated ``+`` or part of a repeated group,
with text slots ``#`` at the leaves.  Pages of one host are aligned one after
another: a tag that only one side has becomes optional, siblings that come
again fold into a repeated item or group, and a text that differs becomes a
slot.  Aligning is done on whole wrappers too, so every partition infers its
own and the partial wrappers of a host are aligned in a second and third step.

The finished wrapper says which slots are the article: those under the host's
content element and under no menu, notice, advert, form or comment item.  A
page's text is read off by matching the page against its host's wrapper.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial wrappers of one host are merged in this many groups before the last merge.
MERGE_GROUPS = 32

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style|textarea|title|iframe|xmp)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)
      | <(/?)([a-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>
      | <[!?/][^>]*(?:>|\Z)
      | <[a-z][^>]*(?:>|\Z)""",
    re.VERBOSE | re.IGNORECASE | re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark
    nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Elements that are never part of an article, wherever they stand.
NEVER = frozenset("""head nav footer aside form noscript template svg button select datalist menu dialog
    object canvas audio video map frameset""".split())
#: Words in class, id or role that say the same.
NEVER_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored
    promo promotion promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead
    comment comments commentlist disqus reply replies discussion cookie cookies consent gdpr notice notices
    notification alert popup modal overlay newsletter subscribe subscription signup login share sharing
    social related recommended recommendations pagination pager widget toolbar skip contentinfo complementary
    search paywall""".split())
#: Words and elements that mark the article, best first.
CONTENT = ("article", "main", "content", "post", "entry", "story")
_PAGE_HEADER = frozenset(["header"])
_KEY_WORDS = NEVER_WORDS | frozenset(CONTENT) | _PAGE_HEADER
#: An open element of the key closes when one of these starts, unless a border is between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("thead", "tbody")}
_BORDER = frozenset("ul ol dl table article section div body".split())
#: Open elements at once; what is nested deeper lies beside the last of them.
DEEP = 150


class Element:
    """A block of a page; ``parts`` are its blocks and its texts as (text, linked characters)."""

    __slots__ = ("tag", "words", "parts")

    def __init__(self, tag: str, words: tuple[str, ...] = ()):
        self.tag, self.words, self.parts = tag, words, []

    def key(self) -> str:
        if self.words or self.tag not in ("div", "section", "span"):
            return ".".join((self.tag, *self.words))
        # Nothing tells plain containers apart but what they hold.
        inner = sorted({p.tag if isinstance(p, Element) else "#" for p in self.parts})
        return f"{self.tag}[{','.join(inner)}]"


def _words(attributes: str) -> tuple[str, ...]:
    found = set()
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            if name.lower() == "hidden":
                found.add("notice")
            else:
                found.update(w for w in _WORD.findall((a or b or c).lower()) if w in _KEY_WORDS)
    return tuple(sorted(found))


def parse(page: str | None) -> Element:
    """The blocks of a page.  Any text parses: unclosed, stray and cut tags are taken as browsers take them."""
    root = Element("html")
    stack, run, links, linked, deeper = [root], [], 0, 0, 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1].parts.append((text, linked))
            run.clear()
        linked = 0

    at, page = 0, page or ""
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text = entities.unescape(page[at:token.start()])
            run.append(text)
            if links:
                linked += len(text)
        at = token.end()
        name = token.group(3)
        if not name:
            continue
        name, closing = name.lower(), token.group(2)
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                run.append(" ")
            continue
        if closing:
            if deeper:
                flush()
                deeper -= 1
            elif any(e.tag == name for e in stack[1:]):
                flush()
                while stack.pop().tag != name:
                    pass
            continue
        flush()
        if name in ("html", "body"):
            while len(stack) > 1 and stack[-1].tag == "head":
                stack.pop()
            if name == "html" or any(e.tag == "body" for e in stack):
                continue
        if stack[-1].tag == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in _CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i].tag in _BORDER:
                break
        if len(stack) > DEEP:
            stack.pop()
            deeper += 1
        element = Element(name, _words(token.group(4)))
        stack[-1].parts.append(element)
        if not token.group(4).endswith("/") or name not in ("path", "circle", "rect"):
            stack.append(element)
        links = 0
    if at < len(page):
        run.append(entities.unescape(page[at:]))
    flush()
    return root


class Item:
    """One item of a wrapper: a tag with its own items, or a text slot (key ``#``)."""

    __slots__ = ("key", "optional", "repeated", "grouped", "fixed", "chars", "linked", "items", "keep", "plain")

    def __init__(self, key: str):
        self.key, self.items = key, {}
        self.optional = self.repeated = self.grouped = False
        self.fixed: str | None = None
        self.chars = self.linked = 0
        self.keep = self.plain = False

    def dump(self) -> list:
        return [self.key, self.optional * 4 + self.repeated * 2 + self.grouped, self.fixed, self.chars, self.linked,
                [x.dump() for x in self.items.values()]]

    @staticmethod
    def load(data: list) -> Item:
        item = Item(data[0])
        item.optional, item.repeated, item.grouped = bool(data[1] & 4), bool(data[1] & 2), bool(data[1] & 1)
        item.fixed, item.chars, item.linked = data[2:5]
        for x in data[5]:
            item.items[x[0]] = Item.load(x)
        return item

    def pattern(self) -> str:
        """The wrapper as a regular expression over tags, for people."""
        if self.key == "#":
            body = "#text" if self.fixed is None else "text"
        else:
            parts, group = [], []
            for x in [*self.items.values(), None]:
                if x is not None and x.grouped:
                    group.append(x.pattern())
                    continue
                if group:
                    parts.append("(" + " ".join(group) + ")+")
                    group = []
                if x is not None:
                    parts.append(x.pattern())
            body = f"{self.key}({' '.join(parts)})"
        return body + "+" * (self.repeated and not self.grouped) + "?" * self.optional


def _fingerprint(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:8]


def wrapper_of(element: Element) -> Item:
    """The wrapper that one page is: equal siblings fold into repeated items and groups."""
    out = Item(element.key())
    order: list[str] = []
    last = None
    for part in element.parts:
        if isinstance(part, Element):
            item = wrapper_of(part)
        else:
            item = Item("#")
            item.fixed, item.chars, item.linked = _fingerprint(part[0]), len(part[0]), part[1]
        known = out.items.get(item.key)
        if known is None:
            out.items[item.key] = item
            order.append(item.key)
        else:
            if last != item.key:  # what lies between comes again with it
                for key in order[order.index(item.key):]:
                    out.items[key].grouped = True
            _align(known, item)
            known.repeated = True
        last = item.key
    return out


def _align(a: Item, b: Item) -> None:
    """Make ``a`` match whatever ``b`` matches too."""
    if a.fixed != b.fixed:
        a.fixed = None
    a.chars += b.chars
    a.linked += b.linked
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.grouped |= b.grouped
    place = {key: i for i, key in enumerate(a.items)}
    new: list[tuple[int, Item]] = []  # items of b alone, by the item of a that they follow
    at, crossed = -1, None
    for key, item in b.items.items():
        known = a.items.get(key)
        if known is None:
            item.optional = True
            new.append((at, item))
            continue
        if place[key] < at:  # the two orders differ: the stretch is a repeated group
            crossed = (min(place[key], crossed[0]), max(at, crossed[1])) if crossed else (place[key], at)
        at = max(at, place[key])
        _align(known, item)
    for key, item in a.items.items():
        if key not in b.items:
            item.optional = True
        if crossed and crossed[0] <= place[key] <= crossed[1]:
            item.grouped = True
    if new:
        merged: list[tuple[float, int, Item]] = [(place[k], 0, x) for k, x in a.items.items()]
        merged += [(at, 1 + i, x) for i, (at, x) in enumerate(new)]
        merged.sort(key=lambda x: x[:2])
        a.items = {x.key: x for _, _, x in merged}


def align(wrappers: Iterator[Item]) -> Item:
    """One wrapper that matches what each of ``wrappers`` matches."""
    out = None
    for w in wrappers:
        if out is None:
            out = w
        else:
            _align(out, w)
    return out


def _tag(key: str) -> str:
    return re.split(r"[.\[]", key, maxsplit=1)[0]


def _named(key: str) -> set[str]:
    return set() if "[" in key else set(key.split(".")[1:])


def _never(key: str) -> bool:
    return _tag(key) in NEVER or bool(_named(key) & NEVER_WORDS)


def decide(wrapper: Item) -> Item:
    """Mark the slots that are the article (``keep``) and those to take from pages without one (``plain``)."""
    best = {}

    def rank(item: Item) -> int | None:
        if _tag(item.key) in CONTENT[:2]:
            return CONTENT.index(_tag(item.key))
        return min((CONTENT.index(w) for w in _named(item.key) if w in CONTENT), default=None)

    def size(item: Item) -> int:
        return item.chars if item.key == "#" else sum(size(x) for x in item.items.values() if not _never(x.key))

    def survey(item: Item) -> None:
        for x in item.items.values():
            if not _never(x.key):
                if (r := rank(x)) is not None:
                    best[r] = best.get(r, 0) + size(x)
                survey(x)

    survey(wrapper)
    # The best mark under which there is any text.
    chosen = min((r for r, n in best.items() if n), default=None)

    def mark(item: Item, inside: bool, barred: bool) -> None:
        for x in item.items.values():
            if x.key == "#":
                x.keep = inside and not barred
                x.plain = not barred and x.linked * 2 <= x.chars
                continue
            within = inside or (not barred and chosen is not None and rank(x) == chosen)
            out = barred or _never(x.key) or (not within and (_tag(x.key) == "header" or "header" in _named(x.key)))
            mark(x, within and not out, out)

    mark(wrapper, False, False)
    return wrapper


def extract(page: Element, wrapper: Item) -> str:
    """The article of ``page``, whose host has the decided ``wrapper``."""
    kept: list[str] = []
    plain: list[str] = []

    def walk(element: Element, item: Item | None) -> None:
        for part in element.parts:
            slot = item.items.get(part.key() if isinstance(part, Element) else "#") if item else None
            if isinstance(part, Element):
                if slot is not None:
                    walk(part, slot)
            elif slot is not None:
                if slot.keep:
                    kept.append(part[0])
                if slot.plain:
                    plain.append(part[0])

    walk(page, wrapper)
    return "\n".join(kept or plain)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hosts: dict[str, Item] = {}
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"]):
            w = wrapper_of(parse(page))
            if host in hosts:
                _align(hosts[host], w)
            else:
                hosts[host] = w
    yield pd.DataFrame({"host": list(hosts), "wrapper": [json.dumps(w.dump()) for w in hosts.values()]},
                       columns=["host", "wrapper"], dtype=object)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    one = align(Item.load(json.loads(w)) for w in sorted(group["wrapper"]))
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(one.dump())]})


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).withColumn("host", host)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) with one wrapper per host, inferred from all of its pages.

    Each partition sends one wrapper per host, equal ones are sent on once, and
    a host's are merged in ``MERGE_GROUPS`` groups first: a host with most of
    the pages costs no task more than its share.
    """
    schema = "host string, wrapper string"
    partial = _with_host(pages).select("host", "html").mapInPandas(_partial, schema).distinct()
    group = F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_GROUPS))
    return (partial.groupBy("host", group.alias("part")).applyInPandas(_merge, schema)
            .groupBy("host").applyInPandas(_merge, schema))


def extract_pages(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty html, or a page without article text, gives an empty text.
    Pages without a readable host share one wrapper.  Null ids, repeated rows
    and pages of a host seen once are kept like any other; an empty table gives
    an empty result; columns of other names are ignored.
    """
    def run(batches):
        decided: dict[str, Item] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch["html"], batch["wrapper"]):
                if wrapper not in decided:
                    if len(decided) > 1000:
                        decided.clear()
                    decided[wrapper] = decide(Item.load(json.loads(wrapper)))
                texts.append(extract(parse(page), decided[wrapper]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    joined = _with_host(pages).join(wrappers, "host").select("page_id", "url", "html", "wrapper")
    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
