"""Main text of web pages: markup as evidence, and a host suffix array that decides about what repeats.

A page is cut into blocks at block-level tags. Scripts, styles, forms, navigation, headers, footers, sidebars, notices,
adverts and reader comments go by element, role, class or id. If the page marks its article (``article``, else ``main``),
the blocks inside are its text, in order; else its open blocks are. Of several articles the largest counts, and with it those of at least half its
characters; smaller ones are teasers of others. Of an article's own header the headings stay; what else stands there (authors, dates, leads) goes.

The array holds all pages of a host. The words of a page's blocks outside articles form one token stream with a mark between
blocks, and every suffix of it stands under the host and its first ``run`` tokens. Nothing but whole blocks is cut from an
article, so there the suffixes are those at block starts, under all words of their block. Suffixes that are equal so far are
neighbours; they are met by grouping, which Spark aggregates before it shuffles, and a group's size is the number of pages.
Overlapping repeated prefixes join to the long repeated substrings.

* An article's block is boilerplate if at least half of the host's pages, and three, hold it. Such blocks go, unless
  they are half of the article or more: that is a copied article, which stays whole.
* Without a marked article, substrings on at least half of the host's pages, and two, are cut from the open blocks; the unique
  runs between them stay. Pieces of a block shorter than ``run`` words follow what stands around them. If nothing is left, the
  substrings on the fewest pages stay: pages that are copies of each other keep what tells them from the rest of the host.
  Blocks of link text only go.

Null or empty html gives an empty text. A null url or one without a host is a host of its own. Repeated rows stay, and count as
pages like any other. Extra columns do not matter. Blocks and pages may have any length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import bounded, map_rows, plain, stored

RUN, LINKED = 6, 0.8

#: Fixed values of HTML: elements that break a block, and elements without end tags.
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no text of the page. Of those in HIDDEN the end tag may be missing; they then hold nothing.
HIDDEN = frozenset("noscript template svg object canvas annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split()) | HIDDEN
#: Elements and roles that mark page furniture, and words of class names or ids that do: a name does if it holds a word of NAMES and
#: else only words of AROUND and numbers, so that ``ad-box-3`` and ``comments`` do, and ``category-social`` and ``related-work`` do not.
FURNITURE = frozenset("nav footer aside form menu dialog button select option datalist audio video map head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adsense alert alerts advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu"
    " modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
AROUND = frozenset(
    "a area articles bar block body bottom box btn button buttons center col column container content cta desktop element feed footer global group header holder inner inline item items"
    " layer left link links list local main mobile module outer overlay page pane panel post posts primary right row secondary section site slot small stories strip thread top unit wrap wrapper x".split()
)
#: A name also does if this is the last of its words that is neither a number nor of AROUND (``reader-comments``), unless it says what else has one (``has-sidebar``). Ids are often made of
#: headings, so that theirs do only after one of OWNERS.
HEADS = frozenset(
    "ads advert adverts advertisement advertisements advertising adsense breadcrumb breadcrumbs comments cookies disqus footer gdpr masthead navbar navigation newsletter paywall popup sidebar sponsored".split()
)
STATES = frozenset("has have is with without no hide show hides shows toggle".split())
OWNERS = frozenset("ad article articles blog entry facebook fb google guest page post posts reader readers site user users visitor web wp".split())
#: Classes of inline elements that are adverts.
ADS = frozenset("ad ads advert advertisement advertising adsense".split())
#: Words of names that are about articles and mark none.
NO_ARTICLE = frozenset(
    "actions ad ads archive author byline card cards carousel comment comments date feed footer grid header image images index info latest link links list lists meta more nav navigation other others pager"
    " pagination popular preview previews promo recommended related share sharing sidebar similar slider summary tags teaser teasers thumb thumbnail title toolbar tools".split()
)
HEADERS = frozenset({"header"})
#: Elements that hold text themselves: their names and ids are about their text. Those of NOTED go if a class is a word of NAMES, and no more.
NOTED = frozenset("p blockquote figure figcaption table tr td li dt dd".split())
TEXTS = NOTED | frozenset("h1 h2 h3 h4 h5 h6 pre tbody thead th b i em strong a span code".split())
#: Classes of ``article`` elements that are no articles.
LESSER = frozenset("ad ads advert advertisement comment comments comment-body promo related reply sponsored teaser".split())
#: With ``content`` in a name or id, these mark an article too.
CONTENT_OF = frozenset("article entry main page post story".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z|[^<]+|<", re.S)
_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HEADING = re.compile(r"h[1-6]\Z")
_HOST = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


class Block(NamedTuple):
    text: str
    #: ``article``, ``main``, ``open`` or ``furniture``
    place: str
    #: share of its characters that are link text
    linked: float
    #: which of the page's outermost articles it is in
    part: int = 0


def _names_furniture(name: str, of_class: bool = True) -> bool:
    """Whether one class or id (lower case) does."""
    words = list(filter(None, re.split(r"[^a-z]+", name)))
    parts = set(words)
    if not parts.isdisjoint(NAMES) and parts <= NAMES | AROUND:
        return True
    telling = [w for w in words if w not in AROUND or w in HEADS]
    return bool(telling) and telling[-1] in HEADS and words[0] not in STATES and (of_class or set(telling[:-1]) <= OWNERS)


def _names_article(name: str) -> bool:
    """Whether one class or id (lower case) marks an article."""
    parts = set(re.split(r"[^a-z0-9]+", name))
    return ("article" in parts or "content" in parts and not parts.isdisjoint(CONTENT_OF)) and parts.isdisjoint(NO_ARTICLE)


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """``furniture``, ``article``, ``main`` or nothing: what an element with these attributes opens."""
    named: set[str] = set()
    classes: set[str] = set()
    role = ""
    furniture = body = False
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                role = value.strip()
            elif name in ("class", "id"):
                if name == "class":
                    classes.update(value.split())
                named.update(value.split())
                if tag not in TEXTS:
                    furniture = furniture or any(_names_furniture(x, name == "class") for x in value.split())
                elif tag in NOTED and name == "class":
                    furniture = furniture or not NAMES.isdisjoint(value.split())
            elif name == "itemprop":
                body = body or value.strip() == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return "furniture"
    if tag in ("html", "body"):
        return ""
    if tag == "main" or role == "main":
        return "main"
    if tag == "article" or role == "article" and tag not in FURNITURE:
        return "furniture" if classes & LESSER else "article"
    if tag in FURNITURE or role in ROLES or furniture:
        return "furniture"
    if tag in HEADERS or "header" in classes and not _HEADING.match(tag):
        return "header" if inside else "furniture"
    if tag not in TEXTS and (body or any(map(_names_article, named))):
        return "article"
    if tag == "span" and not classes.isdisjoint(ADS):
        return "mute"
    return ""


def blocks(page: str | None) -> list[Block]:
    """All blocks with text, furniture too."""
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    linked = chars = 0
    links = 0
    #: open elements that matter: [tag, kind, how many of the same tag are open inside]
    stack: list[list] = []
    articles = 0

    def place() -> str:
        kinds = [s[1] for s in stack]
        if "furniture" in kinds:
            return "furniture"
        if "header" in kinds and not any(_HEADING.match(s[0]) for s in stack):
            return "furniture"
        return "article" if "article" in kinds else "main" if "main" in kinds else "open"

    def end_block() -> None:
        nonlocal parts, linked, chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, place(), linked / max(1, chars), articles))
        parts, linked, chars = [], 0, 0

    last: dict[str, int] = {}

    def left_open(tag: str, at: int) -> bool:
        """No end tag of that name follows."""
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", page, re.I)), default=-1)
        return last[tag] < at

    at, scan = 0, _TOKEN.match
    while m := scan(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if (text[0] != "<" or text == "<") and not any(s[1] == "mute" for s in stack):
                parts.append(text)
                chars += len(text)
                linked += len(text) * (links > 0)
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if tag in RAW:
            if not closing and not (tag == "svg" and m[3].endswith("/")):
                if left_open(tag, at):
                    at = at if tag in HIDDEN else len(page)
                else:
                    at = _END[tag].search(page, at).end()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        breaks = tag in BREAKS
        if breaks:
            end_block()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][2]:
                        stack[k][2] -= 1
                    else:
                        if not breaks and stack[k][1] and stack[k][1] != "mute":
                            end_block()
                        del stack[k:]
                    break
            continue
        kind = _kind(tag, m[3], any(s[1] == "article" for s in stack))
        if kind == "main":
            stack[:] = [s for s in stack if s[1] not in ("furniture", "header")]  # these were left open
        elif kind == "article" and any(s[1] in ("furniture", "header") for s in stack):
            # a form around the page is no furniture, nor is what nothing closes
            stack[:] = [s for s in stack if s[1] not in ("furniture", "header") or s[0] != "form" and not left_open(s[0], at)]
        if kind or _HEADING.match(tag):
            if not breaks and kind and kind != "mute":
                end_block()
            articles += kind == "article" and not any(s[1] == "article" for s in stack)
            stack.append([tag, kind, 0])
        else:
            for s in reversed(stack):
                if s[0] == tag:
                    s[2] += 1
                    break
    end_block()
    return out


def own_blocks(found: list[Block]) -> list[int]:
    """The blocks of the marked article, if there is one; of several, those of the largest, and of others that are not much smaller."""
    for where in ("article", "main"):
        own = [k for k, b in enumerate(found) if b.place == where]
        if own:
            sizes = Counter()
            for k in own:
                sizes[found[k].part] += len(found[k].text)
            return [k for k in own if where == "main" or 2 * sizes[found[k].part] >= max(sizes.values())]
    return []


def marked_text(found: list[Block]) -> str | None:
    """The text of the marked article; None if it must be told from the host's other pages."""
    if own := own_blocks(found):
        return "\n".join(found[k].text for k in own)
    return None if any(b.place == "open" for b in found) else ""


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


def stream(found: list[Block]) -> tuple[list[str], list[int]]:
    """The token stream of the blocks outside articles, and the index of each token's block (-1: a mark)."""
    tokens, at = ["\0"], [-1]
    for k, b in enumerate(found):
        if b.place in ("open", "furniture"):
            words = b.text.split(" ")
            tokens += [*words, "\0"]
            at += [k] * len(words) + [-1]
    return tokens, at


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def suffix_keys(found: list[Block], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Keys (64 bits) and places of a page's suffixes: in the stream, from 0 on, by their first ``run`` tokens; -1 - k: at the start of
    the marked article's block k, by all its words."""
    tokens, _ = stream(found)
    own = own_blocks(found)
    keys = [_hash("\1".join(tokens[k : k + run])) for k in range(len(tokens) - run + 1)]
    at = [*range(len(keys)), *(-1 - k for k in own)]
    keys += [_hash("\2" + found[k].text) for k in own]
    return np.array(keys, dtype=np.uint64).view(np.int64), np.array(at, dtype=np.int32)


def least_pages(pages: int, marked: bool) -> int:
    """On how many of a host's pages boilerplate stands at least."""
    return max(3 if marked else 2, ceil(pages / 2))


def told_text(found: list[Block], repeated: Iterable[tuple[int, int]], pages: int, run: int = RUN) -> tuple[str, int]:
    """A page's text and how many words the array cut from it: ``repeated`` are the places of its suffixes that other pages of the
    host have too, with the number of pages; ``pages`` is the host's."""
    if own := own_blocks(found):
        least = least_pages(pages, True)
        gone = {-1 - at for at, n in repeated if at < 0 and n >= least}
        cut = sum(found[k].text.count(" ") + 1 for k in gone)
        if 2 * cut >= sum(found[k].text.count(" ") + 1 for k in own):
            gone, cut = set(), 0
        return "\n".join(found[k].text for k in own if k not in gone), cut
    tokens, at = stream(found)
    most = np.zeros(len(tokens) + run, dtype=np.int64)
    for start, n in repeated:
        if start >= 0:
            most[start : start + run] = np.maximum(most[start : start + run], n)
    asked = np.array([k >= 0 and found[k].place == "open" and found[k].linked < LINKED for k in at])
    most = most[: len(tokens)]
    text, cut = _without(tokens, at, asked, most >= least_pages(pages, False), run)
    if not text and asked.any():
        text, cut = _without(tokens, at, asked, most > most[asked].min(), run)
    return text, cut


def _without(tokens: list[str], at: list[int], asked: np.ndarray, covered: np.ndarray, run: int) -> tuple[str, int]:
    """The asked blocks without their covered tokens, and how many went."""
    made, cut = [], 0
    block = np.array(at)
    edges = np.flatnonzero(np.diff(block, prepend=-2, append=-2)).tolist()
    for start, end in zip(edges, edges[1:]):  # a block's tokens stand together
        if not asked[start]:
            continue
        hit = covered[start:end].copy()
        if not hit.all():  # short pieces of a block: first of the neighbours' repeats, then between what is cut
            for kind in (True, False):
                ends = np.flatnonzero(np.diff(hit.astype(np.int8))) + 1
                for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(hit)]):
                    if b - a < run and b - a < len(hit) and hit[a] == kind:
                        hit[a:b] = not kind
        cut += int(hit.sum())
        if not hit.all():
            made.append(" ".join(t for t, h in zip(tokens[start:end], hit.tolist()) if not h))
    return "\n".join(made), cut


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """The id, the url, ``text`` and ``n_cut`` (words that the array cut) of every page."""
    pages = df.select(
        F.col(plain(id_col)), F.col(plain(url_col)).cast("string").alias("__url"), F.col(plain(html_col)).cast("string").alias("__html"), F.xxhash64(plain(id_col), plain(url_col), plain(html_col)).alias("__tag")
    )

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple] = []
            for url, page, tag in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = blocks(page)
                own, at = suffix_keys(found, run)
                n, host = len(own), host_of(url)
                first, head = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
                first[np.unique(own, return_index=True)[1]] = head[:1] = True
                kept.append((np.full(n, tag if host is None else _signed(_hash(host))), own, np.full(n, tag), at, first, head, np.full(n, marked_text(found) is None)))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], names=["host", "key", "tag", "at", "first", "head", "is_open"])

    schema = "host long, key long, tag long, at int, first boolean, head boolean, is_open boolean"
    suffixes = stored(bounded(pages).select("__url", "__html", "__tag").mapInArrow(keys, schema), "suffixes")
    hosts = suffixes.filter("head").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = suffixes.groupBy("host", "key").agg(F.count(F.when(F.col("first"), 1)).alias("n")).filter("n > 1").join(hosts, "host")
    shared = [
        suffixes.filter(which).select("host", "key", "tag", "at").join(counts.filter(enough), ["host", "key"])
        for which, enough in (("at < 0", F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 2))), ("is_open AND at >= 0", F.lit(True)))
    ]
    where = shared[0].union(shared[1]).groupBy("tag").agg(F.collect_set(F.struct("at", "n")).alias("__repeated"), F.max("pages").alias("__pages"))
    where = stored(where.withColumnRenamed("tag", "__of"), "repeated")
    columns = [plain(id_col), "__url", "__html"]

    def make():
        def one(key, url, page, repeated=(), of=1):
            yield key, url, *told_text(blocks(page), [(r["at"], r["n"]) for r in repeated or ()], of or 1, run)

        return one

    schema = f"{plain(id_col)} {df.schema[id_col].dataType.simpleString()}, {plain(url_col)} string, text string, n_cut long"
    if where.isEmpty():  # saves the exchange of pages
        return map_rows(pages, make, columns, schema)
    return map_rows(pages.join(where, F.col("__tag") == F.col("__of"), "left"), make, [*columns, "__repeated", "__pages"], schema)
