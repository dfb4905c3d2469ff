"""Main text of web pages by nearest-URL page differencing.

1. Each page becomes lines: the text of its blocks in page order, character
   references decoded, white space folded.  Every line knows whether it
   stands in an article element and whether in page furniture (menus, page
   headers, footers, sidebars, forms, adverts, notices, reader comments).
2. Pages are put in order of host and URL path.  A page's partner is the
   neighbour in this order with the longer common path, on the same host.
3. The lines of both pages are aligned by longest common subsequence; lines
   in common are template and go.
4. A check follows, as a difference alone cannot tell an unshared menu from
   an article, or a quoted paragraph from a template: furniture goes also
   where it is not shared; headings and running text in the article element stay also
   where it is shared, and a pair that shares most of its article lines is a
   copy, which proves nothing about templates.

Only line hashes meet in the join; texts are not shuffled, except those of
the pages that lose a line.

Edge cases: null html gives an empty text; a null url or a page alone on its
host has no partner; rows that repeat get the same text; markup that is never
closed ends with the page; an empty table gives an empty result.  A host of
any size is one range of the order, not one group.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from os.path import commonprefix
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util.rank import global_row_number
from .shared import cut, id_map, in_map, parts

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z0-9]+")

#: Elements whose content is never text of the page.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math select object canvas audio video".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav aside form footer menu button dialog".split())
#: Words in class or id, and roles, that name page furniture.
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
                   "newsletter subscribe subscription sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar masthead "
                   "footer comment comments disqus replies reply respond share sharing social related recommended recommendations popup modal overlay "
                   "login signin signup pagination pager widget widgets notice notices alert notification disclaimer copyright skip hidden".split())
_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())


def _furniture(name: str, attrs: str, in_article: bool) -> str:
    """Why an element is page furniture: a word for the kind, or nothing."""
    if name in _FURNITURE or name == "header" and not in_article:
        return name
    if not attrs or name in ("body", "html", "main"):
        return ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in _ROLES or found.get("aria-hidden", "").lower() == "true":
        return "role"
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return "hidden"
    parts = set(_PARTS.split((found.get("class", "") + " " + found.get("id", "")).lower()))
    if parts & _COMMENTS:
        return "comments"
    return "named" if parts & _NAMES else ""


Line = tuple[str, int, bool, bool]


_END_OF = {n: re.compile(f"</{n}", re.ASCII | re.IGNORECASE) for n in _RAW}


def page_lines(html: str | None) -> list[Line]:
    """The lines of a page: (text, number of its article element or 0, whether it is furniture, whether it is a heading)."""
    out: list[Line] = []
    if not html:
        return out
    buffer: list[str] = []
    stack: list[tuple[str, str, int]] = []  # open elements that matter: name, furniture kind, article
    article = articles = furniture = pos = 0
    heading = False

    def close_block():
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((text, article, furniture > 0, heading))

    while True:
        m = _TAG.search(html, pos)
        if m is None:
            buffer.append(html[pos:])
            break
        if m.start() > pos:
            buffer.append(html[pos: m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if name == "br" or name in ("td", "th"):
            buffer.append(" ")
        if name in _BLOCK:
            close_block()
            heading = not closing and name in _HEADINGS
        if closing:
            if any(s[0] == name for s in stack):
                while stack:
                    n, kind, art = stack.pop()
                    if n in _BLOCK or kind:
                        close_block()
                    furniture -= bool(kind)
                    if n == "article":
                        article = art
                    if n == name:
                        break
            continue
        attrs = m[3] or m[6] or ""
        if name in _VOID or attrs.endswith("/") and name not in _BLOCK:
            continue
        if name in _RAW:
            # in the page itself: lower case can be longer than the letter
            end = _END_OF[name].search(html, pos)
            pos = end.start() if end else len(html)
            continue
        if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next begins
            _, kind, _ = stack.pop()
            furniture -= bool(kind)
        kind = _furniture(name, attrs, article > 0)
        if kind:
            close_block()
        if name == "article" and not kind:
            # an article is no part of a wrapper such as a form around the whole page
            if furniture and not any(s[1] in ("comments", "aside", "nav") for s in stack):
                stack = [(n, "", a) for n, _, a in stack]
                furniture = 0
            if not furniture:
                stack.append((name, kind, article))
                if not article:
                    articles += 1
                    article = articles
                continue
        if kind or name in ("div", "section", "article", "main", "span", "p", "ul", "ol", "li", "a", "b", "table", "header"):
            stack.append((name, kind, article))
            furniture += bool(kind)
    close_block()
    return out


def main_article(lines: list[Line]) -> int:
    """The article element with the most text, 0 when the page has none."""
    size: dict[int, int] = {}
    for text, article, furniture, _ in lines:
        if article and not furniture:
            size[article] = size.get(article, 0) + len(text)
    return max(size, key=lambda a: (size[a], -a)) if size else 0


def kept_lines(lines: list[Line], gone: set[int]) -> list[str]:
    main = main_article(lines)
    return [t for i, (t, a, f, _) in enumerate(lines) if i not in gone and not f and (a == main or not main)]


def common_lines(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Positions in both of a longest common subsequence (matches as an increasing run, by patience)."""
    at: dict[int, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        at.setdefault(y[j], []).append(j)
    tops: list[int] = []
    ends: list[tuple[int, int, object] | None] = []
    for i, v in enumerate(x):
        for j in at.get(v, ()):
            k = bisect_left(tops, j)
            node = (i, j, ends[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                ends.append(node)
            else:
                tops[k] = j
                ends[k] = node
    out = []
    node = ends[-1] if ends else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


#: A shared line inside the article goes only when it is this short, no heading and no sentence.
_LABEL_WORDS = 8
_SENTENCE = (".", "!", "?", "…", ":", "。", "！", "？", '"', "”", "»")


def host_and_path(url: str) -> tuple[str, str]:
    """Host in lower case, and the path without extension and closing slash."""
    try:
        u = urlsplit(url.strip())
    except ValueError:
        return url, ""
    path = unquote(u.path).rstrip("/")
    return (u.netloc.lower().removeprefix("www."), re.sub(r"\.(x?html?|php|aspx?|jsp)$", "", path))


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.xxhash64("page_id", "url", "html").alias("key"))


def _sketches(pages: DataFrame) -> DataFrame:
    """key, host, path and for each line its hash; bits say: in the main article, a label there, furniture."""
    def run(batches):
        for b in parts(batches):
            hosts, paths, hashes, bits = [], [], [], []
            for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                host, path = host_and_path(url) if url is not None else (None, None)
                lines = page_lines(html)
                main = main_article(lines)
                hosts.append(host)
                paths.append(path)
                hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _, _, _ in lines])
                bits.append(bytes((0 < main == a) * 1 + (not h and len(t.split()) <= _LABEL_WORDS and not t.endswith(_SENTENCE)) * 2 + f * 4
                                  for t, a, f, h in lines))
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                              pa.array(hashes, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                                             names=["key", "host", "path", "hashes", "bits"])

    return pages.mapInArrow(run, "key long, host string, path string, hashes array<long>, bits binary")


def url_partners(sketches: DataFrame) -> DataFrame:
    """(key, partner): for each page the neighbour in URL order on its host with the longer common path."""
    order = cut(global_row_number(sketches.where("host is not null").select("host", "path", "key").distinct(), ["host", "path", "key"], "n"))
    side = lambda name, step: order.select(F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"),
                                           F.col("key").alias(name), (F.col("n") + step).alias("n"))
    both = order.join(side("before", 1), "n", "left").join(side("after", -1), "n", "left").select(
        "key", "path", F.when(F.col("before_host") == F.col("host"), F.col("before")).alias("before"), "before_path",
        F.when(F.col("after_host") == F.col("host"), F.col("after")).alias("after"), "after_path")

    def nearer(batches):
        for b in parts(batches):
            out = []
            for _, path, p, pp, q, qp in zip(*(c.to_pylist() for c in b.columns)):
                if p is None or q is None:
                    out.append(q if p is None else p)
                else:
                    out.append(p if len(commonprefix([path, pp])) > len(commonprefix([path, qp])) else q)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["key", "partner"])

    return both.mapInArrow(nearer, "key long, partner long").where("partner is not null")


def shared_lines(sketches: DataFrame) -> DataFrame:
    """(key, gone): for each page that loses lines the numbers of the lines in common with its partner."""
    one = sketches.groupBy("key").agg(F.first("hashes").alias("hashes"), F.first("bits").alias("bits"))
    one = cut(one)
    pairs = url_partners(sketches)
    both = pairs.join(one, "key").join(one.select(F.col("key").alias("partner"), F.col("hashes").alias("other")), "partner") \
        .select("key", "hashes", "bits", "other")

    def align(batches):
        for b in parts(batches):
            keys, gone = [], []
            for key, x, bits, y in zip(*(c.to_pylist() for c in b.columns)):
                ix = [i for i, v in enumerate(x) if v in set_y] if (set_y := set(y)) else []
                if not ix:
                    continue
                set_x = set(x)
                pairs_ = common_lines([x[i] for i in ix], [v for v in y if v in set_x])
                hit = [ix[i] for i, _ in pairs_]
                inside = sum(bits[i] & 1 for i in range(len(x)))
                copy = 2 * sum(bits[i] & 1 for i in hit) >= max(1, inside)
                lose = [i for i in hit if not bits[i] & 1 or (bits[i] & 2 and not copy)]
                # without an article element a pair that shares most lines outside the furniture is a copy
                if not inside:
                    body = [i for i in range(len(x)) if not bits[i] & 4]
                    if 5 * sum(not bits[i] & 4 for i in hit) >= 4 * max(1, len(body)):
                        lose = []
                if lose:
                    keys.append(key)
                    gone.append(lose)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])

    return both.mapInArrow(align, "key long, gone array<int>")


def _texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars from (page_id, url, html, key, gone)."""
    def run(batches):
        for b in parts(batches):
            texts = ["\n".join(kept_lines(page_lines(h), set(g or ()))) for h, g in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    pages = _keyed(pages)
    gone = cut(shared_lines(_sketches(pages)))
    marks = id_map(gone, "key")
    none = F.lit(None).cast("array<int>").alias("gone")
    rest = in_map(pages, "key", marks, found=False).select("page_id", "url", "html", "key", none)
    changed = in_map(pages, "key", marks).join(gone, "key", "left").select("page_id", "url", "html", "key", "gone")
    return _texts(rest).unionByName(_texts(changed))
