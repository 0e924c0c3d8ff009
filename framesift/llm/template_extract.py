r"""Main text of web pages by equivalence-class template deduction.

* A page is a sequence of tokens, each with the path of elements it stands in: opening tags (with the class
  names that tell their role) and texts between tags.
* Tokens of a host's pages that occur equally often on each page, that is with equal occurrence vectors, are
  an equivalence class.  A vector is known by its support and a 64-bit combination of (page, count) hashes,
  which tasks prepare and Spark combines, so no vector is ever held and a host may have any number of pages.
* Pages are counted by their bodies: copies of a page are one page of their host.
* A class is valid if it is frequent (on SUPPORT percent of the host's pages, at least MIN_PAGES of them) and
  large (MIN_TOKENS tokens), and, on the page at hand, ordered (its tokens stand in the order of their mean
  places) and nested (the path of a token is part of its identity, so what stands in a valid element stands
  inside it on every page).  The valid classes of a host are its template.
* What is left between the template's tokens are the slots.  If a page has an article or main element, only texts in it are
  looked at.  Static texts, those of the template, go, inside an article as well; long texts are never static.  That is so only where the
  slots show that pages differ: if STATIC_PERCENT of a page's words were static, its host's pages are versions of one
  text, and nothing of it is taken for template.
  Of the rest, slots of menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
  styles go by the role of the elements around them (whole class names, `hidden`, display:none).
  Every other text stays, whole and in page order, as one block for each block element.

Defined results: null or empty html, and a page without main text, give the empty text with 0 characters;
unclosed elements end where HTML ends them, or with the page; a null or odd url belongs to the host with the
empty name; repeated rows give repeated rows (and count once for their host); a host of fewer than MIN_PAGES different
bodies has no template; empty input gives empty output; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framesift.llm.text import mix64
from framesift.session import broadcast_if_small, materialise

SUPPORT = 90
MIN_PAGES = 4
MIN_TOKENS = 3
#: A text of more words is never static.
LONG_TEXT = 24
#: A text of no more words is remembered.
SHORT_TEXT = 6
#: Share of a page's words that cannot all be static.
STATIC_PERCENT = 75
#: Template tokens that are sent to every task at most; beyond that pages and templates are joined by host.
SENT_TOKENS = 1_000_000

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
                   "search section summary table tbody td tfoot th thead tr ul caption option".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button label input fieldset search head".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
CLOSES_AT = frozenset("ul ol dl table body html article section div".split())
ROLES = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice notices "
                  "alert menu nav navbar navigation sidebar comment comments replies respond disqus footer breadcrumb "
                  "breadcrumbs share sharing social related recommended popup modal overlay newsletter subscribe signup login "
                  "search widget masthead skip pagination pager toolbar".split())
#: Words that may stand beside a role in a class name without changing it.
BESIDE = frozenset("bar block box button buttons form global link links list main page primary secondary side site text top".split())
HEADERS = re.compile(r"header|site[-_]?header|page[-_]?header|topbar", re.I)
#: Elements that are never furniture by their own attributes.
CONTENT = frozenset("html body main article".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""",
                    re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


def _is_role(name: str) -> bool:
    """Whether a whole class name tells a role: all its words are roles, or stand beside one."""
    parts = [p for p in re.split("[-_]+", name.lower()) if p]
    return not ROLES.isdisjoint(parts) and all(p in ROLES or p in BESIDE for p in parts)


@lru_cache(maxsize=4096)
def _role(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(name with its roles, is furniture by itself, is so by its class names, is a header) of an opening tag."""
    given = [(k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else []
    found = " ".join(v for k, v in given if k in ("class", "id", "role") and v)
    hidden = any(k == "hidden" or (k == "aria-hidden" and v.strip().lower() == "true") or
                 (k == "style" and _NO_DISPLAY.search(v)) for k, v in given)
    names = found.split() if name not in CONTENT else []
    header = name == "header" or any(HEADERS.fullmatch(n) for n in names)
    return (f"{name}.{found}" if found else name, name in FURNITURE or (hidden and name not in CONTENT),
            any(map(_is_role, names)), header)


def parse(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, path, value, is furniture, is in an article) of a page's parts in order.

    Kinds: `open` an element begins, `break` a block ends, `text` a piece of text.  What holds a main element or
    the page's first article is no furniture by its class names.
    """
    exempt: set[int] = set()
    while True:
        known = len(exempt)
        parts = list(_parts(page, exempt))
        if len(exempt) == known:
            return iter(parts)


def _parts(page: str, exempt: set[int]) -> Iterator[tuple[str, str, str, bool, bool]]:
    """As `parse`; adds the places of elements to `exempt` that must not count as furniture."""
    # (name, path, furniture by element or hidden, places of the elements around that are so by class names, article)
    stack: list[tuple[str, str, bool, tuple[int, ...], bool]] = []
    first = True
    at, end = 0, len(page)
    while at <= end:
        match = _TOKEN.search(page, at)
        start = match.start() if match else end
        if start > at:
            _, path, odd, named, article = stack[-1] if stack else ("", "", False, (), False)
            yield "text", path, page[at:start], odd or bool(named), article
        if not match:
            return
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in CLOSES_AT and name not in CLOSES_AT and name not in BLOCKS:
                    break
            if name in BLOCKS:
                yield "break", "", "", False, False
            continue
        if name in RAW:
            skip_to = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if not match[0].endswith("/>"):
                at = skip_to.end() if skip_to else end
            continue
        if name in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in SAME_LEVEL:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME_LEVEL[name]:
                    del stack[k:]
                    break
                if stack[k][0] in CLOSES_AT:
                    break
        _, path, odd, named, article = stack[-1] if stack else ("", "", False, (), False)
        label, own_odd, by_name, header = _role(name, match[3][:-1])
        # An article's own header holds its title, and what it says without scripts is text; any other is the site's.
        odd = odd or own_odd or (name in ("header", "noscript") and not article)
        if (by_name or (header and not article)) and start not in exempt:
            named += (start,)
        if not odd and (name == "main" or (name == "article" and first)):
            first = False
            exempt.update(named)
        article = article or (name in ("article", "main") and not odd and not named)
        path = f"{path}>{label}"
        if name in BLOCKS:
            yield "break", "", "", False, False
        yield "open", path, "", odd or bool(named), article
        if name == "br":
            yield "text", path, " ", odd or bool(named), article
        if name not in VOID and not match[0].endswith("/>"):
            stack.append((name, path, odd, named, article))


def _token(kind: str, path: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}\0{path}\0{value}".encode("utf-8", "replace"), digest_size=8).digest(),
                          "little", signed=True)


_known_token = lru_cache(maxsize=50_000)(_token)


def _text_token(path: str, text: str) -> int:
    words = entities.unescape(text).split()
    # Short texts come again and again; others would only fill the table.
    return (_known_token if len(words) <= SHORT_TEXT else _token)("text", path, " ".join(words))


def tokens(page: str) -> list[int]:
    """The tokens of a page in order."""
    out = []
    for kind, path, value, _, _ in parse(page):
        if kind == "open":
            out.append(_known_token("open", path, ""))
        elif kind == "text" and not value.isspace():
            out.append(_text_token(path, value))
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, vector, place) of a task's pages; token 0 counts the host's pages."""
    held: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        values = np.array(list(held.values()), np.uint64).reshape(-1, 3)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int64()),
             pa.array(values[:, 0].astype(np.int64)), pa.array(np.ascontiguousarray(values[:, 1]).view(np.int64)),
             pa.array(values[:, 2].astype(np.int64))], ["host", "token", "pages", "vector", "place"])
    for batch in batches:
        for host, page, key in zip(batch.column(0), batch.column(1), batch.column(2)):
            host, seed = host.as_py(), np.uint64(key.as_py() & (1 << 64) - 1)
            found = tokens(page.as_py() or "")
            first: dict[int, int] = {}
            for place, token in enumerate(found):
                first.setdefault(token, place)
            counts = Counter(found)
            counts[0], first[0] = 1, 0
            number = np.fromiter(counts.values(), np.uint64, len(counts))
            for (token, _), part in zip(counts.items(), mix64(seed + number * np.uint64(0x9E3779B97F4A7C15)).tolist()):
                have = held.get((host, token))
                if have is None:
                    held[host, token] = [1, part, first[token]]
                else:
                    have[0] += 1
                    have[1] ^= part
                    have[2] += first[token]
        if len(held) > 100_000:
            yield out()
    if held:
        yield out()


def host_of(url: str):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, classes) from pages (host, html, key): each class is the ordered list of its tokens; pages of a key are copies."""
    seen = pages.select("host", "html", "key").dropDuplicates(["host", "key"]).mapInArrow(
        _occurrences, "host string, token long, pages long, vector long, place long")
    known = seen.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"),
                                              F.sum("place").alias("place"))
    # A token on too few pages cannot be template; what stays is some hundred rows a host.
    known = materialise(known.where(F.col("pages") >= MIN_PAGES), "tokens")
    size = known.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    # Frequent tokens are told where they lie, as long as the hosts are few enough to be sent.
    frequent = known.where("token != 0").join(broadcast_if_small(size), "host").where(F.col("pages") * 100 >= F.col("host_pages") * SUPPORT)
    large = (frequent.groupBy("host", "pages", "vector")
             .agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("members"))
             .where(F.size("members") >= MIN_TOKENS))
    return large.groupBy("host").agg(F.collect_list(F.col("members.token")).alias("classes"))


def extract(page: str, classes: list[list[int]]) -> str:
    """The main text of a page, given the classes of its host's template."""
    parts = list(parse(page))
    static: set[int] = set()
    if classes:
        first: dict[int, int] = {}
        for kind, path, value, _, _ in parts:
            if kind == "open":
                first.setdefault(_known_token("open", path, ""), len(first))
            elif kind == "text" and not value.isspace():
                first.setdefault(_text_token(path, value), len(first))
        for members in classes:
            places = [first[t] for t in members if t in first]
            if places == sorted(places):
                static.update(members)
    in_article = any(article for _, _, _, _, article in parts)
    static = _static_texts(parts, static, in_article)
    blocks: list[str] = []
    held: list[str] = []
    for at, (kind, path, value, odd, article) in enumerate(parts):
        if kind == "break":
            if held:
                blocks.append("".join(held))
                held = []
        elif kind == "text" and not odd and (article or not in_article) and at not in static:
            held.append(value)
    blocks.append("".join(held))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def _static_texts(parts: list[tuple], template: set[int], in_article: bool) -> set[int]:
    """The places of texts that are template, if enough else is left."""
    found, some, every = set(), 0, 0
    if template:
        for at, (kind, path, value, odd, article) in enumerate(parts):
            if kind == "text" and not odd and (article or not in_article) and not value.isspace():
                words = len(entities.unescape(value).split())
                every += words
                if words <= LONG_TEXT and _text_token(path, value) in template:
                    found.add(at)
                    some += words
    return found if some * 100 < every * STATIC_PERCENT else set()


def main_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    slim = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    slim = slim.select("page_id", "url", host_of("url").alias("host"), "html", F.xxhash64("html").alias("key"))
    spark = pages.sparkSession
    found = templates(slim)
    kind = slim.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def rows(batch: pa.RecordBatch, classes: list) -> pa.RecordBatch:
        texts = [extract(p.as_py() or "", c) for p, c in zip(batch.column(2), classes)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])
    found = materialise(found, "templates")
    size = found.select(F.sum(F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c)))).first()[0] or 0
    if size <= SENT_TOKENS:
        known = {r["host"]: r["classes"] for r in found.toLocalIterator()}  # SENT_TOKENS numbers at most
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, [sent.value.get(h, []) for h in batch.column(3).to_pylist()])
        return slim.select("page_id", "url", "html", "host").mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch, [c or [] for c in batch.column(3).to_pylist()])
    return (slim.join(found, "host", "left").select("page_id", "url", "html", "classes").mapInArrow(joined, schema))
