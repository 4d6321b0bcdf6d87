"""Main text of web pages by template deduction over equivalence classes.

Tokens of a page are its element paths and its block texts with their paths.  Tokens of a
host's pages that occur equally often on every page have equal occurrence vectors and form
an equivalence class; vectors are compared by a commutative hash, so classes come out of
partial aggregates however many pages a host has.  A class is valid where its tokens stand
once on each of its pages and on most pages of the host; valid classes are nested by their
paths into the host's template.  Its slots are what the pages fill in.  The article is the
slot that the descent through the template ends in: from the body down, always into the
element that holds most of the text which is neither constant nor linked, until the text
stands in the element itself or spreads over several.

Elements and names by which authors mark menus, notices and the like only leave out parts
inside that slot; where a host has too few pages, or a page does not fit its template, they
and the elements for articles decide alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.workers import tidy
from quarry.storage import materialize

#: Pages from which a host's own template is deduced; fewer use the template of all hosts.
MIN_PAGES = 3
#: Share of a host's pages on which the tokens of a valid class stand.
SUPPORT = 0.8
#: Pages, and share of them, from which a text that stays the same inside the article is the template's.
CONSTANT_PAGES, CONSTANT_SUPPORT = 10, 0.9
#: Share of a slot's text that must lie in one element to descend into it, or in itself to stop.
DESCEND, STOP = 0.5, 0.2
#: Entries of all templates handed to every task (8 bytes each); more are joined by a shuffle.
BROADCAST_ENTRIES = 4_000_000
#: Open elements kept, as in browsers; deeper ones count as parts of the last.
MAX_DEPTH = 512
#: Places of equal elements below one that are told apart; further ones count as the last.
MAX_PLACE = 15

# Elements by their part in a page.
_RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "math", "object", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
_DOCUMENT = {"html", "body"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that can hold an article; text in other blocks counts as their own.
_CONTAINER = {"html", "body", "div", "section", "article", "main", "form", "center", "td", "tr", "tbody", "table"}
_CONTENT = {"article", "main"}
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "head"}
_OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
#: Class names and ids, compared as wholes in lower case.
_CONTENT_NAMES = {"article", "main", "content", "story", "post", "entry", "article-body", "main-content", "post-content", "entry-content"}
_OUTSIDE_NAMES = {
    "ad", "ads", "advert", "advertisement", "advertising", "ad-slot", "ad-container", "adsbygoogle", "banner", "sponsor", "sponsored",
    "promo", "promotion", "cookie", "cookies", "cookie-notice", "cookie-banner", "cookie-bar", "consent", "notice", "notification",
    "alert", "popup", "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share",
    "sharing", "share-buttons", "social", "social-share", "related", "related-posts", "related-articles", "recommended", "newsletter",
    "subscribe", "comments", "comment-list", "comment-section", "reader-comments", "respond", "footer", "header", "masthead", "toolbar",
    "pagination", "pager", "login", "signup", "search",
}
#: Elements closed by the start of another of the same group.
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = _BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "caption"}

#: A tag whose quoted values hold no angle bracket; a failed try never looks past the next bracket.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}

#: Marks of an element: can hold an article, is marked as one, is marked as something else, is a heading, the document, a form.
HOLDS, HINT, OUT, HEADING, DOCUMENT, FORM = 1, 2, 4, 8, 16, 32
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Block:
    """One run of text between block boundaries."""

    path: int
    #: Inside the template's article slot; below an outside element in it; inside an element marked as article; below any outside element.
    inside: bool
    barred: bool
    hinted: bool
    outside: bool
    text: str
    #: Characters of the text outside links.
    free: int


@dataclass(slots=True)
class Element:
    """An open element; `chars` and `own` count unlinked text below it and in its own text blocks."""

    name: str
    path: int
    block: bool
    marks: int
    inside: bool
    barred: bool
    hinted: bool
    outside: bool
    chars: int = 0
    own: int = 0
    #: Elements that can hold an article so far below this one, by label.
    seen: dict[str, int] = field(default_factory=dict)


@dataclass(slots=True)
class Page:
    """`paths` holds, for each element path, [parent, marks, occurrences, chars, own]."""

    blocks: list[Block] = field(default_factory=list)
    paths: dict[int, list[int]] = field(default_factory=dict)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _marks(name: str, attributes: str) -> tuple[str, int]:
    """(path label, marks) of a start tag."""
    found: dict[str, str] = {}
    if attributes:
        for m in _ATTR.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if not found:
        content, outside, label = name in _CONTENT, name in _OUTSIDE, name
    else:
        classes = found.get("class", "").split()
        names = {n.lower() for n in (*classes, found.get("id", "").strip())}
        role = found.get("role", "").strip().lower()
        content = name in _CONTENT or role == "main" or not names.isdisjoint(_CONTENT_NAMES)
        outside = (
            name in _OUTSIDE
            or role in _OUTSIDE_ROLES
            or not names.isdisjoint(_OUTSIDE_NAMES)
            or ("hidden" in found and name != "html")
            or found.get("aria-hidden", "").lower() == "true"
        )
        # Numbers in class names, and all classes of the document, tell pages apart rather than places.
        label = name if name in _DOCUMENT else ".".join([name, *sorted({_DIGITS.sub("0", c) for c in classes})])
    kinds = ((HOLDS, _CONTAINER), (HEADING, _HEADINGS), (DOCUMENT, _DOCUMENT), (FORM, {"form"}))
    return label, HINT * content | OUT * outside | sum(mark for mark, names_of in kinds if name in names_of)


def _tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, name, attributes) of every tag; the last has no name.

    Comments and declarations are passed over, and so is all to the end of a script and the
    like.  An open quote without its end reaches to the next angle bracket.
    """
    at, start, unclosed = 0, 0, set()
    before: list[str] = []
    while True:
        at = page.find("<", at)
        if at < 0:
            before.append(page[start:])
            yield "".join(before), "", "", ""
            return
        m = _TAG.match(page, at)
        if m is None:
            end = _odd_end(page, at, unclosed)
            if end == at:  # a bracket that opens no tag is text
                at += 1
                continue
            before.append(page[start:at])
            head = _NAME.match(page, at)
            slash, name, attributes = (head[1], head[2], page[head.end() : end - 1]) if head else ("", "", "")
        else:
            before.append(page[start:at])
            end, (slash, name, attributes) = m.end(), m.groups()
        at = start = end
        if name:
            name = name.lower()
            yield "".join(before), slash, name, attributes
            before = []
            if name in _RAW and not slash:
                close = _RAW_END[name].search(page, at)
                at = start = close.end() if close else len(page)


def _odd_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where a comment, a declaration or a tag with brackets in its quotes ends; `at` if nothing begins there."""
    if page.startswith("<!--", at):
        end = page.find("-->", at + 4)
        return end + 3 if end >= 0 else len(page)
    following = page[at + 1 : at + 2]
    if following in ("!", "?"):
        return page.find(">", at) + 1 or len(page)
    head = _NAME.match(page, at)
    if head is None:
        return at
    spot = head.end()
    while True:
        close = page.find(">", spot)
        if close < 0:
            return len(page)
        quotes = [q for q in (page.find(c, spot, close) for c in "\"'") if q >= 0]
        if not quotes:
            return close + 1
        quote = min(quotes)
        mark = page[quote]
        end = -1 if mark in unclosed or page[quote - 1] != "=" else page.find(mark, quote + 1)
        if end < 0:
            if page[quote - 1] == "=":
                unclosed.add(mark)
            spot = quote + 1
        else:
            spot = end + 1


def parse(page: str, content: frozenset[int] = frozenset()) -> Page:
    """Blocks in page order and the element paths; `content` are the paths of the article slot.

    Broken markup is read as browsers do where it matters here: unclosed paragraphs and list
    items end at the next one, stray end tags are ignored, what is open at the end is closed.
    Time is linear in the page, whatever is nested or left open.
    """
    out = Page(paths={0: [0, HOLDS, 1, 0, 0]})
    root = Element("", 0, True, HOLDS, 0 in content, False, False, False)
    stack, opened, parts = [root], Counter(), []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            top = next(e for e in reversed(stack) if e.block)
            free = max(0, len(text) - linked)
            out.blocks.append(Block(top.path, top.inside, top.barred, top.hinted, top.outside, text, free))
            top.chars += free
            next(e for e in reversed(stack) if e.marks & HOLDS or e is root).own += free
        linked = 0

    def close(to: int) -> None:
        if parts and any(e.block for e in stack[to:]):
            flush()
        while len(stack) > to:
            e = stack.pop()
            opened[e.name] -= 1
            if e.block:
                seen = out.paths[e.path]
                seen[3] += e.chars
                seen[4] += e.own
                # What authors mark as no article does not compete for it; a form may hold the whole page.
                if not e.marks & OUT or e.marks & FORM:
                    next(x for x in reversed(stack) if x.block).chars += e.chars

    def closest(names: set[str]) -> int:
        """Place of the innermost open element of these names within the block structure; 0 if none."""
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    return i
                if stack[i].block and stack[i].name != "p":
                    break
        return 0

    for before, slash, name, attributes in _tags(page):
        if before:
            parts.append(before)
            if opened["a"]:
                linked += len(before)
        if not name:
            break
        block = name in _BLOCK
        if slash:
            if opened[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        close(i)
                        break
                    if not block and stack[i].block:
                        break
            continue
        if name in _VOID:
            if name in ("br", "hr", "img"):
                parts.append(" ")
            if block:
                flush()
            continue
        if name in _RAW:
            continue
        ends = _IMPLIED.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
        if ends and (to := closest(ends)):
            close(to)
        if block:
            flush()
        if len(stack) >= MAX_DEPTH:
            continue
        top = stack[-1]
        label, marks = _marks(name, attributes)
        # Inline elements do not lengthen the path: a block is one token whatever is bold in it.
        path = top.path
        if block:
            if marks & HOLDS:  # the same label's second place is another token than its first
                places = next(e for e in reversed(stack) if e.block).seen
                place = places[label] = min(places.get(label, -1) + 1, MAX_PLACE)
                label = f"{label} {place}"
            path = xxhash.xxh3_64_intdigest(b"%d " % top.path + label.encode("utf-8", "replace")) - (1 << 63)
            seen = out.paths.setdefault(path, [top.path, marks, 0, 0, 0])
            seen[1] |= marks
            seen[2] += 1
        out_here = bool(marks & OUT) and not (name == "header" and (top.hinted or top.inside))
        inside = top.inside or block and path in content
        stack.append(
            Element(
                name, path, block, marks if block else 0, inside,
                top.barred or top.inside and out_here,
                top.hinted or bool(marks & HINT),
                top.outside or out_here,
            )
        )
        opened[name] += 1
        if attributes.endswith("/") and not block:
            stack.pop()
            opened[name] -= 1
    flush()
    close(1)
    out.paths[0][3:] = [root.chars, root.own]
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _text_key(path: int, text: str) -> int:
    """A text token: a block's text at its path; never 0, which stands for the path alone."""
    return xxhash.xxh3_64_intdigest(b"%d|" % path + text.encode("utf-8", "replace")) - (1 << 63) or 1


def _vector(page: int, n: int) -> int:
    """One entry of an occurrence vector, as 31 bits; vectors are compared by the entries' sum."""
    return xxhash.xxh3_64_intdigest(b"%d %d" % (page, n)) & 0x7FFFFFFF


_TOKENS = "host string, path bigint, text bigint, parent bigint, marks int, occ bigint, v bigint, chars bigint, own bigint"


def _tokens(pages: DataFrame) -> DataFrame:
    """A row for each path (text 0) and each text token of every page, with its entry of the occurrence vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                host, found = host_of(url), parse(page or "")
                if not found.blocks:
                    continue  # a page without text says nothing of the template
                own = _hash(f"{page_id} {url} {len(page or '')}")
                rows += [(host, p, 0, parent, marks, n, _vector(own, n), chars, o) for p, (parent, marks, n, chars, o) in found.paths.items()]
                texts = Counter((b.path, b.text, b.free) for b in found.blocks)
                rows += [(host, p, _text_key(p, t), found.paths[p][0], 0, n, _vector(own, n), free * n, 0) for (p, t, free), n in texts.items()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(9)]
            kinds = [pa.string(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 4]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _TOKENS.split(", ")])

    return pages.mapInArrow(tidy(run), _TOKENS)


@dataclass
class Template:
    """`classes`: tokens by occurrence vector, the skeleton's; `content`: paths of the article slot; `constant`: texts of the template."""

    classes: dict[int, list[int]]
    content: list[int]
    constant: list[int]


def deduce(tokens: list[tuple[int, int, int, int, int, int, int]]) -> Template:
    """The template of tokens (path, text, parent, marks, vector, chars, own) that stand once on most pages.

    Classes are the tokens of one vector; they are nested by the paths' parents.  Totals are
    those of all pages.  Without a dominant slot there is no content.
    """
    classes: dict[int, list[int]] = defaultdict(list)
    parent, marks, chars, own, constant = {}, {}, {}, {}, []
    for path, text, above, m, vector, total, direct in tokens:
        classes[vector].append(text or path)
        if text:
            constant.append((path, above, text, total))
        else:
            parent[path], marks[path], chars[path], own[path] = above, m, total, direct
    # What stays the same on the pages is the template's, so it does not count as text of its slots.
    for path, above, _, total in constant:
        at, holder = path if path in chars else above, False
        while at in chars:
            chars[at] -= total
            if not holder and (marks[at] & HOLDS or at == 0):
                own[at], holder = own[at] - total, True
            if at == 0 or marks[at] & OUT and not marks[at] & FORM:
                break
            at = parent[at]
    below: dict[int, list[int]] = defaultdict(list)
    for path, above in parent.items():
        if path:
            below[above].append(path)
    slot, headings = 0, []
    while not marks.get(slot, 0) & HINT and chars.get(slot, 0) > 0 and own[slot] < STOP * chars[slot]:
        inner = [p for p in below[slot] if marks[p] & HOLDS and (not marks[p] & OUT or marks[p] & FORM)]
        best = max(inner, key=lambda p: (chars[p], p), default=None)
        if best is None or chars[best] < DESCEND * chars[slot]:
            hinted = [p for p in inner if marks[p] & HINT and chars[p] > 0]
            if not hinted:
                break
            best = max(hinted, key=lambda p: (chars[p], p))
        headings += [p for p in below[slot] if marks[p] & HEADING and chars[p] > 0]
        slot = best
    within = [(t, n) for p, above, t, n in constant if _below(p if p in parent else above, slot, parent)]
    texts = [t for t, _ in within] if sum(n for _, n in within) < chars.get(slot, 0) else []
    # A descent that ends in the document has found no slot.
    found = [] if not slot or marks[slot] & DOCUMENT else [slot, *headings]
    return Template(dict(classes), found, sorted(texts))


def _below(path: int, slot: int, parent: dict[int, int]) -> bool:
    while path != slot and path in parent and path:
        path = parent[path]
    return path == slot


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, n_pages, content, constant): the template of each host with enough pages, and that of all pages as host null."""
    sums = [F.sum(c).alias(c) for c in ("n", "occ", "vector", "chars", "own")]
    first = [F.max("parent").alias("parent"), F.max("marks").alias("marks")]
    counted = materialize(
        _tokens(pages)
        .withColumns({"n": F.lit(1), "vector": F.col("v")})
        .groupBy("host", "path", "text")
        .agg(*first, *sums),
        "html-tokens",
    )
    every = counted.filter("text = 0").groupBy("path", "text").agg(*first, *sums)
    both = counted.unionByName(every.select(F.lit(None).cast("string").alias("host"), *every.columns))
    roots = both.filter("path = 0 AND text = 0").select("host", F.col("n").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    member = (F.col("t.n") == F.col("t.occ")) & F.when(F.col("t.text") == 0, F.col("t.n") >= SUPPORT * F.col("n_pages")).otherwise(
        (F.col("n_pages") >= CONSTANT_PAGES) & (F.col("t.n") >= CONSTANT_SUPPORT * F.col("n_pages"))
    )
    # A token of most pages: so a host's list is about as long as one page's markup.
    skeleton = both.alias("t").join(roots.alias("r"), F.col("t.host").eqNullSafe(F.col("r.host"))).filter(member)
    token = F.struct("path", "text", "parent", "marks", "vector", "chars", "own")
    listed = skeleton.select("t.host", "n_pages", token.alias("token")).groupBy("host").agg(
        F.max("n_pages").alias("n_pages"), F.collect_list("token").alias("tokens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deduce(sorted(tuple(t.values()) for t in one)) for one in batch.column(2).to_pylist()]
            arrays = [*batch.columns[:2], *(pa.array([getattr(t, c) for t in found], pa.list_(pa.int64())) for c in ("content", "constant"))]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "n_pages", "content", "constant"])

    return listed.mapInArrow(tidy(run), "host string, n_pages bigint, content array<bigint>, constant array<bigint>")


def main_text(page: str, content: frozenset[int], constant: frozenset[int]) -> str:
    """The blocks in the article slot, one line each; by the elements' marks where the page does not have the slot."""
    blocks = parse(page, content).blocks
    if any(b.inside for b in blocks):
        kept = [b for b in blocks if b.inside and not b.barred]
    elif any(b.hinted for b in blocks):
        kept = [b for b in blocks if b.hinted and not b.outside]
    else:
        kept = [b for b in blocks if not b.outside]
    return "\n".join(b.text for b in kept if not constant or _text_key(b.path, b.text) not in constant)


def extract(
    pages: DataFrame, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`.

    A null html is empty and gives an empty text; a null or odd url belongs to the host ''.
    Repeated pages are answered one by one; an empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    found = materialize(templates(rows, min_pages), "html-templates")
    shared = found.filter(F.col("host").isNull()).first()
    common = (frozenset(shared["content"]), frozenset(shared["constant"])) if shared else (frozenset(), frozenset())
    own = found.filter(F.col("host").isNotNull())
    if shared:  # Hosts whose template is that of all pages need no entry of their own.
        same = F.array(*[F.lit(x) for x in sorted(shared["content"])]).cast("array<bigint>")
        own = own.filter((F.sort_array("content") != same) | (F.size("constant") > 0))
    entries = own.agg(F.sum(F.size("content") + F.size("constant") + 4)).first()[0] or 0
    host = F.lower(F.regexp_extract("url", r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = rows.withColumn("host", F.coalesce(host, F.lit("")))
    side = own.select("host", "content", "constant")
    side = F.broadcast(side) if entries <= BROADCAST_ENTRIES else side
    joined = keyed.join(side, "host", "left").select("page_id", "url", "html", "content", "constant")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, content, constant in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                texts.append(main_text(page or "", *(common if content is None else (frozenset(content), frozenset(constant)))))
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars bigint")
