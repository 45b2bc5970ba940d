"""Main text of web pages by consensus host paths.

Each page is read into blocks of text, each with the containers around it. A container's path is the chain
of its tags with their generalised classes (digits out). Every page scores its containers by the text
they hold outside boilerplate and casts its vote for the best one's path; Spark adds up the votes per
host, and each page is then re-extracted with the path that its host chose (the page's own best one where
the host's is missing from it).

Boilerplate is what stands in navigation, headers and footers of the page, asides, forms, scripts, styles
and the like, or in elements whose class, id or role names such a part (adverts, sidebars, notices,
comments, ...). A name that only has such a word as a part ("has-sidebar", "legal-news") doesn't count for an
element that holds all but the whole of the page's remaining text; and if names would leave no text at all, the
elements with most text are kept in spite of theirs, if that is 200 code points or more.

Scripts, styles and other raw elements end at their closing tag and never close themselves, whatever their last
attribute ends with; only svg and math may. Elements that can hold their like end at the matching closing tag.

Attributes are read one by one: `hidden` counts as an attribute of its own (or aria-hidden="true"), not within
other names or values, and a quote opens a value only after an equals sign. Inline elements that are hidden
or named as adverts and the like go with their text.

Null html counts as empty; a page without main text has the text ''. Pages without a host vote
together as one host. Ties between paths go to the longer path, then to the smaller string. Repeated
rows are each reported, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.shared import in_arrow, written
from helioframe.llm.text_arrays import slices

SLICE_BYTES = 1 << 20
#: So many hosts' paths, and characters of them, are sent to all tasks; more meet the pages in a join of Spark's choice.
MAX_SENT_HOSTS = 50_000
MAX_SENT_CHARACTERS = 8_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select button title".split())
#: Of these, those that close themselves with a slash, and those that can hold their like.
FOREIGN = frozenset({"svg", "math"})
NESTED = FOREIGN | {"noscript", "template", "object", "canvas", "button", "select"}
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINER = frozenset("html body main article section div td blockquote".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
BOILER_WORDS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|side-?bar\w*|aside|widgets?|related\w*|recommend\w*|"
    r"share|sharing|social\w*|comments?|comment-?list|disqus|respond|repl(?:y|ies)|discussion|cookies?|consent|gdpr|notice\w*|alert\w*|popup\w*|modal|overlay|newsletter\w*|subscri\w*|"
    r"signup|login|search\w*|pagination|pager|skip|copyright|legal|disclaimer|tags?|toolbar|hidden)"
)
BOILER_NAMES = re.compile(rf"(?:^|[\s_-]){BOILER_WORDS}(?=$|[\s_-])", re.I)
#: A whole class or id that is such a word, with a number or without.
BOILER_WHOLE = re.compile(rf"(?:^|\s){BOILER_WORDS}(?:[_-]?\d+)?(?=$|\s)", re.I)
#: Where names leave no text, what stands under a whole name is kept from so many code points on.
LEAST_KEPT = 200
#: An element with a word in its name is kept if the page's other text is less than this share of its own.
OTHER_TEXT = 0.1
#: Elements that an opening tag closes if they are open.
CLOSES = {"p": BLOCK} | {t: frozenset({t}) for t in ("li", "option")} | {"dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"})}
#: Inline elements whose names are these are left out with their text; other inline names say little.
INLINE_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|share|sharing|social\w*|cookies?|consent|popup|newsletter\w*|hidden)(?=$|[\s_-])", re.I)
#: A tag's attributes: quotes count only where a value begins.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"[\d_-]+")


def attributes(attrs: str) -> tuple[str, str, bool]:
    """The names (class and id), the role and whether the element is hidden, by whole attributes."""
    names, role, hidden = "", "", False
    if attrs and not attrs.isspace():
        for key, a, b, c in ATTR.findall(attrs):
            key = key.lower()
            if key in ("class", "id"):
                names += " " + (a or b or c)
            elif key == "role":
                role = (a or b or c).strip().lower()
            elif key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                hidden = hidden or (a or b or c).strip().lower() == "true"
    return names, role, hidden


class Path:
    """A chain of containers; equal chains of a page are one object, so that depth costs no memory."""

    __slots__ = ("parent", "label", "size", "below")

    def __init__(self, parent: Path | None, label: str):
        self.parent, self.label, self.below = parent, label, {}
        self.size = len(label) + (parent.size + 1 if parent is not None else 0)

    def child(self, label: str) -> Path:
        if label not in self.below:
            self.below[label] = Path(self, label)
        return self.below[label]

    def __str__(self) -> str:
        labels, at = [], self
        while at is not None:
            labels.append(at.label)
            at = at.parent
        return ">".join(reversed(labels))


class Element:
    """hard: boilerplate by tags, roles or hiding; whole and named: the nearest element around that a whole name, or a part of one, makes suspect."""

    __slots__ = ("tag", "hard", "whole", "named", "outer", "boiler", "article", "path")

    def __init__(self, tag: str, parent: Element | None, attrs: str):
        names, role, hidden = attributes(attrs)
        self.tag, self.boiler = tag, False
        self.hard = bool(
            (parent is not None and parent.hard)
            or tag in BOILER_TAGS
            or (tag == "header" and not (parent is not None and parent.article))
            or hidden
            or role in BOILER_ROLES
        )
        self.whole, self.named, self.outer = (parent.whole, parent.named, parent.named) if parent is not None else (None, None, None)
        if names and tag not in ("html", "body", "article", "main"):
            if BOILER_WHOLE.search(names):
                self.whole = self
            elif BOILER_NAMES.search(names):
                self.named = self
        self.article = parent is not None and parent.article
        if parent is None:
            self.path = Path(None, tag)
        elif tag in CONTAINER:
            general = ".".join(sorted({DIGITS.sub("", x) for x in names.lower().split()} - {""}))
            label = f"{tag}.{general}" if general else tag
            self.path, self.article = parent.path.child(label), self.article or "article" in label
        else:
            self.path = parent.path


def judge(page: list[tuple[str, Element]]) -> None:
    """Settle which elements of a page are boilerplate, by what those with suspect names hold."""
    outside, own = 0, Counter()
    for text, e in page:
        if not e.hard and e.whole is None:
            if e.named is None:
                outside += len(text)
            else:
                own[e.named] += len(text)
    most, kept = max(own.values(), default=0), set()
    for e, size in own.items():
        if outside < OTHER_TEXT * size and 2 * size >= most:
            while e is not None and e not in kept:  # with what is around it
                kept.add(e)
                e = e.outer
    clean: dict[Element | None, bool] = {None: True}

    def named_clean(e: Element | None) -> bool:
        chain = []
        while e not in clean:
            chain.append(e)
            e = e.outer
        state = clean[e]
        for x in reversed(chain):
            state = clean[x] = state and x in kept
        return state

    for _, e in page:
        e.boiler = e.hard or e.whole is not None or not named_clean(e.named)
    if all(e.boiler for _, e in page):
        sizes: Counter = Counter()
        for text, e in page:
            if not e.hard:
                sizes[e.whole, e.named] += len(text)
        most = max(sizes.values(), default=0)
        if most >= LEAST_KEPT:
            for _, e in page:
                e.boiler = e.hard or 2 * sizes[e.whole, e.named] < most


def raw_end(html: str, at: int, tag: str) -> int:
    """Where a raw element whose content begins at a place ends: behind its closing tag, or at the page's end."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(html, at):
        if m[1]:
            depth -= 1
        elif tag in NESTED and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(html)


def blocks(html: str) -> list[tuple[str, Element]]:
    """The page's blocks of text in order, with the element each stands in."""
    stack, out, text = [Element("html", None, "")], [], []
    opened: Counter = Counter()
    left_out: list | None = None  # an inline element without its text: tag, how often it is open, depth of the stack
    at, size = 0, len(html)

    def end_block() -> None:
        if text:
            joined = SPACE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if joined:
                out.append((joined, stack[-1]))

    def close_from(k: int) -> None:
        nonlocal left_out
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]
        if left_out and len(stack) < left_out[2]:
            left_out = None

    while at < size:
        found = TOKEN.search(html, at)
        stop = found.start() if found is not None else size
        if stop > at and not left_out:
            text.append(html[at:stop])
        if found is None:
            break
        at = found.end()
        if found["cdata"] and not left_out:
            text.append(found["cdata"])
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK or tag in BOILER_TAGS
        if found["close"]:
            if tag == "br":
                text.append(" ")
            elif block:
                if opened[tag] > 0:
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                    end_block()
                    close_from(k)
            elif left_out and tag == left_out[0]:
                left_out[1] -= 1
                if not left_out[1]:
                    left_out = None
            continue
        if tag in RAW:
            if tag not in FOREIGN or not found["attrs"].endswith("/"):
                at = raw_end(html, at, tag)
            text.append(" ")
        elif tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                text.append(" ")
        elif block:
            end_block()
            lists = tag in ("li", "option", "dt", "dd", "td", "th", "tr")
            if lists or opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = stack[k].tag
                    if open_tag == "p" or tag in CLOSES.get(open_tag, ()):
                        if open_tag == "p" or lists:
                            close_from(k)
                        break
                    if open_tag in ("ul", "ol", "table", "dl", "div", "section", "article", "body", "main"):
                        break
            if tag == "html" or (tag == "body" and opened["body"] > 0):
                continue
            stack.append(Element(tag, stack[-1], found["attrs"]))
            opened[tag] += 1
        elif left_out:
            left_out[1] += tag == left_out[0]
        elif not found["attrs"].endswith("/"):
            names, role, hidden = attributes(found["attrs"])
            if hidden or role in BOILER_ROLES or (names and INLINE_NAMES.search(names)):
                left_out = [tag, 1, len(stack)]
    end_block()
    judge(out)
    return out


def container_scores(page: list[tuple[str, Element]]) -> dict[Path, float]:
    """Per container: all of the text straight in it, half of the text one container further in, a quarter beyond."""
    scores: dict[Path, float] = {}
    for text, element in page:
        if element.boiler:
            continue
        path, share = element.path, float(len(text))
        while path is not None and share >= len(text) / 4:
            scores[path] = scores.get(path, 0.0) + share
            path, share = path.parent, share / 2
    return scores


def best_path(scores: dict[Path, float]) -> str | None:
    if not scores:
        return None
    most = max(scores.values())
    longest = max(p.size for p, s in scores.items() if s == most)
    return min(str(p) for p, s in scores.items() if s == most and p.size == longest)


def text_in(page: list[tuple[str, Element]], path: str | None) -> str | None:
    """The text of the blocks within containers of that path, or None if there are none."""
    if path is None or not page:
        return None
    labels, within = path.split(">"), {}
    parts = []
    for text, element in page:
        if element.boiler:
            continue
        chain, at = [], element.path
        while at is not None and at not in within:
            chain.append(at)
            at = at.parent
        inside = within[at] if at is not None else 0  # how many labels match from the top; -1 if one doesn't
        for node in reversed(chain):
            if 0 <= inside < len(labels):
                inside = inside + 1 if node.label == labels[inside] else -1
            within[node] = inside
        if within[element.path] == len(labels):
            parts.append(text)
    return "\n\n".join(parts) if parts else None


def host(url: Column) -> Column:
    """The host of a url, lower case; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and path: the container path with the most votes among a host's pages (host, html)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            votes: Counter = Counter()
            for batch in slices(whole, "html", SLICE_BYTES):
                for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    path = best_path(container_scores(blocks(html or "")))
                    if path is not None:
                        votes[name, path] += 1
            keys = sorted(votes)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64())], ["host", "path", "votes"])

    votes = in_arrow(pages.select("host", "html"), vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.length("path")), "path")
    return votes.withColumn("place", F.row_number().over(best)).where("place = 1").select("host", "path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col and text of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    paths = written(host_paths(rows), "paths")
    sums = paths.agg(F.count("*").alias("n"), F.sum(F.length("host") + F.length("path")).alias("characters")).first()
    kind = rows.schema["id"].dataType.simpleString()

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", SLICE_BYTES):
                out = []
                for path, html in zip(batch.column("path").to_pylist(), batch.column("html").to_pylist()):
                    page = blocks(html or "")
                    got = text_in(page, path)
                    out.append(got if got is not None else text_in(page, best_path(container_scores(page))) or "")
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    if sums["n"] <= MAX_SENT_HOSTS and (sums["characters"] or 0) <= MAX_SENT_CHARACTERS:
        paths = F.broadcast(paths)
    joined = rows.join(paths, "host", "left").select("id", "url", "path", "html")
    return in_arrow(joined, text, f"id {kind}, url string, text string").toDF(id_col, url_col, "text")
