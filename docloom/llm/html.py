"""Main text of web pages by consensus host paths.

A page's containers are scored by the text in them, less what stands in links.
The page's own choice goes down from the body: into the container that holds
most of what is there, as long as that leaves no heading or paragraph behind,
and never into an article or main element. A container is known by its
generalised path: the tags and classes from the body down, digits left out.
Every page votes for its choice; Spark counts the votes per host and path, and
the paths that hold a share of a host's votes win. Each page is then extracted
again from the first winning path that it has, so a page whose own choice
misleads follows its host; a page that has none of them is extracted from its
own choice.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments
(by tag, or by a class or id that names them), scripts, styles and markup
comments are left out wherever they stand; so are containers beside the article
whose text is nearly all links. A class or id names such a part by a whole
word: ``main-nav`` and ``comments-area`` do, ``no-sidebar`` doesn't. What is
named so, or is a form, but wraps the article (it holds most of the page's
text, and a main heading or an article; a form: paragraphs), is a wrapper and
stays. Blocks are what block-level tags delimit; ``br`` is white space.

Cases: null and empty html give an empty text; so does a page without any text
outside the parts left out; a null or odd url is a host of its own (the
empty one); broken markup is read as far as it goes: an element that is left
out and never closed ends at once, a self-closed one holds nothing, a drawing or
a selection ends at the next block, a script or style that is never closed at
the page's end; equal rows get equal texts, rows of a null id too; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import python_ready, stage

MOST_HOSTS = 500_000              # hosts whose winning paths are broadcast
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
          "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "tr", "ul"}
_CONTAINER = {"article", "body", "center", "div", "main", "section", "td"}
_ARTICLE = {"article", "main"}
#: Left out with all that they hold; those of the second row may turn out to be wrappers, those of the third end at the next block at the latest.
_OUT_TAGS = {"nav", "footer", "aside", "menu", "button", "head", "noscript", "template", "object", "canvas", "audio", "video"}
_SOFT_TAGS = {"form", "header", "dialog"}
_INLINE_OUT = {"svg", "math", "select"}
# Words that name parts left out; a name of several words is judged by its last one, by its first one where that
# can't describe something else, and not at all if a word turns it around.
_OUT_WORDS = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|disclaimer|footer|header|hidden|login|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|"
    r"signup|skip|social|sponsor\w*|subscribe|tags|toolbar|tracking|widget)")
_OUT_FIRST = re.compile(
    r"(?:ads?|advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus|footer|menu|modal|nav|navbar|navigation|newsletter|pagination|"
    r"popup|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)")
_TURNED = {"no", "not", "non", "without", "with", "has", "have", "hide", "is", "under", "below", "before", "after"}
_OUT_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search"}
# what an opening tag ends if it is open: the tag's own kind, as browsers do
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",)}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</[^>]*>", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _names(attrs: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _NAMES.finditer(attrs)} if "=" in attrs or "hidden" in attrs else {}


def names_a_part(names: str) -> bool:
    """If one of the classes or ids (separated by space) names a part that is left out."""
    for name in names.split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if words and not _TURNED & set(words) and (_OUT_WORDS.fullmatch(words[-1]) or _OUT_FIRST.fullmatch(words[0])):
            return True
    return False


class Block:
    """A text block: its text, the paths of the containers that it stands in
    (outermost first), characters of it in links, the tag that delimits it, and
    the elements around it that are left out unless they are wrappers."""
    __slots__ = ("text", "paths", "linked", "tag", "outs")

    def __init__(self, text, paths, linked, tag, outs):
        self.text, self.paths, self.linked, self.tag, self.outs = text, paths, linked, tag, outs

    def worth(self) -> float:
        return max(0, len(self.text) - 2 * self.linked) * (1.0 if len(self.text) >= 25 else 0.3)


class _Page:
    """One pass over a page's markup."""

    def __init__(self, page: str):
        self.page, self.last = page, {}
        self.found: list[Block] = []
        self.wraps: list[bool] = []                         # of every element that may be a wrapper: a main heading or an article in it
        self.forms: set[int] = set()
        # open elements: tag, elements around that may be wrappers, container paths, if all in it is left out
        self.stack: list[tuple[str, tuple[int, ...], tuple[str, ...], bool]] = [("", (), (), False)]
        self.text: list[str] = []
        self.linked, self.begun = 0, self.stack
        self._read()

    def _add(self, chunk: str, linked: bool = False) -> None:
        if not self.stack[-1][3]:
            if not self.text:
                self.begun = self.stack[:]                  # a block stands where it begins
            self.text.append(chunk)
            self.linked += len(chunk) if linked else 0

    def _end_block(self) -> None:
        joined = " ".join(_html.unescape("".join(self.text)).split())
        if joined:
            tag = next((t for t, _, _, _ in reversed(self.begun) if t in _BLOCK), "")
            self.found.append(Block(joined, self.begun[-1][2], self.linked, tag, self.begun[-1][1]))
        self.text.clear()
        self.linked = 0

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if any(x[0] in _BLOCK for x in self.stack[i:]) and not self.stack[i - 1][3]:
                    self._end_block()
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def _closed_later(self, tag: str, at: int) -> bool:
        if tag not in self.last:
            found = [m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", self.page, re.I)]
            self.last[tag] = found[-1] if found else -1
        return self.last[tag] >= at

    def _read(self) -> None:
        page, at, n, in_link = self.page, 0, len(self.page), False
        while at < n:
            m = _MARKUP.search(page, at)
            chunk = page[at:m.start()] if m else page[at:]
            if chunk:
                self._add(chunk, in_link)
            if not m:
                break
            at = m.end()
            tag, attrs = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if tag == "a":
                in_link = not (m[1] or m[4])
            if m[1] or m[4]:
                if tag == "p" and not any(x[0] == "p" for x in self.stack):
                    self._end_block()
                self._close(tag, ("td", "table") if tag not in ("table", "body", "html") else ())
            elif tag in _RAW:
                closed = self._closed_later(tag, at)
                if closed and not (attrs.endswith("/") and tag not in ("script", "style")):
                    at = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at).end()
                elif tag in ("script", "style"):
                    at = n
            elif tag == "br":
                self._add(" ")
            elif tag:
                self._open(tag, attrs, at)
        self._end_block()

    def _open(self, tag: str, attrs: str, at: int) -> None:
        if tag in _BLOCK:
            if (inner := next((x[0] for x in self.stack if x[0] in _INLINE_OUT), None)) is not None:
                self._close(inner)
            if not self.stack[-1][3]:
                self._end_block()
            self._close("p", ("td", "th", "div", "article", "section", "li", "body", "blockquote"))
            for other in _ENDS.get(tag, ()):
                self._close(other, ("ul", "ol", "dl", "table"))
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            return
        if tag in _OUT_TAGS | _INLINE_OUT and not self._closed_later(tag, at):
            return                                          # never closed: it holds nothing
        names = _names(attrs)
        _, outs, paths, gone = self.stack[-1]
        if tag == "h1" or tag in _ARTICLE:
            for o in outs:
                self.wraps[o] = True
        named = tag not in ("body", "html", "article", "main") and names_a_part(f"{names.get('class', '')} {names.get('id', '')}")
        named |= tag in _SOFT_TAGS and not (tag == "header" and any(x[0] == "article" for x in self.stack))
        gone |= (tag in _OUT_TAGS or tag in _INLINE_OUT or "hidden" in names or names.get("role") in _OUT_ROLES
                 or "display:none" in names.get("style", "").replace(" ", "") or named and tag not in _BLOCK)
        if named and not gone:
            outs = (*outs, len(self.wraps))
            self.wraps.append(False)
            if tag == "form":
                self.forms.add(outs[-1])
        if tag in _CONTAINER:
            kinds = ".".join(sorted({re.sub(r"\d+", "", c) for c in names.get("class", "").split()} - {""}))
            step = tag + ("." + kinds if kinds else "")
            paths = paths + (((paths[-1] + ">") if paths else "") + step,)
        self.stack.append((tag, outs, paths, gone))

    def kept(self) -> list[Block]:
        """The blocks outside the parts left out."""
        held, told = [0.0] * len(self.wraps), [0.0] * len(self.wraps)
        total = sum(b.worth() for b in self.found)
        for b in self.found:
            for o in b.outs:
                held[o] += b.worth()
                told[o] += b.worth() if b.tag == "p" else 0.0
        wrapper = [held[o] > 0.5 * total and (wraps or o in self.forms and told[o] >= 200) for o, wraps in enumerate(self.wraps)]
        return [b for b in self.found if all(wrapper[o] for o in b.outs)]


def blocks(page: str) -> list[Block]:
    """The page's text blocks outside the parts left out, in page order."""
    return _Page(page).kept()


def choice(found: list[Block]) -> str | None:
    """The path of the container that the page itself speaks for; None: the page as a whole."""
    scores: dict[str, float] = {}
    told: set[str] = set()                                  # containers with a heading or paragraph of their own
    inside: dict[str, set[str]] = {}
    for b in found:
        worth = b.worth()
        for outer, path in zip(("", *b.paths), b.paths):
            scores[path] = scores.get(path, 0.0) + worth
            inside.setdefault(outer, set()).add(path)
        scores[""] = scores.get("", 0.0) + worth
        if worth > 0 and b.tag not in _CONTAINER:
            told.add(b.paths[-1] if b.paths else "")
    at = ""
    while at not in told and at.rpartition(">")[2].partition(".")[0] not in _ARTICLE:
        best = min(inside.get(at, ()), key=lambda p: (-scores[p], p), default=None)
        if best is None or scores[best] < 0.6 * scores[at] or not scores[best]:
            break
        at = best
    return at or None


def extract(page: str, winners: list[str]) -> str:
    """Text of the blocks in the first of ``winners`` that the page has a
    block in, or in the page's own choice."""
    found = blocks(page)
    held = {p for b in found for p in b.paths}
    path = next((w for w in winners if w in held), None) or choice(found)
    within = [b for b in found if path is None or path in b.paths]
    # containers right below that are nearly all links: menus that nothing names
    child = lambda b: b.paths[b.paths.index(path) + 1] if path in b.paths[:-1] else b.paths[0] if path is None and b.paths else None
    size: dict[str, list[int]] = {}
    for b in within:
        if (c := child(b)) is not None:
            n = size.setdefault(c, [0, 0])
            n[0] += len(b.text)
            n[1] += b.linked
    return "\n\n".join(b.text for b in within if (c := child(b)) is None or size[c][1] <= 0.7 * size[c][0])


@F.arrow_udf(T.StringType())
def _vote(page: pa.Array) -> pa.Array:
    return pa.array([choice(blocks(p.as_py() or "")) for p in page], pa.string())


@F.arrow_udf(T.StringType())
def _extract(page: pa.Array, winners: pa.Array) -> pa.Array:
    return pa.array([extract(p.as_py() or "", w.as_py() or []) for p, w in zip(page, winners)], pa.string())


def host(url: Column | str) -> Column:
    u = F.lower(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")))
    return F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


def winning_paths(pages: DataFrame, url_col: str, html_col: str, share: float = 0.1) -> DataFrame:
    """(host, winners): the paths that hold at least ``share`` of a host's
    votes, most votes first; at most 1 / share of them."""
    votes = stage(pages.select(host(url_col).alias("host"), _vote(html_col).alias("path")).where("path is not null")
                  .groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("votes")), "path-votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(total, "host").where(F.col("votes") >= share * F.col("total") - 1e-9)
    return won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.round("votes", 6)).alias("v"), "path"))).alias("w")).select(
        "host", F.col("w.path").alias("winners"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text",
              most_hosts: int = MOST_HOSTS) -> DataFrame:
    """All columns of ``pages`` and ``text_col`` (replaced if there)."""
    python_ready(pages)
    winners = stage(winning_paths(pages, url_col, html_col), "winning-paths")
    if winners.limit(most_hosts + 1).count() <= most_hosts:
        winners = F.broadcast(winners)
    h = "_docloom_host"
    joined = pages.withColumn(h, host(url_col)).join(winners.select(F.col("host").alias(h), F.col("winners").alias("_docloom_w")), h, "left")
    return joined.withColumn(text_col, _extract(html_col, "_docloom_w")).drop(h, "_docloom_w")
