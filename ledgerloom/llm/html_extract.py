"""Main text of HTML pages by consensus host paths.

1. Every page scores its containers: a text block gives its characters outside links to all containers around it (only
   blocks in article or main do, if these have half of the page's or more).  The best is the lowest container that has
   nearly all of them.  Paths are tag and class names with digits generalised.
2. Each page votes for its best path; Spark counts votes per host (combined before the shuffle) and keeps the paths with
   a tenth of the host's votes or more.
3. Pages are extracted again with their host's winning paths: the lowest container that has nearly all of what is in
   those on the page, and the page's own best path only if there is none.  Headings that lead to it come with it.

Menus, page headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are told by tag, role and
words in class or id names, and never count.  An article isn't dropped for such a word, nor is an element for a part of a
name that tells a state (no-sidebar, comments-open), that says what something else is (share-price) or that elements with
most of the page's text have; a form with most of the page's paragraphs is the page.

Reading a page takes time in proportion to its length, whatever is in it: elements nest DEPTH deep at most (what is deeper
stands beside its parent), and a tag whose quotes never close is read without them from then on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .cluster import ship, stored, table

#: A path wins with this share of its host's votes.
SHARE = 0.1
#: A container with this share of the characters has nearly all.
NEARLY = 0.95

#: Start tags of what a page is written in, for telling a form that is the page from one that is filled in.
_PROSE = {"p", "article", "main", "h1", "h2", "h3", "blockquote"}
#: Elements within each other, as browsers keep them; a deeper one stands beside its parent.
DEPTH = 512

_OPENING = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)")
_COMMENT_END = re.compile(r"--!?>")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_SPACING = {"br", "td", "th", "option"}
_CLOSES_P = _BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "caption"}
#: Start tags that end an open element of these names (up to the named boundary).
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_DROP_TAG = {"nav", "footer", "aside", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "head"}
_DROP_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_DROP_WORD = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "promotion", "recommended",
    "related", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tagcloud", "toolbar", "topbar", "widget", "widgets",
}
#: These words decide only as the last of a name, or before a word for a box: share-price is no share button.
_WEAK_WORD = {"banner", "login", "notice", "notices", "notification", "promo", "promotion", "recommended", "related", "respond", "share", "sharing", "skip", "social", "sponsor", "subscribe", "widget", "widgets"}
_BOX_WORD = {
    "actions", "area", "articles", "bar", "block", "bottom", "box", "btn", "button", "buttons", "card", "cards", "column", "container", "content", "dialog", "footer", "form", "group", "header", "heading", "icon", "icons",
    "inner", "items", "left", "link", "links", "list", "media", "message", "outer", "overlay", "panel", "posts", "reading", "right", "row", "section", "slot", "stories", "strip", "text", "title", "to", "tools", "top", "unit", "wrap", "wrapper",
}
_EDGE = frozenset({"article", "main", "body", "html"})
#: Start tags that leave an open head open.
_IN_HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template", "head", "basefont", "bgsound"}
_COMMENT_WORD = {"comment", "comments", "commentlist", "disqus", "respond"}
#: A class name with one of these words tells how an element is, not what it is.
_STATE_WORD = {"no", "not", "without", "has", "have", "with", "open", "closed", "enabled", "disabled", "hide", "hidden"}
_NEVER_DROPPED = {"html", "body", "main"}
_CONTAINER = _BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "li", "dt", "dd", "tr", "figcaption", "summary", "caption", "address", "hr"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in _NEVER_DROPPED:
        return False
    if tag in _DROP_TAG or attributes.get("role", "").lower() in _DROP_ROLE or "hidden" in attributes or _UNSEEN.search(attributes.get("style", "")):
        return True
    if tag == "header" and not in_article:
        return True
    return False


def _suspect(tag: str, attributes: dict[str, str]) -> set[tuple[str, bool]]:
    """Words in class or id names for which the element may have to go, and whether the word is a whole name."""
    names = attributes.get("class", "") + " " + attributes.get("id", "")
    if tag in _NEVER_DROPPED or tag == "article":
        return set()
    out = {("form", False)} if tag == "form" else set()
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        if len(words) == 1 or _STATE_WORD.isdisjoint(words):
            out |= {(w, len(words) == 1) for k, w in enumerate(words) if w in _DROP_WORD and (w not in _WEAK_WORD or k == len(words) - 1 or words[k + 1] in _BOX_WORD or words[k + 1] in _DROP_WORD)}
    return out


def _unwanted(suspects: list[set[tuple[str, bool]]], pieces: list[tuple[int, tuple[int, ...]]]) -> set[int]:
    """Numbers of the suspects that go.  pieces: characters outside links, and the suspects around them.

    Forms to fill in go.  Those with a whole word go, unless hardly any text would be left (none, for comments).  Of the others, those stay that
    have most of the text, alone or together with the others of their words.
    """
    forms = {k for k, s in enumerate(suspects) if ("form", True) in s}
    pieces = [(n, around) for n, around in pieces if forms.isdisjoint(around)]
    total = sum(n for n, _ in pieces)
    whole = {k for k, s in enumerate(suspects) if any(w for _, w in s)}
    left = total - sum(n for n, around in pieces if not whole.isdisjoint(around))
    if total and left <= total * (1 - NEARLY):
        whole = {k for k in whole if left and not _COMMENT_WORD.isdisjoint(w for w, _ in suspects[k])}
    open_to = [(n, [k for k in around if k not in whole]) for n, around in pieces if whole.isdisjoint(around)]
    total = sum(n for n, _ in open_to)
    own: dict[int, int] = {}
    for n, around in open_to:
        for k in around:
            own[k] = own.get(k, 0) + n
    wrappers = {k for k, n in own.items() if 2 * n > total}
    by_word: dict[str, int] = {}
    for n, around in open_to:
        for word in {w for k in around if k not in wrappers for w, _ in suspects[k]}:
            by_word[word] = by_word.get(word, 0) + n
    common = {w for w, n in by_word.items() if 2 * n > total}
    parts = {k for k, s in enumerate(suspects) if not any(w for _, w in s)}
    return forms | whole | {k for k in parts - wrappers if not {w for w, _ in suspects[k]} <= common}


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


class _Open:
    """An open element.  home: path of the innermost container; a paragraph's or heading's own element is not one."""

    __slots__ = ("tag", "path", "drop", "article", "header", "around", "home", "level")

    def __init__(self, tag: str, path: str, drop: bool, article: bool, header: bool, around: tuple[int, ...], up: _Open | None = None) -> None:
        self.tag, self.path, self.drop, self.article, self.header, self.around = tag, path, drop, article, header, around
        self.level = int(tag[1]) if tag in _HEADING else up.level if up else 0
        self.home = path if tag in _CONTAINER else up.home if up else ""


def tokens(page: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """Text before a tag, the tag's name ("" for none), whether it ends an element, its attributes, and where it ends.

    The caller may ``send`` where to go on.  Each part of the page is looked at a bounded number of times.
    """
    at, size, quotes = 0, len(page), True
    while at < size:
        m = _OPENING.search(page, at)
        if m is None:
            break
        here = m.start()
        if page.startswith("<!--", here):
            end = _COMMENT_END.search(page, here + 2)  # <!--> and <!---> are whole
            if end is not None and end.start() == here + 2 and end[0] == "--!>":
                end = _COMMENT_END.search(page, here + 4)
            name, ending, raw, stop = "", False, "", end.end() if end is not None else size
        else:
            close = page.find(">", here)
            if close < 0:
                break
            tag = _NAME.match(page, here + 1)
            if tag is None:
                if page[here + 1] == "/" and not page.startswith("</>", here):
                    name, ending, raw, stop = "", False, "", close + 1
                elif page[here + 1] in "!?":
                    name, ending, raw, stop = "", False, "", close + 1
                else:
                    name, ending, raw, stop = "", False, "", here + 3
            else:
                quoted = _QUOTED.match(page, tag.end()) if quotes else None
                quotes = quoted is not None
                stop = quoted.end() if quoted else max(close, tag.end()) + 1
                name, ending, raw = tag[2].lower(), bool(tag[1]), page[tag.end() : stop - 1]
        moved = yield page[at:here], name, ending, raw, stop
        at = stop if moved is None else moved
    if at < size:
        yield page[at:], "", False, "", size


def blocks(page: str | None) -> list[tuple[str, str, int, int]]:
    """Path of the enclosing container, text, characters within links, and level as a heading (0 if none), for each text block outside what is dropped."""
    # Pieces of text, characters within links, and the suspects around: which of these go is known at the end only.
    said: list[tuple[str, list[tuple[str, int, tuple[int, ...]]], int]] = []
    suspects: list[set[tuple[str, bool]]] = []
    stack = [_Open("", "", False, False, False, ())]
    opened: dict[str, int] = {}
    prose = 0
    forms: dict[int, int] = {}  # suspects that are forms, and the elements of prose in each
    text: list[tuple[str, int, tuple[int, ...]]] = []
    links = 0

    def flush(top: _Open) -> None:
        nonlocal text
        if text:
            said.append((top.home, text, top.level))
            text = []

    def say(raw: str) -> None:
        top = stack[-1]
        if raw and not top.drop and not (top.header and not top.level):
            decoded = html.unescape(raw) if "&" in raw else raw
            text.append((decoded, len(decoded.strip()) if links else 0, top.around))

    def close_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            o = stack[-1]
            if o.tag in _BLOCK:
                flush(o)
            if o.tag == "a":
                links -= 1
            opened[o.tag] -= 1
            stack.pop()

    def nearest(tags: set[str], edge: set[str] | frozenset[str] = frozenset()) -> int:
        """Place of the innermost open element of ``tags`` that no element of ``edge`` is in; 0 if there is none."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in edge:
                break
        return 0

    page = page or ""
    source = tokens(page)
    moved = None
    while True:
        try:
            before, tag, ending, raw, at = source.send(moved)
        except StopIteration:
            break
        moved = None
        if before and opened.get("head") and not before.isspace():
            if k := nearest({"head"}):
                close_to(k)
        say(before)
        if not tag:
            continue
        if ending:
            if tag == "br":
                say(" ")
            elif opened.get(tag) and (k := nearest({tag}, _EDGE if tag not in _EDGE else frozenset())):
                close_to(k)
            continue
        if opened.get("head") and tag not in _IN_HEAD and (k := nearest({"head"})):
            close_to(k)
        if tag == "form" and opened.get("form"):
            continue  # forms don't nest
        if tag in _CLOSES_P:
            k = nearest({"p"}, _BLOCK)
            if k:
                close_to(k)
        if tag in _ENDS:
            same, edge = _ENDS[tag]
            while k := nearest(same, edge):
                close_to(k)
                if tag != "tr":
                    break
        if tag in _SPACING:
            say(" ")
        if tag in _BLOCK:
            flush(stack[-1])
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not raw.rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                moved = end.end() if end else len(page)
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip() else {}
        if "hidden" in raw.lower() and "hidden" in re.split(r"[\s/]+", _ATTRIBUTE.sub(" ", raw).lower()):  # a name without a value
            attributes.setdefault("hidden", "")
        if len(stack) > DEPTH:
            close_to(len(stack) - 1)
        up = stack[-1]
        article = up.article or tag in ("article", "main") or attributes.get("role") == "main"
        path = f"{up.path}>{_step(tag, attributes)}" if (tag in _BLOCK or not up.path) else up.path
        around = up.around
        if tag in _PROSE:
            prose += 1
            if opened.get("form"):
                forms[max(forms)] += 1
        if reasons := _suspect(tag, attributes):
            if tag == "form":
                forms[len(suspects)] = 0
            around = (*around, len(suspects))
            suspects.append(reasons)
        stack.append(_Open(tag, path, up.drop or _dropped(tag, attributes, up.article), article, up.header or (tag == "header" and up.article), around, up))
        opened[tag] = opened.get(tag, 0) + 1
        if tag == "a":
            links += 1
    flush(stack[-1])
    for k, n in forms.items():
        suspects[k] = suspects[k] - {("form", False)} if 2 * n > prose else suspects[k] | {("form", True)}
    gone = _unwanted(suspects, [(0 if linked else len(t.strip()), around) for _, pieces, _ in said for t, linked, around in pieces]) if suspects else set()
    out: list[tuple[str, str, int, int]] = []
    for path, pieces, level in said:
        stay = [p for p in pieces if gone.isdisjoint(p[2])] if gone else pieces
        joined = " ".join("".join(p[0] for p in stay).split())
        if joined:
            out.append((path, joined, min(sum(p[1] for p in stay), len(joined)), level))
    return out


def _container(path: str) -> str:
    """The outermost article or main that a path runs through, else the path itself."""
    steps = path.split(">")
    for k, s in enumerate(steps):
        if s.split(".")[0] in ("article", "main"):
            return ">".join(steps[: k + 1])
    return path


def scores(found: list[tuple[str, str, int, int]]) -> dict[str, float]:
    """Score of each container's path: the characters in it, at any depth."""
    rows = [(_container(path), max(0, len(text) - 2 * linked)) for path, text, linked, _ in found]
    if not any(worth for _, worth in rows):
        rows = [(own, len(f[1])) for (own, _), f in zip(rows, found, strict=True)]
    marked = [r for r in rows if r[0].rpartition(">")[2].split(".")[0] in ("article", "main")]
    if 2 * sum(worth for _, worth in marked) >= sum(worth for _, worth in rows) > 0:
        rows = marked
    own: dict[str, float] = {}
    for path, worth in rows:
        own[path] = own.get(path, 0) + worth
    out: dict[str, float] = {}
    for path, worth in own.items():
        while True:
            out[path] = out.get(path, 0) + worth
            if not path:
                break
            path = path.rpartition(">")[0]
    return out


def best(score: dict[str, float]) -> str | None:
    """The lowest path with nearly all of the highest score, by score and name if several have it."""
    least = NEARLY * max(score.values(), default=0)
    return min((p for p in score if score[p] >= least), key=lambda p: (-p.count(">"), -score[p], p), default=None)


def _inside(own: str, path: str) -> bool:
    return own == path or own.startswith(path + ">")


def main_text(page: str | None, winners: list[str] | None) -> tuple[str, str]:
    """Text of the lowest container for what is in winning paths on the page, else of its own best; and its path."""
    found = blocks(page)
    won = [f for f in found if len(f[1]) > 2 * f[2] and any(_inside(f[0], w) for w in winners)] if winners else []
    path = best(scores(won or found))
    if path is None:
        return "", ""
    stay = [_inside(own, path) for own, _, _, _ in found]
    # Titles before the container, and headings right before text of it.
    first = stay.index(True)
    for k in range(len(found) - 1, -1, -1):
        _, text, linked, level = found[k]
        if level and not stay[k] and len(text) > 2 * linked:
            stay[k] = level == 1 and k < first or k + 1 < len(found) and stay[k + 1]
    return "\n\n".join(f[1] for f, s in zip(found, stay, strict=True) if s), path


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, else an empty text."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page in batch.column("html").to_pylist():
            score = scores(blocks(page))
            path = best(score)
            rows.append((path, score.get(path, 0.0) if path else 0.0))
        cols = list(zip(*rows, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [main_text(page, w) for page, w in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True)]
        text = [g[0] for g in got]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array((g[1] for g in got), pa.string())], names=["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host and its winning paths (an array)."""
    ship(pages.sparkSession)
    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, score double").where("path is not null")
    count = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("host"))
    return count.withColumn("share", share).where(F.col("share") >= SHARE).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("winners"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used for each row of ``pages`` (page_id, url, html; other columns are ignored).

    Null or empty html, or a page without text: empty text, path "".  Null or relative url: the host is "".  Repeated
    rows give equal results (and each votes).  An empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    winners = stored(host_paths(pages), "hosts")
    kind = dict(pages.dtypes)
    rows = pages.withColumn("host", host(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "winners")
    return rows.mapInArrow(_extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long, path string")


# ---- query ------------------------------------------------------------------------------------------------------


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
