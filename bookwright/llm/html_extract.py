"""Main text of web pages by the container paths that the pages of a host agree on.

Each page's containers get a score from the text that stands in them. Every page votes with its scores on
generalised paths (tags and classes, without numbers); Spark adds up the votes of a host, and every page is
then extracted again from the containers at its host's winning path.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.llm.common import map_texts
from bookwright.session import materialise

VOTE = 1000  # of a page for its best container; the others get their share of it

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Element names of HTML by how they are read.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
_CONTAINERS = set("html body main article section div td center".split())
_DROPPED = set(
    "aside audio button canvas datalist dialog fieldset footer form head header input map math menu nav object option"
    " search select svg video".split()
) | _RAW
# A start tag of the key ends an open element of these, up to the nearest element that holds them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in a class, id or role that mark what is no part of an article, or that mark the article.
_NOISE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies contentinfo complementary discussion disqus dialog footer gdpr header login masthead menu modal nav navbar"
    " navigation newsletter notice notices pager pagination popup promo promoted promotion related respond share sharing"
    " sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_REPLIES = {"comment", "comments", "discussion", "disqus", "respond"}
_SIGNAL = set("article body content entry main post story text".split())


# Words beside a mark that say the element only has, lacks or frames what is named: has-sidebar, no-comments, ad-free.
_BESIDE_BEFORE = set("has have hide is no non not show with without".split())
_BESIDE_AFTER = set("above active below closed count disabled enabled free hidden left off on open page right".split())
#: An element dropped by its name alone is taken for the page's frame if nothing else is left and it holds so much.
FRAME_CHARS = 200


@dataclass
class Page:
    """Containers with their paths and parents, and blocks of text with the container each stands in.

    A path is a number: that of the path above and the container's own step make the next. Few are ever spelled out.
    """

    path_ids: list[int] = field(default_factory=lambda: [0])
    parents: list[int] = field(default_factory=lambda: [-1])
    weights: list[float] = field(default_factory=lambda: [0.5])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # container, text, characters in links
    steps: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "page")])  # of a path: the one above, and its last step
    known: dict[tuple[int, str], int] = field(default_factory=dict)
    #: Elements dropped for their class or id or as a form, in order: characters outside links within.
    frames: dict[int, int] = field(default_factory=dict)

    def add(self, container: int, step: str, weight: float) -> int:
        key = (self.path_ids[container], step)
        if key not in self.known:
            self.known[key] = len(self.steps)
            self.steps.append(key)
        self.path_ids.append(self.known[key])
        self.parents.append(container)
        self.weights.append(weight)
        return len(self.parents) - 1

    def spelled(self, path: int) -> str:
        parts = []
        while path >= 0:
            path, step = self.steps[path]
            parts.append(step)
        return ">".join(reversed(parts))

    def find(self, spelled: str | None) -> int | None:
        """The number of a path, if the page has it."""
        if spelled is None:
            return None
        at: int | None = 0
        for step in spelled.split(">")[1:]:
            at = self.known.get((at, step))
            if at is None:
                return None
        return at


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(text)}


def _words(*values: str) -> set[str]:
    return {w.lower() for value in values for w in _WORD.findall(value)}


def _marks(value: str) -> set[str]:
    """The words of a class or id that name what it is, not what it has, lacks or frames."""
    found = set()
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in _BESIDE_BEFORE or len(words) > 1 and words[-1] in _BESIDE_AFTER:
            continue
        found.update(words)
    return found


def _noise(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is no part of an article; and whether it may yet prove to be the page's frame."""
    if tag in _DROPPED:
        return True, tag == "form"
    if not attrs:
        return False, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True, False
    if tag in ("html", "body", "main"):
        return False, False
    marks = _marks(attrs.get("class", "")) | _marks(attrs.get("id", "")) | _words(attrs.get("role", ""))
    noise = bool(marks & (_REPLIES if tag == "article" else _NOISE))
    return noise, noise and not marks & _REPLIES


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *classes]).replace(">", "")


def parse(text: str) -> Page:
    """The page; if nothing is left of it, once more with the largest dropped frame kept."""
    page = _parsed(text, -1)
    if not page.blocks and page.frames:
        frame = max(page.frames, key=lambda i: (page.frames[i], -i))
        if page.frames[frame] >= FRAME_CHARS:
            return _parsed(text, frame)
    return page


def _parsed(text: str, kept: int) -> Page:
    """``kept`` is the number of the dropped frame that is none."""
    page = Page()
    stack: list[list] = []  # tag, container before it, whether it opened dropped content, whether it is a link
    open_tags: dict[str, int] = defaultdict(int)
    container, dropped, links = 0, 0, 0
    frame = frames = -1  # the frame being dropped, and the number of the last one
    inline: list[str] = []
    in_links = 0

    def flush() -> None:
        nonlocal in_links
        block = " ".join("".join(inline).split())
        if block:
            page.blocks.append((container, block, in_links))
        inline.clear()
        in_links = 0

    def pop() -> None:
        nonlocal container, dropped, links
        tag, container, drops, link = stack.pop()
        open_tags[tag] -= 1
        dropped -= drops
        links -= link

    def close(tag: str, until: set[str]) -> None:
        """Ends the nearest open ``tag`` and all within, unless an element of ``until`` lies in between."""
        if not open_tags[tag]:
            return
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] == tag:
                while len(stack) > at:
                    pop()
                return
            if stack[at][0] in until:
                return

    at = 0
    while True:
        token = _TOKEN.search(text, at)
        stop = token.start() if token else len(text)
        if dropped and frame >= 0 and not links and stop > at:
            page.frames[frame] += len(text[at:stop].strip())
        if not dropped and stop > at:
            run = html.unescape(text[at:stop])
            inline.append(run)
            if links:
                in_links += len(run.strip())
        if not token:
            break
        at = token.end()
        if tag := token["start"]:
            tag = tag.lower()
            attrs = _attributes(token["attrs"]) if token["attrs"].strip() else {}
            if tag in _RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(text, at)
                at = (text.find(">", end.start()) + 1 or len(text)) if end else len(text)
                continue
            if tag == "br":
                inline.append(" ")
            if tag not in _INLINE:
                if not dropped:
                    flush()
                close("p", _CONTAINERS - {"div"})
                if tag in _ENDS:
                    for own in _ENDS[tag][0]:
                        close(own, _ENDS[tag][1])
            if tag in _VOID:
                continue
            drops, may_frame = _noise(tag, attrs)
            if drops and not dropped:
                if may_frame:
                    frames += 1
                    drops = frames != kept
                if drops:
                    flush()
                frame = frames if may_frame and drops else -1
                if frame >= 0:
                    page.frames[frame] = 0
            elif drops:
                may_frame = False
            stack.append([tag, container, drops, tag == "a"])
            open_tags[tag] += 1
            dropped += drops
            links += tag == "a"
            if tag in _CONTAINERS and not dropped:
                signal = _words(attrs.get("class", ""), attrs.get("id", "")) & _SIGNAL
                weight = 3.0 if tag in ("article", "main") else 0.5 if tag in ("html", "body") else 2.0 if signal else 1.0
                container = page.add(container, _step(tag, attrs), weight)
        elif tag := token["end"]:
            tag = tag.lower()
            if not dropped and (tag not in _INLINE or tag == "p"):
                flush()
            was = dropped
            close(tag, set() if tag in ("html", "body") else {"table"} - {tag} if tag in _INLINE else set())
            if was and not dropped:
                inline.clear()
                in_links = 0
    if not dropped:
        flush()
    return page


def scores(page: Page) -> list[float]:
    """Text outside links that stands in each container, a half of it in the next one up and so on."""
    found = [0.0] * len(page.parents)
    for at, text, in_links in page.blocks:
        gain = max(0.0, len(text) - 2.0 * in_links)
        while at >= 0 and gain >= 0.01:
            found[at] += gain * page.weights[at]
            at, gain = page.parents[at], gain / 2
    return found


def votes(page: Page) -> dict[str, int]:
    best: dict[int, float] = defaultdict(float)
    for path, score in zip(page.path_ids, scores(page), strict=True):
        best[path] = max(best[path], score)
    top = max(best.values(), default=0)
    return {page.spelled(path): round(VOTE * score / top) for path, score in best.items() if top and score * 2 * VOTE >= top}


def main_text(page: Page, path: str | None) -> str:
    """The blocks in the containers at ``path``, or else in the page's own best container."""
    wanted = page.find(path)
    chosen = [p == wanted for p in page.path_ids]
    if wanted is None or not any(chosen):
        own = scores(page)
        chosen = [False] * len(own)
        chosen[max(range(len(own)), key=own.__getitem__)] = True
    for i in range(1, len(chosen)):  # a container comes after the one it stands in
        chosen[i] = chosen[i] or chosen[page.parents[i]]
    return "\n".join(text for at, text, _ in page.blocks if chosen[at])


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path``: the path with most votes of each host, ties to the first by name."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            sums: dict[tuple[str, str], int] = defaultdict(int)
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for path, n in votes(parse(text)).items():
                    sums[name, path] += n
            hosts, paths = zip(*sums, strict=True) if sums else ((), ())
            return {
                "host": pa.array(hosts, pa.string()),
                "path": pa.array(paths, pa.string()),
                "votes": pa.array(sums.values(), pa.int64()),
            }

        return fn

    texts = pages.select(host(pages[url_col]).alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    each = map_texts(texts, "html", "host string, path string, votes bigint", make)
    sums = each.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, path, text``, one row per input row; ``path`` is the host's.

    A null page is the empty page, and a page without text gives the empty text. Pages with a null url, or one
    without a host, vote together under the empty host. A page that lacks its host's path is extracted from its
    own best container. A null or repeated id is carried as it is; other columns are not read.
    """
    paths = materialise(host_paths(pages, url_col, html_col), "hostpaths")
    own = pages.select(
        pages[id_col].alias("page_id"),
        pages[url_col].alias("url"),
        host(pages[url_col]).alias("host"),
        F.coalesce(pages[html_col], F.lit("")).alias("html"),
    )

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            found = [main_text(parse(text), path) for path, text in rows]
            return {"page_id": batch.column(0), "url": batch.column(1), "path": batch.column(2), "text": pa.array(found, pa.string())}

        return fn

    with_path = own.join(paths, "host", "left").select("page_id", "url", "path", "html")
    id_type = pages.schema[id_col].dataType.simpleString()
    return map_texts(with_path, "html", f"page_id {id_type}, url string, path string, text string", make)
