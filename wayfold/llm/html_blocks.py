"""Main text of web pages by block rules in two passes.

Method: a page is cut at block tags into blocks of text, each with its length, the share of it inside links, and the
share of its words that are stop words. The first pass decides what it can: blocks in structural boilerplate (menus,
footers, forms, adverts, comments and the like, by element or by class and id) and blocks that are mostly links are out;
long blocks rich in stop words are in, or all long ones where a page has neither these nor an article, as in a language
without stop words here. A name is boilerplate if all its words are, besides those of place and layout ("main-nav", not
"no-sidebar"); html and body never are, and an article or main in a container that only its name leaves out is in. The second pass gives each block left over, short or poor in stop words, the
label of the nearest decided block of the same container, the one before winning a tie; where its container has none, a block is in if
the container is an article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 70  # characters from which a block is decided by its stop words
STOP_SHARE = 0.15
LINK_SHARE = 0.5

# Common function words of the languages of the corpus.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that for was on are with as be by at this from or an not have but which they you all can
    der die das und in zu den nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für
    le la les de des du et en un une que qui est dans pour pas sur au par plus ce il elle avec ne se ou son sont mais
    el la los las de del y en un una que es por con para no se su al lo como más pero sus o este ya entre cuando
    """.split()
)

# Elements whose text is never part of an article.
_DROPPED = "script|style|noscript|template|svg|title|textarea|iframe|object|select|button|canvas|math|audio|video"
_OUTSIDE = frozenset("nav footer aside form menu dialog fieldset legend label option datalist".split())
_INSIDE = frozenset("article main".split())
_WHOLE = frozenset("html body".split())
_OUT = frozenset("out named".split())
_BLOCKS = frozenset(
    """
    address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead
    tr ul
    """.split()
)
_CONTAINERS = frozenset("article main nav header footer aside form menu dialog fieldset div section ul ol table details label legend option datalist".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())

_BAD_NAME = re.compile(
    r"(?:ads?|adverts?|advertisements?|adverti[sz]ing|banners?|sponsor(?:ed|s)?|promo(?:tion)?s?|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"side-?bars?|footer|masthead|(?:site|page|top|global)[_-]?header|top-?bar|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"share|sharing|social|comments?|comment-?list|discussion|repl(?:y|ies)|respond|disqus|related|recommend(?:ed|ations?)?|widgets?|search|pagination|pager|"
    r"copyright|disclaimer|legal|toolbar|skip|hidden|teasers?|trending)",
    re.I,
)
_PLACE = r"(?:areas?|bar|block|bottom|box|column|container|content|entry|form|global|group|header|inner|items?|left|links?|list|main|outer|page|post|primary|right|secondary|section|site|to|top|wrap(?:per)?|\d+)"
_BAD_TOKEN = re.compile(rf"(?:{_PLACE}[_-]+)*{_BAD_NAME.pattern}(?:[_-]+(?:{_BAD_NAME.pattern}|{_PLACE}))*", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|text|body)(?=$|[\s_-])", re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_DROPPED})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|</?[a-z][^>]*+>|<[!?][^>]*+>""",
    re.I | re.S,
)
_EDGES = re.compile(r"^\W+|\W+$")


def _kind(tag: str, attributes: str, within: str, held: bool) -> str:
    """Whether a container is "out" of articles, out by its name only ("named"), a text of its own ("in"), or like what it stands in.

    ``held``: it stands in an article or main, whose parts stay out if they are named so.
    """
    if within == "out" or tag in _OUTSIDE or tag == "header" and within != "in":
        return "out"
    if attributes.strip():
        names, role = [], ""
        for name, *value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(value)
            if name in ("class", "id"):
                names.append(value)
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "out"
        if role in _BAD_ROLE:
            return "out"
        bad = any(_BAD_TOKEN.fullmatch(t) for n in names for t in n.split())
        if bad and (tag not in _INSIDE or within == "named"):
            return "out" if held else "named"
        if within != "named" and any(_GOOD_NAME.search(n) for n in names):
            return "in"
    return "in" if tag in _INSIDE else within


def blocks(page: str) -> list[tuple[str, str, float]]:
    """(text, kind of container, share of link characters) of each block of a page that has text."""
    out: list[tuple[str, str, float]] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, str]] = []
    kind, links, at = "", 0, 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                inside = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
                out.append((text, kind, inside / len(text)))
            pieces.clear()
            linked.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if links:
                linked.append(pieces[-1])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag in _BLOCKS:
            flush()
            if not closing and stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
                stack.pop()
                kind = stack[-1][1] if stack else ""
        if tag in _CONTAINERS:
            if not closing:
                kind = _kind(tag, m[4], kind, any(t in _INSIDE for t, _ in stack))
                stack.append((tag, kind))
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                kind = stack[-1][1] if stack else ""
                links = 0
        elif not closing and tag not in _VOID and tag not in _WHOLE and m[4] and kind not in _OUT and tag in _BLOCKS and _kind(tag, m[4], kind, True) == "out":
            stack.append((tag, "out"))  # a paragraph or heading that is marked as boilerplate
            kind = "out"
        elif closing and stack and stack[-1][0] == tag:
            stack.pop()
            kind = stack[-1][1] if stack else ""
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space; empty if there is none."""
    found = blocks(page or "")
    label: list[bool | None] = []
    for text, kind, links in found:
        if kind in _OUT or links > LINK_SHARE:
            label.append(False)
        elif len(text) >= LONG:
            words = [_EDGES.sub("", w).lower() for w in text.split()]
            words = [w for w in words if w]
            label.append(True if words and sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words) else None)
        else:
            label.append(None)
    if True not in label and not any(kind == "in" for _, kind, _ in found):
        label = [True if own is None and len(text.encode()) >= LONG else own for (text, _, _), own in zip(found, label, strict=True)]
    before: list[int | None] = []
    last: dict[str, int] = {}
    for i, (_, kind, _) in enumerate(found):
        before.append(last.get(kind))
        if label[i] is not None:
            last[kind] = i
    last, kept = {}, []
    for i in range(len(found) - 1, -1, -1):
        text, kind, _ = found[i]
        own = label[i]
        if own is None:
            near = [j for j in (before[i], last.get(kind)) if j is not None]
            own = label[min(near, key=lambda j: abs(i - j))] if near else kind == "in"
        else:
            last[kind] = i
        if own:
            kept.append(text)
    kept.reverse()
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from the whole html.

    A null html is empty and has an empty text. Character references are decoded, white space in a block becomes one
    space. Repeated rows and null ids are kept as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                b = batch.slice(at, 256)
                texts = [main_text(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
